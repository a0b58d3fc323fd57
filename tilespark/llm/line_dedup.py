"""Line dedup by winnowing over line hashes (DataFrame operations only).

A line's hash is XXH64 of its trimmed text with A-Z lower-cased.  Blank lines are
passed over.  In every window of ``run`` consecutive other lines the smallest hash is selected, so any run of
at least ``run`` lines that two places share has a selected fingerprint in both,
at the same place; with ``run = 1``, the default, that is every line.  Fingerprints that occur once are dropped by a combined
count; the others are extended to both sides into the windows that selected
them; of equal windows the first place stands, and the lines of all later ones
are deleted, with the blank lines between them.  Positions are never paired with each other: each window meets its
first place only, so a line that a third of all documents share costs one row
per occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import lower_az, stored


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def line_hashes(text: Column) -> Column:
    """Of the lines that are not blank."""
    return F.transform(F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(lower_az(F.trim(x))))


def lines_of(lines: Column, covered: Column) -> Column:
    """Numbers of the lines to remove, from the sorted numbers ``covered`` among the lines that are not
    blank: two neighbours of these take the blank lines between them along."""
    full = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.trim(F.element_at(lines, i)) != "")

    def one(at: Column) -> Column:
        return F.flatten(F.transform(covered, lambda k, i: F.when(
            F.get(covered, i + 1) == k + 1, F.sequence(F.get(at, k - 1), F.get(at, k) - 1)).otherwise(F.array(F.get(at, k - 1)))))

    return let(full, one)


def winnowed(hashes: Column, run: int) -> Column:
    """Selected positions: array of (at, hash, starts of the windows it is least in, lines around it and their start)."""
    def least_at(h: Column, s: Column) -> Column:
        return let(F.slice(h, s, F.lit(run)), lambda w: s - 1 + F.array_position(w, F.array_min(w)))

    def place(h: Column, p: Column) -> Column:
        n = F.size(h)
        first = F.greatest(F.lit(1), p - run + 1)
        starts = F.filter(F.sequence(first, F.least(p, n - run + 1)), lambda s: least_at(h, s) == p)
        return F.struct(p.alias("at"), F.element_at(h, p).alias("hash"), starts.alias("starts"), first.alias("first"),
                        F.slice(h, first, F.lit(2 * run - 1)).alias("around"))

    def all_places(h: Column) -> Column:
        return F.filter(F.transform(F.sequence(F.lit(1), F.size(h)), lambda p: place(h, p)), lambda x: F.size(x["starts"]) > 0)

    return let(hashes, lambda h: F.when(F.size(h) >= run, all_places(h)))


def line_dedup(docs: DataFrame, run: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ``n_lines``, ``n_removed``, ``n_spans`` (maximal removed
    runs), ``kept_text`` (remaining lines joined by newlines).

    A run of ``run`` or more lines that are not blank is removed where it occurs again after its
    first place, in the order of id (null last), then line number, within a
    document too.  Blank lines go only between two lines that go; whether there are any
    between the lines of a run does not matter for its being found.  Rows that repeat an id stand side by side and are ordered by
    the hash of their text; equal rows stay or lose lines alike.  A null text
    counts as empty, which is one empty line.  Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("version"))
    places = (rows.select("id", "version", F.explode(winnowed(line_hashes(F.col("text")), run)).alias("x"))
              .select("id", "version", "x.*"))
    places = stored(places, "line-fingerprints")
    # stored: as sides of their own, the joins below can split a hot hash or window
    shared = stored(places.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "line-shared")
    windows = (places.join(shared, "hash").select("id", "version", "first", "around", F.explode("starts").alias("start"))
               .select("id", "version", "start", F.slice("around", F.col("start") - F.col("first") + 1, F.lit(run)).alias("window"),
                       F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.col("version").alias("v"),
                                F.col("start").alias("s")).alias("place")))
    windows = stored(windows, "line-windows")
    firsts = stored(windows.groupBy("window").agg(F.min("place").alias("earliest"), F.count(F.lit(1)).alias("n"))
                    .where("n > 1").drop("n"), "line-firsts")
    later = (windows.join(firsts, "window").where("place > earliest")
             .groupBy("id", "version").agg(F.collect_set("start").alias("starts")))
    covered = later.select(F.col("id").alias("hit_id"), F.col("version").alias("hit_version"),
                           F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + run - 1))))).alias("covered"))
    hit = rows.join(covered, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("version") == F.col("hit_version")), "left")
    hit = hit.withColumn("gone", F.when(F.col("covered").isNull(), F.array().cast("array<int>")).otherwise(
        let(F.split("text", "\n", -1), lambda a: lines_of(a, F.col("covered")))))
    kept = let(F.split("text", "\n", -1),
               lambda a: F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size(a)), F.col("gone")),
                                                  lambda i: F.element_at(a, i)), "\n"))
    return hit.select(F.col("id").alias(id_col), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
                      F.size("gone").cast("long").alias("n_removed"),
                      F.size(F.array_except("gone", F.transform("gone", lambda x: x + 1))).cast("long").alias("n_spans"),
                      F.when(F.col("covered").isNull(), F.col("text")).otherwise(kept).alias("kept_text"))
