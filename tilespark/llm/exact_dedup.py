"""Exact dedup by content sort (DataFrame operations only).

Sampled splitters range-partition the normalised text (``repartitionByRange``
samples them), Spark's external sort puts equal texts next to each other, and
the window operator compares each full text with its neighbour's.  The sampled
key is a short prefix and a hash, so what reaches the driver as splitters is
bounded whatever the length of the texts; the full text is a sort key after it.

A group of copies may hold a third of all rows.  Groups above a share of a
partition are found first from hash counts (combined before the shuffle); there
are at most ``4 * partitions`` of them, a bound that makes the broadcast safe.
Their rows are dealt over several ranges by a salt, each range finds its own
winner, and the winners are merged by digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilespark.llm.common import lower_az, partitions, stored


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                prefix_bytes: int = 32, carry: bool = False) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; a null text counts
    as empty.  ``keep`` ("min" or "max") says which id of a group stays.  Null
    ids rank last, ids may be of any type with an order; of rows that tie (same id and text) exactly one is ``kept``.
    Further columns of ``docs`` are ignored, an empty table gives no rows.  With
    ``carry`` only rows that may stay are returned, each with the whole input
    row as the struct ``row``; texts are still shuffled once.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    n = partitions(docs.sparkSession)
    body = F.struct(*[F.col(c) for c in docs.columns]) if carry else F.struct(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), body.alias("row"))
    norm = lower_az(F.coalesce(F.col(f"row.{text_col}"), F.lit("")))
    hashed = rows.select("id", "row", F.xxhash64(norm).alias("h"), F.substring(norm, 1, prefix_bytes).alias("prefix"))
    share = max(1, docs.count() // (4 * n))
    # at most rows / share = 4 n hashes can be above the share
    heavy = (hashed.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > share)
             .select("h", F.ceil(F.col("c") / share).cast("int").alias("pieces")))
    salted = (hashed.join(F.broadcast(heavy), "h", "left")
              .withColumn("salt", F.when(F.col("pieces").isNull(), F.lit(0))
                          .otherwise(F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")))
              .select("id", "row", "h", "prefix", "salt", F.col("pieces").isNotNull().alias("heavy")))
    ranged = salted.repartitionByRange(n, "prefix", "h", "salt").withColumn("norm", norm)
    best = F.desc_nulls_last("id") if keep == "max" else F.asc_nulls_last("id")
    ordered = Window.partitionBy("prefix", "h", "norm", "salt").orderBy(best)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = ranged.select("id", "salt", "heavy", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
                         F.row_number().over(ordered).alias("place"),
                         F.first("id").over(whole).alias("best"),
                         F.count(F.lit(1)).over(whole).alias("members"), *(["row"] if carry else []))
    runs = stored(runs.where("place = 1") if carry else runs, "exact-runs")
    # one row for each run of a heavy text, at most 4 n texts
    top = keep == "max"
    # a null id stands behind all others; of runs with one best id the smallest salt wins
    order = F.struct(F.col("best").isNotNull() if top else F.col("best").isNull(), "best", -F.col("salt") if top else F.col("salt"))
    heads = (runs.where("heavy AND place = 1").groupBy("sha")
             .agg(F.sum("members").alias("all_members"), (F.max if top else F.min)("best").alias("all_best"),
                  (F.max_by if top else F.min_by)("salt", order).alias("win_salt")))
    joined = runs.join(F.broadcast(heads), "sha", "left")
    merged = F.col("heavy") & F.col("all_members").isNotNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(merged, F.col("all_best")).otherwise(F.col("best")).alias("keep_id"),
        F.when(merged, F.col("all_members")).otherwise(F.col("members")).cast("long").alias("group_size"),
        ((F.col("place") == 1) & (~merged | (F.col("salt") == F.col("win_salt")))).alias("kept"),
        F.col("sha").alias("text_sha256"), *(["row"] if carry else []))
