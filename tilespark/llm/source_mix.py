"""Mixing sources to target weights (DataFrame operations only).

Each document gets a hash-random key.  Within its source, documents are ordered
by that key: the key space is cut into equal buckets (the keys are uniform, so
the buckets are even, and a source with a third of all rows is spread over all
of them), each (source, bucket) is sorted on its own, and bucket totals give
the offsets, so the prefix sum of word counts is distributed.  The source is
then cut at its exact budget; a budget above the source's size repeats whole
epochs and cuts the last one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilespark.llm.common import indexed, partitions, stored, word_count

KEY_BITS = 60


def random_key(id_col: Column) -> Column:
    """The first 60 bits of the id's MD5 as a long (a null id counts as empty)."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """``target`` words for each row of ``sizes`` (source, source_size).

    Sources in code-point order, null last, take the weights in turn and share
    the sum of all sizes; a target stops at ``cap`` times its source's size and
    the excess is shared again by weight until none is above.  Every round is
    one aggregate over the source table; the driver sees two numbers.
    """
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    ranked = stored(indexed(sizes, F.asc_nulls_last("source"), name="mix-sources")
                    .withColumn("weight", w).withColumn("most", F.lit(cap) * F.col("source_size")), "mix-weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        # a source is at its cap when its share at the present level is above it
        capped = F.col("weight") * F.lit(level) > F.col("most")
        held, open_weight = ranked.agg(F.sum(F.when(capped, F.col("most")).otherwise(0.0)),
                                       F.sum(F.when(capped, 0).otherwise(F.col("weight")))).first()
        if not open_weight:
            break
        share = (total - held) / open_weight
        if share <= level:
            break
        level = share
        rest, parts = total - held, open_weight
    if not total:
        return ranked.select("source", "source_size", F.lit(0.0).alias("target"))
    free = F.col("weight") * F.lit(float(rest)) / F.lit(float(parts))
    return ranked.select("source", "source_size", F.least(F.col("most"), free).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: float = 3.0, id_col: str = "doc_id",
                source_col: str = "source", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``,
    ``taken`` (words the mix takes, repeats counted) and the ``carry`` columns.

    Size is the number of words, 0 for a null text.  A null source is a source
    of its own, ranked last.  Ties of the key go by id, then by size (rows that
    tie in all of it are alike).  No document exceeds ``ceil(cap)`` times its
    size; the order depends on ids only, so reruns agree.  Carried columns whose
    names the result uses itself give way to the result's.
    """
    n = partitions(docs.sparkSession)
    carry = [c for c in carry if c not in ("size", "source_size", "target", "taken", id_col)]
    key = random_key(F.col(id_col))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"),
                       word_count(F.col(text_col)).alias("__size"), key.alias("__key"),
                       *[F.col(c) for c in carry])
    # names the source so that null joins like any other; bucket of the key space
    rows = (rows.withColumn("__name", F.coalesce(F.concat(F.lit("s"), F.col("__source").cast("string")), F.lit("null")))
            .withColumn("__bucket", F.shiftright(F.shiftright("__key", KEY_BITS - 30) * n, 30).cast("int")))
    narrow = stored(rows.select("__id", "__source", "__name", "__bucket", "__key", "__size"), "mix-sizes")
    if not carry:
        rows = narrow
    cells = stored(narrow.groupBy("__name", "__source", "__bucket").agg(F.sum("__size").alias("cell")), "mix-cells")
    sizes = cells.groupBy(F.col("__source").alias("source")).agg(F.sum("cell").alias("source_size"))
    targets = source_targets(sizes, weights, cap).select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")).alias("__name"),
        "source_size", "target")
    # at most n buckets a source
    before = Window.partitionBy("__name").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (cells.select("__name", "__bucket", F.coalesce(F.sum("cell").over(before), F.lit(0)).alias("offset"))
               .join(targets, "__name"))
    inside = (Window.partitionBy("__name", "__bucket").orderBy("__key", "__id", "__size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (rows.withColumn("__run", F.sum("__size").over(inside))
              .join(offsets, ["__name", "__bucket"]))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - epochs * F.col("source_size")
    start = F.col("offset") + F.col("__run") - F.col("__size")
    cut = F.least(F.col("__size"), F.greatest(F.lit(0).cast("long"), left - start))
    return placed.select(F.col("__id").alias(id_col), *[F.col(c) for c in carry], F.col("__size").alias("size"),
                         F.col("source_size"), F.col("target"),
                         (epochs * F.col("__size") + cut).cast("long").alias("taken"))
