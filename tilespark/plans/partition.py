"""Partition planning (W2, W3, W5, A6, A7, A9) and the union of per-part
results (U1).

The reference hands each database a contiguous rid range that never splits a
row of tiles.  Here that plan is a small DataFrame (one row per band, then one
per part); Spark itself needs no such plan, but users who fan work out by rid
range (or write per-range outputs) get the same ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilespark.functions.coords import id_slice
from tilespark.session import checkpoint_dir

# The files, and the rows in files of several, that one task of write_parts writes at most.
FILES_PER_TASK = 1_000
ROWS_PER_TASK = 1_000_000


def band_ranges(tiles: DataFrame, band: str = "tile_row") -> DataFrame:
    """First and last rid of every row of tiles ``(band, min_rid, max_rid)``."""
    return tiles.groupBy(band).agg(F.min("rid").alias("min_rid"), F.max("rid").alias("max_rid"))


def band_ids(tiles: DataFrame, band: str = "tile_row") -> DataFrame:
    """The ordered rid array of every band (bounded by tiles per row)."""
    return tiles.groupBy(band).agg(F.array_sort(F.collect_list("rid")).alias("ids"))


def band_parts(tiles: DataFrame, n: int = 2, band: str = "tile_row") -> DataFrame:
    """``(band, part, min_rid, max_rid)``: bands dealt to ``n`` parts in rid
    order, as ``np.array_split`` does (first parts take the extra bands).
    ``ntile`` runs on one row per band, a bounded input."""
    b = band_ranges(tiles, band)
    return b.withColumn("part", (F.ntile(n).over(Window.orderBy("min_rid")) - 1).cast("int"))


def partition_raster(tiles: DataFrame, n: int = 2, band: str = "tile_row") -> DataFrame:
    """W2 + A9: ``(part, min_rid, max_rid)`` rid ranges that never split a band."""
    return band_parts(tiles, n, band).groupBy("part").agg(
        F.min("min_rid").alias("min_rid"), F.max("max_rid").alias("max_rid"))


def assign_parts(tiles: DataFrame, n: int = 2, band: str = "tile_row") -> DataFrame:
    """Tiles with their ``part``.  The plan is ``n`` rows, read on the driver, and
    becomes literal bounds on ``rid``: pixels are not moved, and no part or row
    of tiles meets in one task."""
    plan = partition_raster(tiles, n, band).orderBy("part").collect()
    part = F.lit(None).cast("int")
    for r in plan:
        part = F.when(F.col("rid") >= r["min_rid"], F.lit(r["part"])).otherwise(part)
    return tiles.withColumn("part", part.cast("int"))


def row_index(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """0-based global row index in ``order`` without a single-task window.

    Range-partition and sort, materialise through a checkpoint (so both
    passes see the same rows after an executor loss), count per partition,
    turn the counts (one row per partition) into offsets, and add the local
    position taken from ``monotonically_increasing_id``.  Adds ``_i`` and
    ``_n`` (total count).  Rows that tie in ``order`` are told apart by a hash of
    the whole row, which also spreads one frequent key over several ranges;
    the number of ranges is ``partitions``, else the session's shuffle
    partitions, coalesced by AQE to the size of the data."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    tie = F.xxhash64(*df.columns).alias("_tie")
    s = df.withColumn("_tie", tie)
    s = s.repartitionByRange(partitions, *order, "_tie") if partitions else s.repartitionByRange(*order, "_tie")
    s = (s.sortWithinPartitions(*order, "_tie").drop("_tie")
         .withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()}))
    s = s.checkpoint(eager=True)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_pid", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"),
                         F.sum("_c").over(Window.partitionBy()).alias("_n"))
    j = s.join(F.broadcast(offs), "_pid")
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return j.withColumn("_i", F.col("_off") + local).drop("_pid", "_mid", "_off")


def chunk_assign(df: DataFrame, n: int, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Split ordered records into ``n`` contiguous chunks of
    ``floor(len/n)``; the remainder is dealt one each to chunks 0, 1, ...
    With fewer records than chunks each record is its own chunk; ``n = 1``
    keeps every record in chunk 0."""
    r = row_index(df, order, partitions)
    return r.withColumn("part", _chunk(n)[0].cast("int")).drop("_i", "_n")


def _chunk(n: int) -> tuple[Column, Column]:
    """The chunk of the row with index ``_i`` of ``_n``, and its place in that chunk."""
    i, total = F.col("_i"), F.col("_n")
    if n <= 1:
        return F.lit(0).cast("long"), i
    size = F.floor(total / F.lit(n))
    part = F.when(size == 0, i).when(i < size * n, F.floor(i / size)).otherwise(i - size * n)
    place = F.when(size == 0, F.lit(0)).when(i < size * n, i % size).otherwise(size)
    return part, place


def write_parts(df: DataFrame, n: int, order: Sequence[str], path: str, rows_per_file: int = 1_000_000,
                partitions: int | None = None) -> None:
    """Bring the records of each of ``n`` chunks (``chunk_assign``) together:
    ``path/part=<p>/file=<f>/`` holds one Parquet file with the rows ``f *
    rows_per_file`` on of part ``p``, in ``order``.

    A row's part and place give its file, and a run of consecutive files the number of the
    task that writes them (``repartitionById``), one file after the other: every file is
    whole and sorted, and no part is held as one list.  A run is longer than one file only
    where there are more files than the session's shuffle partitions, and ends at
    ``FILES_PER_TASK`` files or ``ROWS_PER_TASK`` rows.
    """
    spark = df.sparkSession
    r = row_index(df, order, partitions)
    part, place = _chunk(n)
    r = r.withColumns({"part": part.cast("int"), "_place": place.cast("long")})
    r = r.withColumn("file", F.floor(F.col("_place") / rows_per_file).cast("int"))
    total = r.agg(F.max("_n")).first()[0] or 0
    files = max(1, -(-(total // max(n, 1) + 1) // rows_per_file))
    parts = max(1, min(n, total))
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = max(1, min(FILES_PER_TASK, ROWS_PER_TASK // rows_per_file, parts * files // shuffled))
    number = F.col("part").cast("long") * files + F.col("file")
    r = r.repartitionById(-(-parts * files // run), F.floor(number / run).cast("int"))
    (r.sortWithinPartitions("part", "file", "_place").drop("_i", "_n", "_place")
     .write.partitionBy("part", "file").parquet(path))


def read_parts(spark: SparkSession, path: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """The records written by ``write_parts`` with their ``part``, ``file`` and ``place`` in
    the part (``rows_per_file`` as it was written).  A filter on ``part`` reads that part's files alone."""
    place = F.col("file").cast("long") * rows_per_file + F.col("_metadata.row_index")
    return _read_folders(spark, path).withColumn("place", place)


def _read_folders(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of many small folders.  Spark lists them by one task per folder
    (up to 10,000); here no more tasks than the session's shuffle partitions list them,
    which changes no row.  The setting is put back once the table is listed."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key, None)
    spark.conf.set(key, min(int(spark.conf.get(key)), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    try:
        return spark.read.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def part_groups(df: DataFrame, key: str) -> DataFrame:
    """Per part, the count and the first and last key; ``write_parts`` brings
    the records themselves together."""
    return df.groupBy("part").agg(F.count(F.lit(1)).alias("n_records"),
                                  F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def per_part(tiles: DataFrame, n: int, analytic: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """U1 in one scan: ``analytic`` over tiles that carry their ``part`` (it groups
    by ``part`` too); the union of the per-part results without a scan per part."""
    return analytic(assign_parts(tiles, n))


def union_parts(frames: Iterable[DataFrame]) -> DataFrame:
    """Bag union of per-part results."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def first_ids(tiles: DataFrame, lo: int, hi: int) -> DataFrame:
    """F8 over a whole table (``array_agg(rid)`` then ``ids[lo:hi]``): only
    the ``hi`` smallest rids are ever gathered (a top-k), never all ids."""
    k = tiles.select("rid").orderBy("rid").limit(hi)
    return k.agg(id_slice(F.array_sort(F.collect_list("rid")), lo, hi).alias("ids"))
