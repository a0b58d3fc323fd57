"""Helpers shared by the corpus operators: scratch storage, text normalisation
that equals its byte-wise definition, and a distributed row index."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilespark.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of anything but ASCII white space (space, \t \n \v \f \r).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unused folder name under the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors, and later jobs read only the columns they need."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only.  For pure ASCII, ``lower`` does just that, and faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def indexed(df: DataFrame, *order: Column, name: str = "index") -> DataFrame:
    """Add ``pos``, the 0-based rank in ``order``, without any single-task sort:
    range partitions are stored once, their sizes (one row each) give the offsets."""
    n = partitions(df.sparkSession)
    s = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
               .withColumn("__m", F.monotonically_increasing_id()), name)
    part, row = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    sizes = s.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    # at most one row for each of the n partitions
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__o"))
    return (s.withColumn("__p", part).join(F.broadcast(offsets), "__p")
            .withColumn("pos", F.col("__o") + row).drop("__m", "__p", "__o"))


#: Where a row stands in its files: a hash of the file's path, and the row's number in it.
PLACE = ["__file", "__row"]
#: Rows of two numbers that are broadcast at most (16 MB); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def placed(docs: DataFrame) -> DataFrame:
    """A table of Parquet files with the ``PLACE`` of every row, the same however often it is
    read; rows that equal each other have places of their own.  What is no such table is stored first."""
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))
    except AnalysisException:
        return placed(stored(docs, "placed"))


def few(rows: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows``, stored; marked for a broadcast only if counted to be no more than ``most``."""
    rows = stored(rows, name)
    return F.broadcast(rows) if rows.count() <= most else rows
