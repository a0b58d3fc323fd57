"""Sources and sinks of tile and zone tables.

Tile tables are Parquet, written sorted by ``rid`` inside each file so the
row-group min/max statistics prune rid-range filters (P1) at the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilespark.model import TILE_COLUMNS

# Layout of one tile line of a text dump: "<rast>\t<filename>",
# rast = "<width>x<height>@<tile_col>,<tile_row>:<v1> <v2> ..." (row-major).
DUMP_SEP = "\t"
RAST_PATTERN = r"^(\d+)x(\d+)@(\d+),(\d+):(.*)$"


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """S3: read a tile table; only ``data`` holds pixels, so key-only
    queries scan a few small columns."""
    return spark.read.parquet(path)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Read a zone table (one row per polygon, rings as nested arrays),
    checked as in ``check_rings``."""
    return check_rings(spark.read.parquet(path))


def check_rings(zones: DataFrame) -> DataFrame:
    """Zones whose rings can be filled by the even-odd rule.  A ring that does
    not close, has fewer than three corners, or stands twice in one row, begun at
    whichever corner and in either direction (parts that cover each other cancel
    out), fails the query, row by row."""
    ring_ok = F.forall("rings", lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)))
    corners = F.transform("rings", lambda r: F.array_sort(F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0)))))
    twice = F.size(F.array_distinct(corners)) != F.size("rings")
    kind = zones.schema["rings"].dataType

    def fail(text):
        return F.raise_error(F.concat(F.lit(text), F.coalesce(F.col("gid").cast("string"), F.lit("null")))).cast(kind)

    return zones.withColumn("rings", F.when(F.col("rings").isNull(), F.col("rings"))
                            .when(~ring_ok, fail("an open or too short ring in zone "))
                            .when(twice, fail("a ring stands twice in zone ")).otherwise(F.col("rings")))


def write_tiles(tiles: DataFrame, path: str, mode: str = "overwrite",
                partitions: int | None = None) -> None:
    """Replace a tile table.  Range-partitioned and sorted by rid so every
    file covers a narrow rid range and rid filters prune files and row groups.
    Without ``partitions`` the range shuffle uses the session's shuffle
    partitions and AQE coalesces them to the advisory size, so file sizes
    follow the data instead of the number of cores."""
    r = tiles.repartitionByRange(partitions, "rid") if partitions else tiles.repartitionByRange("rid")
    r.sortWithinPartitions("rid").write.mode(mode).parquet(path)


def write_tiles_bucketed(tiles: DataFrame, table_name: str, buckets: int, path: str | None = None,
                         mode: str = "overwrite") -> DataFrame:
    """S8 for repeated analytics: a catalog table bucketed and sorted on the
    tile key.  Joins on ``(tile_col, tile_row)`` (zonal pieces, map algebra
    between two such tables, halo strips) then shuffle only the small side,
    or nothing when both sides share the bucketing.  Returns the table."""
    # hash-partition on the bucket key first: each task then holds exactly one
    # bucket and writes one file, instead of one file per bucket per task
    t = tiles.repartition(buckets, "tile_col", "tile_row")
    w = t.write.mode(mode).bucketBy(buckets, "tile_col", "tile_row").sortBy("tile_col", "tile_row")
    if path:
        w = w.option("path", path)
    w.format("parquet").saveAsTable(table_name)
    return tiles.sparkSession.table(table_name)


def curve_key(col: Column, row: Column) -> Column:
    """Place of a tile on a Z-order curve: the bits of its column and row in turn (up to 2^31 tiles a side)."""
    def spread(c):
        c = c.cast("long")
        # The usual masks that move the bits of a number apart, halving the gap each time.
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                            (2, 0x3333333333333333), (1, 0x5555555555555555)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    return spread(col).bitwiseOR(F.shiftleft(spread(row), 1))


def write_tiles_curve(tiles: DataFrame, path: str, partitions: int | None = None) -> None:
    """S8 laid out on two axes: tiles range-partitioned and sorted along a Z-order curve, so that every
    file covers a compact block of the raster, and a table of the files' boxes (one row per file) beside them."""
    spark = tiles.sparkSession
    t = tiles.withColumn("_curve", curve_key(F.col("tile_col"), F.col("tile_row")))
    t = t.repartitionByRange(partitions, "_curve") if partitions else t.repartitionByRange("_curve")
    t.sortWithinPartitions("_curve").drop("_curve").write.parquet(f"{path}/tiles")
    x1, y1 = F.col("ulx") + F.col("width") * F.col("scale_x"), F.col("uly") + F.col("height") * F.col("scale_y")
    boxes = spark.read.parquet(f"{path}/tiles").groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(F.least("ulx", x1)).alias("xmin"), F.max(F.greatest("ulx", x1)).alias("xmax"),
        F.min(F.least("uly", y1)).alias("ymin"), F.max(F.greatest("uly", y1)).alias("ymax"), F.count(F.lit(1)).alias("n_tiles"))
    boxes.coalesce(1).write.parquet(f"{path}/boxes")


def read_tiles_box(spark: SparkSession, path: str, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """P1 on two axes: the tiles of ``write_tiles_curve`` whose footprint meets a box (touching counts).
    Only files whose box meets it are opened; their names are what the driver reads."""
    def meets(x0, x1, y0, y1):
        return (x0 <= F.lit(xmax)) & (x1 >= F.lit(xmin)) & (y0 <= F.lit(ymax)) & (y1 >= F.lit(ymin))

    boxes = spark.read.parquet(f"{path}/boxes")
    files = [r["file"] for r in boxes.where(meets(F.col("xmin"), F.col("xmax"), F.col("ymin"), F.col("ymax"))).select("file").collect()]
    t = spark.read.schema(spark.read.parquet(f"{path}/tiles").schema).parquet(*files) if files else spark.read.parquet(f"{path}/tiles").limit(0)
    x1, y1 = F.col("ulx") + F.col("width") * F.col("scale_x"), F.col("uly") + F.col("height") * F.col("scale_y")
    return t.where(meets(F.least("ulx", x1), F.greatest("ulx", x1), F.least("uly", y1), F.greatest("uly", y1)))


def analyze(spark: SparkSession, table_name: str) -> DataFrame:
    """Table statistics for the cost-based optimizer (catalog tables)."""
    return spark.sql(f"ANALYZE TABLE {table_name} COMPUTE STATISTICS")


def with_filename(df: DataFrame, column: str = "filename") -> DataFrame:
    """The source file name of every row (from the file-scan metadata)."""
    return df.withColumn(column, F.col("_metadata.file_name"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header row, columns in the frame's order."""
    df.write.mode(mode).option("header", True).csv(path)


def head(df: DataFrame, n: int = 5, order: Sequence[str] = ("gid",)) -> DataFrame:
    """The first n rows of a table in a stable order."""
    return df.orderBy(*order).limit(n)


# ------------------------------------------------------------- text dumps

def tile_dump_lines(tiles: DataFrame, table_name: str) -> DataFrame:
    """A text dump of a tile table as lines ``value``: other lines around one
    ``<rast>\\t<filename>`` line per tile.  Whole numbers are written as such,
    other pixels with all their digits, so a dump reads back unchanged."""
    def number(x):
        whole = (x == F.floor(x)) & (F.abs(x) < F.lit(2.0 ** 53))
        return F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))

    rast = F.concat(
        F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit("@"),
        F.col("tile_col").cast("string"), F.lit(","), F.col("tile_row").cast("string"), F.lit(":"),
        F.array_join(F.transform("data", number), " "))
    body = tiles.select(F.concat_ws(DUMP_SEP, rast, F.coalesce("filename", F.lit(""))).alias("value"))
    other = [f"-- dump of {table_name}", "", "-- columns: rast, filename", "-- end of dump"]
    return body.unionByName(tiles.sparkSession.createDataFrame([(x,) for x in other], "value string"))


def tile_lines(text: DataFrame) -> DataFrame:
    """Keep only the lines with exactly two tab-separated fields."""
    return text.where(F.size(F.split("value", DUMP_SEP)) == 2)


def parse_tile_lines(lines: DataFrame) -> DataFrame:
    """Parse ``(rast, filename)`` lines into tile columns."""
    f = F.split("value", DUMP_SEP)
    r = lines.select(f[0].alias("rast"), f[1].alias("filename"))
    g = lambda i: F.regexp_extract("rast", RAST_PATTERN, i)
    return r.select(
        g(3).cast("int").alias("tile_col"), g(4).cast("int").alias("tile_row"),
        g(1).cast("int").alias("width"), g(2).cast("int").alias("height"),
        F.transform(F.split(g(5), " "), lambda x: x.cast("double")).alias("data"),
        F.when(F.col("filename") != "", F.col("filename")).alias("filename"))


def load_tile_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Bulk-load a filtered dump file (``rast<TAB>filename`` lines)."""
    schema = T.StructType([T.StructField("rast", T.StringType()), T.StructField("filename", T.StringType())])
    df = spark.read.csv(path, sep=DUMP_SEP, schema=schema, quote="", escape="")
    return parse_tile_lines(df.select(F.concat_ws(DUMP_SEP, "rast", F.coalesce("filename", F.lit(""))).alias("value")))


__all__ = ["read_tiles", "read_zones", "check_rings", "write_tiles", "write_tiles_bucketed", "analyze", "with_filename", "write_csv", "head",
           "tile_dump_lines", "tile_lines", "parse_tile_lines", "load_tile_tsv", "TILE_COLUMNS"]
