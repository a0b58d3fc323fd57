"""Rasters and zone layers derived from the driver's tables.

The tables carry no rasters or polygons, so these views map table rows onto a
raster grid (one row = one pixel) and nation / supplier / region rows onto
polygons.  Everything is a Spark plan over the tables, so work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.model import RasterSpec

# Fixture raster layout (pixels per raster row, NoData, classes).
RASTER_A_WIDTH = 100
RASTER_B_WIDTH = 100
NODATA_A = 255.0
GEO = dict(ulx=-180.0, uly=90.0, scale_x=0.25, scale_y=-0.25, srid=4326)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte raster from ``orders``: 100 pixels wide, NoData 255 for status P."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_orderkey") % RASTER_A_WIDTH).cast("int").alias("px"),
        F.floor(F.col("o_orderkey") / RASTER_A_WIDTH).cast("int").alias("py"),
        F.when(F.col("o_orderstatus") == "P", F.lit(NODATA_A))
        .otherwise((F.col("o_custkey") % 25).cast("double")).alias("v"),
    )


def cells_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte raster from ``events``: 100 wide, values floor(value) capped at 255."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("event_id") % RASTER_B_WIDTH).cast("int").alias("px"),
        F.floor(F.col("event_id") / RASTER_B_WIDTH).cast("int").alias("py"),
        F.least(F.floor("value").cast("int"), F.lit(255)).cast("double").alias("v"),
    )


def cells_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Float raster from ``embeddings``: one embedding = one pixel row."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("int").alias("py"),
                    F.posexplode("embedding").alias("px", "v")).select(
        "px", "py", F.col("v").cast("double").alias("v"))


def rows_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The float raster as row arrays ``(py, values)``, as a reader yields them."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("int").alias("py"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("values"))


def rows_large(spark: SparkSession, sf_dir: str, factor: int = 6) -> DataFrame:
    """Raster A with every pixel as a block of ``factor x factor``, as pixel rows
    ``(py, values)``; 5.4 million pixels at sf 0.1."""
    c = cells_a(spark, sf_dir).groupBy("py").agg(F.array_sort(F.collect_list(F.struct("px", "v"))).alias("r"))
    wide = F.flatten(F.transform("r", lambda x: F.array_repeat(x["v"], factor)))
    return c.select(F.col("py").cast("int").alias("y"), wide.alias("values")).select(
        F.explode(F.sequence(F.col("y") * factor, F.col("y") * factor + factor - 1)).alias("py"), "values")


def spec_large(spark: SparkSession, sf_dir: str, tile: int = 200, factor: int = 6) -> RasterSpec:
    """Its header: the same extent as raster A, pixels ``factor`` times smaller."""
    s = spec_a(spark, sf_dir, tile)
    return s.with_(width=s.width * factor, height=s.height * factor, scale_x=s.scale_x / factor, scale_y=s.scale_y / factor)


def _height(df: DataFrame) -> int:
    # Raster header: one bounded aggregate row, like reading a file header.
    return int(df.agg(F.max("py")).first()[0]) + 1


def _height_a(spark: SparkSession, sf_dir: str) -> int:
    return _height(table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / RASTER_A_WIDTH).alias("py")))


def spec_a(spark: SparkSession, sf_dir: str, tile: int = 10) -> RasterSpec:
    h = _height_a(spark, sf_dir)
    return RasterSpec(width=RASTER_A_WIDTH, height=h, tile_w=tile, tile_h=tile,
                      pixel_type="8BUI", nodata=NODATA_A, **GEO)


def spec_b(spark: SparkSession, sf_dir: str, tile: int = 10) -> RasterSpec:
    h = _height(table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / RASTER_B_WIDTH).alias("py")))
    return RasterSpec(width=RASTER_B_WIDTH, height=h, tile_w=tile, tile_h=tile,
                      pixel_type="8BUI", nodata=None, **GEO)


def spec_f(spark: SparkSession, sf_dir: str, tile: int = 10) -> RasterSpec:
    e = table(spark, sf_dir, "embeddings")
    r = e.agg(F.max("vec_id"), F.max(F.size("embedding"))).first()
    return RasterSpec(width=int(r[1]), height=int(r[0]) + 1, tile_w=tile, tile_h=tile,
                      pixel_type="32BF", nodata=None, **GEO)


# ---------------------------------------------------------------- zones

def _world_x(xp: Column) -> Column:
    return F.lit(GEO["ulx"]) + xp * F.lit(GEO["scale_x"])


def _world_y(yp: Column) -> Column:
    return F.lit(GEO["uly"]) + yp * F.lit(GEO["scale_y"])


def _pt(xp: Column, yp: Column) -> Column:
    return F.struct(_world_x(xp).alias("x"), _world_y(yp).alias("y"))


def diamond(cx: Column, cy: Column, rx: float, ry: float) -> Column:
    """Closed ring W, N, E, S, W around a centre given in pixel space."""
    rx_, ry_ = F.lit(float(rx)), F.lit(float(ry))
    w = _pt(cx - rx_, cy)
    n = _pt(cx, cy - ry_)
    e = _pt(cx + rx_, cy)
    s = _pt(cx, cy + ry_)
    return F.array(F.array(w, n, e, s, w))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    a, b, c, d = _pt(x0, y0), _pt(x1, y0), _pt(x1, y1), _pt(x0, y1)
    return F.array(F.array(a, b, c, d, a))


def with_bbox(zones: DataFrame) -> DataFrame:
    pts = F.flatten("rings")
    return zones.withColumns({
        "xmin": F.array_min(F.transform(pts, lambda p: p["x"])),
        "xmax": F.array_max(F.transform(pts, lambda p: p["x"])),
        "ymin": F.array_min(F.transform(pts, lambda p: p["y"])),
        "ymax": F.array_max(F.transform(pts, lambda p: p["y"])),
    })


def zones_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    stretch = _height_a(spark, sf_dir) / 150.0  # five rows of zones over the whole raster
    cx = (F.lit(10) + F.lit(20) * (k % 5)).cast("double")
    cy = (F.lit(15) + F.lit(30) * F.floor(k / 5)).cast("double") * F.lit(stretch)
    return with_bbox(n.select(
        k.cast("long").alias("gid"), F.col("n_name").alias("name"),
        F.col("n_regionkey").cast("int").alias("statefp"), F.lit(GEO["srid"]).alias("srid"),
        diamond(cx, cy, 9.25, 13.25 * stretch).alias("rings")))


def zones_tracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    cx = (F.lit(5) + F.lit(10) * (k % 10)).cast("double")
    cy = F.lit(7.25) + F.lit(15.0) * F.floor(k / 10).cast("double")
    return with_bbox(s.select(
        k.cast("long").alias("gid"), F.col("s_name").alias("name"),
        F.col("s_nationkey").cast("int").alias("statefp"), F.lit(GEO["srid"]).alias("srid"),
        diamond(cx, cy, 4.3, 6.9).alias("rings")))


def zones_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    k = F.col("r_regionkey").cast("double")
    return with_bbox(r.select(
        F.col("r_regionkey").cast("long").alias("gid"), F.col("r_name").alias("name"),
        F.col("r_regionkey").cast("int").alias("statefp"), F.lit(GEO["srid"]).alias("srid"),
        rectangle(F.lit(20.0) * k + F.lit(0.25), F.lit(-1.0),
                  F.lit(20.0) * k + F.lit(19.75), F.lit(_height_a(spark, sf_dir) + 1.0)).alias("rings")))
