"""Two-raster map algebra (J3, F9, X2) and tile pairing.

Aligned tilings (same grid, same tile size) pair tiles by an equi-join on
``(tile_col, tile_row)``; the result covers the INTERSECTION of both extents.
Unlike tilings go through the cell form and are re-tiled.  A pair is never
formed for tiles that do not overlap: the reference's comma join of two
tile tables only yields pixels for overlapping pairs, and that is what the
equi-join produces without a Cartesian product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.functions.arrays import let
from tilespark.functions.pixels import CellExpr, clamp_to_type, zip_cells
from tilespark.model import TILE_COLUMNS, RasterSpec
from tilespark.sources.tiling import retile


def _pick(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in TILE_COLUMNS])


def map_algebra(a: DataFrame, b: DataFrame, expr: str | CellExpr, pixel_type: str = "8BUI",
                nodata: float | None = None) -> DataFrame:
    """``expr(rast1, rast2)`` cell by cell over aligned tile tables.

    A cell that is NoData in either input is NoData in the output; results
    are forced into ``pixel_type``.  The output NoData is ``nodata``, else the
    first input's, else the second's.  Tiles that share a key but not the SRID,
    pixel size or origin fail the query: such rasters are not aligned.
    """
    if a is b:
        return _self_algebra(a, expr, pixel_type, nodata)
    j = _pick(a, "a_").join(_pick(b, "b_"), (F.col("a_tile_col") == F.col("b_tile_col"))
                            & (F.col("a_tile_row") == F.col("b_tile_row")))
    w = F.least("a_width", "b_width")
    h = F.least("a_height", "b_height")
    j = _check_aligned(j).withColumns({"width": w, "height": h})

    def take(p: str):
        """The pixels both tiles have: the first rows, cut only where the widths differ."""
        own = F.col(p + "width")
        rows = F.sequence(F.lit(0), F.col("height") - 1)
        return let(F.col(p + "data"), lambda d: F.when(own == F.col("width"), F.slice(d, F.lit(1), F.col("width") * F.col("height")))
                   .otherwise(F.flatten(F.transform(rows, lambda r: F.slice(d, r * own + 1, F.col("width"))))))

    j = j.withColumns({"_a": take("a_"), "_b": take("b_")})
    nd_out = F.lit(nodata).cast("double") if nodata is not None else F.coalesce("a_nodata", "b_nodata")
    j = j.withColumn("nodata", nd_out)
    nda, ndb = F.col("a_nodata"), F.col("b_nodata")
    # NoData in either input -> NoData; else the result forced into the type
    data = zip_cells("_a", "_b", expr, lambda x, y, r: F.when(
        (nda.isNotNull() & (x == nda)) | (ndb.isNotNull() & (y == ndb)), F.col("nodata")).otherwise(clamp_to_type(r, pixel_type)))
    return j.select(
        F.col("a_rid").alias("rid"), F.col("a_filename").alias("filename"), F.col("a_srid").alias("srid"),
        F.col("a_tile_col").alias("tile_col"), F.col("a_tile_row").alias("tile_row"),
        F.col("a_px0").alias("px0"), F.col("a_py0").alias("py0"), F.col("a_ulx").alias("ulx"),
        F.col("a_uly").alias("uly"), F.col("a_scale_x").alias("scale_x"), F.col("a_scale_y").alias("scale_y"),
        "width", "height", F.lit(pixel_type).alias("pixel_type"), "nodata", data.alias("data"))


def _check_aligned(j: DataFrame) -> DataFrame:
    """Fails the query at the first pair of tiles whose headers do not fit (row by
    row, no extra job): SRID, pixel size, origin, and block size inside the raster."""
    same = F.lit(True)
    for c in ("srid", "scale_x", "scale_y", "ulx", "uly", "px0", "py0"):
        same = same & F.col("a_" + c).eqNullSafe(F.col("b_" + c))
    return j.where(F.when(same, F.lit(True)).otherwise(
        F.raise_error(F.lit("rasters are not aligned: SRID, pixel size, origin or tile size differ")).cast("boolean")))


def _self_algebra(a: DataFrame, expr, pixel_type: str, nodata: float | None) -> DataFrame:
    """A raster with itself: every tile pairs only with itself, so the cell
    expression is a per-tile ``zip_with`` and no join or shuffle is needed."""
    t = a.select(*TILE_COLUMNS).withColumn("_r", zip_cells("data", "data", expr))
    nd_in = F.col("nodata")
    nd_out = F.lit(nodata).cast("double") if nodata is not None else nd_in
    t = t.withColumn("data", F.zip_with("data", "_r", lambda x, r: F.when(
        nd_in.isNotNull() & (x == nd_in), nd_out).otherwise(clamp_to_type(r, pixel_type))))
    return t.withColumn("nodata", nd_out).withColumn("pixel_type", F.lit(pixel_type)).select(*TILE_COLUMNS)


def map_algebra_cells(a: DataFrame, b: DataFrame, expr: str | CellExpr, spec: RasterSpec,
                      nodata_a: float | None, nodata_b: float | None,
                      pixel_type: str = "8BUI", spec_b: RasterSpec | None = None) -> DataFrame:
    """J3 for unlike tilings (same grid origin and pixel size): ``b`` is
    re-cut onto ``a``'s tiling by row slices (``retile``), then the aligned
    tile join applies.  ``spec_b`` gives b's raster size (default: a's)."""
    sb = spec_b or spec
    b2 = retile(b, spec.with_(width=sb.width, height=sb.height, nodata=nodata_b))
    b2 = b2.withColumn("nodata", F.lit(nodata_b).cast("double"))
    a2 = a.withColumn("nodata", F.lit(nodata_a).cast("double"))
    nd = nodata_a if nodata_a is not None else nodata_b
    return map_algebra(a2, b2, expr, pixel_type, nodata=nd)


def tile_pairs(a: DataFrame, b: DataFrame, spec_a: RasterSpec, spec_b: RasterSpec) -> DataFrame:
    """J4 re-aimed: ``(rid_a, rid_b)`` for tile pairs whose footprints overlap
    with positive area (the only pairs of the reference's comma join that carry
    pixels).  Tiles of ``b`` are keyed by the grid cells of ``a`` they cover,
    so this is an equi-join, linear in the number of overlapping pairs."""
    ta, tb = spec_a.tile_w, spec_a.tile_h
    bk = b.select(F.col("rid").alias("rid_b"), F.col("px0").alias("bx0"), F.col("py0").alias("by0"),
                  F.col("width").alias("bw"), F.col("height").alias("bh"))
    bk = bk.withColumns({
        "tile_col": F.explode(F.sequence(F.floor(F.col("bx0") / ta).cast("int"),
                                         F.floor((F.col("bx0") + F.col("bw") - 1) / ta).cast("int")))})
    bk = bk.withColumn("tile_row", F.explode(F.sequence(F.floor(F.col("by0") / tb).cast("int"),
                                                        F.floor((F.col("by0") + F.col("bh") - 1) / tb).cast("int"))))
    ak = a.select(F.col("rid").alias("rid_a"), "tile_col", "tile_row", F.col("px0").alias("ax0"),
                  F.col("py0").alias("ay0"), F.col("width").alias("aw"), F.col("height").alias("ah"))
    j = ak.join(bk, ["tile_col", "tile_row"])
    overlap = ((F.col("ax0") < F.col("bx0") + F.col("bw")) & (F.col("bx0") < F.col("ax0") + F.col("aw"))
               & (F.col("ay0") < F.col("by0") + F.col("bh")) & (F.col("by0") < F.col("ay0") + F.col("ah")))
    return j.where(overlap).select("rid_a", "rid_b")
