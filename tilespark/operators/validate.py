"""Tile-table validation (S10): the checks the reference switches on when it
adds raster constraints, and the invariants of the tile layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Constraint flags in the reference's order and whether each is on.
CHECKS = [
    ("srid", True), ("scale_x", True), ("scale_y", True), ("blocksize_x", True),
    ("blocksize_y", True), ("same_alignment", True), ("regular_blocking", False),
    ("num_bands", True), ("pixel_types", True), ("nodata_values", True), ("out_db", True),
    ("extent", False),
]
#: A tile row has one band, stored in the row, so two of the reference's checks
#: hold by the layout; these take their place.
LAYOUT_CHECKS = ["array_length", "null_pixels", "tile_position"]


def validate_tiles(tiles: DataFrame) -> DataFrame:
    """``(check, ok, n_bad)`` for each check.

    Uniform columns (``srid`` to ``nodata_values``; block sizes without the ragged
    last column / row; alignment as the implied grid origin) compare the least
    and greatest value: ``n_bad`` is 1 if they differ.  The layout checks count
    tiles whose array is not ``width * height`` long, holds a null, or whose
    ``rid`` and pixel offset do not fit the tile's place in the grid.  One
    aggregate over the table and one over its keys; every check of an empty
    table holds.
    """
    m = tiles.agg(F.max("tile_col").alias("mc"), F.max("tile_row").alias("mr")).first()
    mc, mr = F.lit(m["mc"]).cast("int"), F.lit(m["mr"]).cast("int")
    ox = F.round((F.col("ulx") - F.col("px0") * F.col("scale_x")) / F.col("scale_x"), 6)
    oy = F.round((F.col("uly") - F.col("py0") * F.col("scale_y")) / F.col("scale_y"), 6)
    uniform = {
        "srid": F.coalesce(F.col("srid").cast("string"), F.lit("none")),
        "scale_x": F.col("scale_x"), "scale_y": F.col("scale_y"),
        "blocksize_x": F.when(F.col("tile_col") < mc, F.col("width")),
        "blocksize_y": F.when(F.col("tile_row") < mr, F.col("height")),
        "same_alignment": F.struct(ox, oy),
        "pixel_types": F.coalesce("pixel_type", F.lit("none")),
        "nodata_values": F.coalesce(F.col("nodata").cast("string"), F.lit("none")),
    }
    ntx = mc.cast("long") + 1
    bad = {
        "array_length": F.coalesce(F.size("data") != F.col("width") * F.col("height"), F.lit(True)),
        "null_pixels": F.exists("data", lambda x: x.isNull()),
        "tile_position": F.col("rid") != F.col("tile_row") * ntx + F.col("tile_col") + 1,
    }
    a = tiles.agg(*[(~F.min(c).eqNullSafe(F.max(c))).cast("long").alias(k) for k, c in uniform.items()],
                  *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in bad.items()])
    names = [c for c, on in CHECKS if on and c in uniform] + LAYOUT_CHECKS
    stack = "stack({n}, {items}) as (check, n_bad)".format(n=len(names), items=", ".join(f"'{c}', `{c}`" for c in names))
    return a.selectExpr(stack).select("check", (F.col("n_bad") == 0).alias("ok"), "n_bad")


def validate_blocking(tiles: DataFrame) -> DataFrame:
    """S10, the two checks that the reference leaves off: ``(check, ok, n_bad)``.

    ``regular_blocking`` counts tiles that are no block of the grid (the largest width and height
    give the block): begun off a block's corner, smaller than a block without
    being in the last column or row, or standing where a tile stands already.
    ``extent`` counts the blocks between the table's first and last column and row
    that no tile begins in.  Tiles meet on their block's key, one small row each, and are
    never compared in pairs.  Both checks of an empty table hold.
    """
    m = tiles.agg(F.max("width"), F.max("height"), F.min("px0"), F.min("py0"), F.max("px0"), F.max("py0")).first()
    w, h = m[0] or 1, m[1] or 1
    if m[2] is None:
        m = (1, 1, 0, 0, -1, -1)
    last_col, last_row = m[4] // w, m[5] // h
    col, row = F.floor(F.col("px0") / w), F.floor(F.col("py0") / h)
    odd = ((F.col("px0") % w != 0) | (F.col("py0") % h != 0) | (F.col("width") < w) & (col < last_col)
           | (F.col("height") < h) & (row < last_row))
    keys = tiles.groupBy(col.alias("col"), row.alias("row")).agg(F.count(F.lit(1)).alias("n"), F.sum(odd.cast("long")).alias("odd"))
    # a tile is bad once: off the grid, or a further one in its block
    blocks = (last_col - m[2] // w + 1) * (last_row - m[3] // h + 1)
    a = keys.agg(F.coalesce(F.sum(F.greatest("odd", F.col("n") - 1)), F.lit(0)).alias("regular_blocking"),
                 (F.lit(blocks) - F.count(F.lit(1))).alias("extent"))
    return a.selectExpr("stack(2, 'regular_blocking', regular_blocking, 'extent', extent) as (check, n_bad)").select(
        "check", (F.col("n_bad") == 0).alias("ok"), "n_bad")
