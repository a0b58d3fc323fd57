"""Clips: to the extent of a zone layer (P8, A8) and per zone to its polygon
(P7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.functions.coords import window_size
from tilespark.model import TILE_COLUMNS, RasterSpec
from tilespark.operators.zones import span_pieces, zone_spans
from tilespark.sources.tiling import retile


def layer_extent(zones: DataFrame) -> DataFrame:
    """``(xmin, xmax, ymin, ymax)`` of a zone layer, one row."""
    return zones.agg(F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"),
                     F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"))


def extent_window(zones: DataFrame, spec: RasterSpec) -> DataFrame:
    """The pixel window of a layer extent, as the reference computes it: both
    corners truncated to pixel indexes (F1), size = their difference (F3,
    lower-right pixel excluded).  One row ``(c0, r0, w, h)``."""
    e = layer_extent(zones)
    sy = abs(spec.scale_y)
    c0 = ((F.col("xmin") - F.lit(spec.ulx)) / F.lit(spec.scale_x)).cast("int")
    r0 = ((F.lit(spec.uly) - F.col("ymax")) / F.lit(sy)).cast("int")
    c1 = ((F.col("xmax") - F.lit(spec.ulx)) / F.lit(spec.scale_x)).cast("int")
    r1 = ((F.lit(spec.uly) - F.col("ymin")) / F.lit(sy)).cast("int")
    return e.select(c0.alias("c0"), r0.alias("r0"), window_size(c0, c1).alias("w"), window_size(r0, r1).alias("h"))


def clip_to_extent(tiles: DataFrame, zones: DataFrame, spec: RasterSpec, nodata: float = -999.0,
                   tile: int | None = None) -> tuple[DataFrame, RasterSpec]:
    """Cut the raster to the window of the layer extent and re-tile it.

    The window is one aggregate row read on the driver (like the layer
    header the reference reads), so the tile scan is pruned by literal
    tile-key ranges.  Unlike the reference the window is intersected with the
    raster.  The new origin is the snapped window corner (F12); values are
    unchanged and ``nodata`` is declared (-999 in the reference).
    Returns the new tiles and their raster header.
    """
    w = extent_window(zones, spec).first()
    cx0, ry0 = max(int(w["c0"]), 0), max(int(w["r0"]), 0)
    cx1 = min(int(w["c0"]) + int(w["w"]), spec.width)
    ry1 = min(int(w["r0"]) + int(w["h"]), spec.height)
    out = spec.with_(width=max(cx1 - cx0, 0), height=max(ry1 - ry0, 0),
                     ulx=spec.ulx + cx0 * spec.scale_x, uly=spec.uly + ry0 * spec.scale_y,
                     nodata=float(nodata), tile_w=tile or spec.tile_w, tile_h=tile or spec.tile_h)
    t = tiles.where(F.col("tile_col").between(cx0 // spec.tile_w, max(cx1 - 1, 0) // spec.tile_w)
                    & F.col("tile_row").between(ry0 // spec.tile_h, max(ry1 - 1, 0) // spec.tile_h))
    # row slices of the window, re-cut on the new grid (no per-pixel rows)
    return retile(t, out, dx=cx0, dy=ry0), out


def clip_cells(tiles: DataFrame, zones: DataFrame, spec: RasterSpec, keep=None) -> DataFrame:
    """P7 in cell form: ``(keep..., rid, px, py, v)`` for pixels whose centre
    is inside each zone (the clipped pixels that ``zonal_stats`` reads)."""
    keep = list(keep) if keep is not None else ["gid", "name"]
    p = span_pieces(zone_spans(zones, spec, keep), spec, keep)
    t = tiles.select("rid", "tile_col", "tile_row", "width", "height", "data")
    j = p.join(t, ["tile_col", "tile_row"]).where((F.col("r") < F.col("height")) & (F.col("lc0") < F.col("width")))
    n = F.least(F.col("lc1"), F.col("width")) - F.col("lc0")
    j = j.select(*keep, "rid", "tile_col", "tile_row", "r", "lc0",
                 F.posexplode(F.slice("data", F.col("r") * F.col("width") + F.col("lc0") + 1, n)).alias("i", "v"))
    return j.select(*keep, "rid",
                    (F.col("tile_col") * spec.tile_w + F.col("lc0") + F.col("i")).cast("int").alias("px"),
                    (F.col("tile_row") * spec.tile_h + F.col("r")).cast("int").alias("py"), "v")


def clip_to_zones(tiles: DataFrame, zones: DataFrame, spec: RasterSpec, keep=None, nodata: float | None = None) -> DataFrame:
    """Per zone and tile, the tile cropped to the zone's pixel box with
    pixels outside the polygon set to NoData: ``(keep..., rid, tile...)``.

    Pieces are cut out of the tiles where they are joined, so no tile is copied per
    zone and a tile that very many zones share can be split over tasks; the pieces of one
    (zone, tile) are then brought together (bounded by the tile) and painted
    into the crop.  A raster without a NoData value needs ``nodata``, else a crop with a pixel outside the
    polygon fails the query: any value taken on its own could be a pixel's.
    """
    from tilespark.session import bound_arrow_batches, ship_by_value

    keep = list(keep) if keep is not None else ["gid", "name"]
    bound_arrow_batches(tiles.sparkSession)
    ship_by_value(__name__)
    p = span_pieces(zone_spans(zones, spec, keep), spec, keep)
    meta = [c for c in TILE_COLUMNS if c not in ("data", "tile_col", "tile_row")]
    j = p.join(tiles.select(*TILE_COLUMNS), ["tile_col", "tile_row"]).where((F.col("r") < F.col("height")) & (F.col("lc0") < F.col("width")))
    stretch = F.slice("data", F.col("r") * F.col("width") + F.col("lc0") + 1, F.least(F.col("lc1"), F.col("width")) - F.col("lc0"))
    cut = j.select(*keep, "tile_col", "tile_row", F.struct(*meta).alias("_tile"), F.struct("r", F.col("lc0").alias("c"), stretch.alias("v")).alias("_piece"))
    g = cut.groupBy(*keep, "tile_col", "tile_row").agg(F.first("_tile").alias("_tile"), F.collect_list("_piece").alias("_pieces"))
    r0, k0 = F.array_min("_pieces.r"), F.array_min("_pieces.c")
    g = g.select(*keep, "tile_col", "tile_row", "_tile.*", "_pieces", r0.alias("_r0"), k0.alias("_k0"),
                 (F.array_max("_pieces.r") - r0 + 1).alias("_ch"),
                 (F.array_max(F.transform("_pieces", lambda x: x["c"] + F.size(x["v"]))) - k0).alias("_cw"))
    kind = tiles.schema
    place = {"px0": F.col("px0") + F.col("_k0"), "py0": F.col("py0") + F.col("_r0"),
             "ulx": F.col("ulx") + F.col("_k0") * F.col("scale_x"), "uly": F.col("uly") + F.col("_r0") * F.col("scale_y"),
             "width": F.col("_cw"), "height": F.col("_ch"), "nodata": F.coalesce("nodata", F.lit(nodata).cast("double"))}
    order = ["rid", "filename", "srid", "tile_col", "tile_row", "px0", "py0", "ulx", "uly", "scale_x", "scale_y", "width", "height", "pixel_type", "nodata"]
    rows = g.select(*keep, *[place.get(c, F.col(c)).cast(kind[c].dataType).alias(c) for c in order], "_r0", "_k0", "_pieces")
    out = rows.drop("_r0", "_k0", "_pieces").withColumn("data", F.array().cast("array<double>")).schema

    def run(batches):
        import pyarrow as pa
        for b in batches:
            names = b.schema.names[:-3]
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], _crops(b)], [*names, "data"])

    return rows.mapInArrow(run, out)


def _crops(b):
    """The pixel arrays of one Arrow batch of crops: pieces painted over NoData."""
    import numpy as np
    import pyarrow as pa
    width, height = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("width", "height"))
    r0, k0 = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_r0", "_k0"))
    void = b.column(b.schema.get_field_index("nodata"))
    lists = b.column(b.schema.get_field_index("_pieces"))
    crop = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
    pieces = lists.flatten()
    r, c, blocks = (pieces.field(x) for x in ("r", "c", "v"))
    lens = np.diff(blocks.offsets.to_numpy())
    flat = blocks.flatten()
    size = width * height
    first = np.cumsum(size) - size
    at = first[crop] + (r.to_numpy(zero_copy_only=False) - r0[crop]) * width[crop] + c.to_numpy(zero_copy_only=False) - k0[crop]
    at = np.repeat(at - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
    filled = np.zeros(size.sum(), bool)
    filled[at] = True
    lacks = np.add.reduceat(~filled, first) > 0 if len(first) else np.zeros(0, bool)
    if (lacks & void.is_null().to_numpy(zero_copy_only=False)).any():
        raise ValueError("a crop lacks pixels and the raster declares no NoData: pass nodata=")
    out = np.repeat(void.fill_null(0.0).to_numpy(zero_copy_only=False), size)
    out[at] = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    gone = np.zeros(len(out), bool)
    gone[at] = flat.is_null().to_numpy(zero_copy_only=False)
    offsets = np.r_[first, size.sum()].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out, pa.float64(), mask=gone))
