"""Polygon zones on a raster grid: ring edges, scanline spans, and the
spatial joins built on them (J1, J2, J6).

Spark has no spatial join, and a range-only join condition plans as a
Cartesian product.  Every join here is therefore turned into an equi-join on
grid keys: an edge is exploded only into the pixel rows (or tile rows) it
crosses, a span only into the tile columns it covers.  The amount of
generated rows is linear in zone perimeter and area / tile size, and no key
holds a whole zone, so one huge zone is spread over many tasks.

Pixel membership: a pixel belongs to a zone when its centre is inside under
the even-odd rule, with half-open crossings ``(y1 > yc) <> (y2 > yc)`` and
the crossing counted when it lies right of the centre.  Holes and multipart
zones are just more rings of a row; several rows of one zone are united, so a
pixel counts once however many of them hold it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.model import RasterSpec
from tilespark.sources.io import check_rings

GEOMETRY_COLUMNS = {"rings", "xmin", "ymin", "xmax", "ymax"}


def attribute_columns(zones: DataFrame) -> list[str]:
    return [c for c in zones.columns if c not in GEOMETRY_COLUMNS]


def check_srid(zones: DataFrame, spec: RasterSpec) -> DataFrame:
    """Zones and raster must share a coordinate system: a zone with another
    SRID fails the query (checked lazily, row by row, no extra job)."""
    if "srid" not in zones.columns or spec.srid is None:
        return zones
    bad = F.col("srid").isNotNull() & (F.col("srid") != F.lit(spec.srid))
    msg = F.concat(F.lit("zone SRID "), F.col("srid").cast("string"),
                   F.lit(f" differs from the raster SRID {spec.srid}"))
    return zones.withColumn("rings", F.when(bad, F.raise_error(msg).cast(zones.schema["rings"].dataType))
                            .otherwise(F.col("rings")))


def zone_edges(zones: DataFrame, keep: Sequence[str] | None = None, numbered: bool = False) -> DataFrame:
    """EDGE: one row per ring segment ``(x1, y1) -> (x2, y2)``; ``numbered``
    adds ``_row``, a hash of its zone row's rings, and the numbers ``_ring`` of its ring and ``_seg`` in
    it, which come out the same however often the rows are computed."""
    keep = list(keep) if keep is not None else attribute_columns(zones)
    r = zones.where(F.col("rings").isNotNull())
    if numbered:
        r = r.select(*keep, F.xxhash64("rings").alias("_row"), F.posexplode("rings").alias("_ring", "ring"))
        keep += ["_row", "_ring"]
    else:
        r = r.select(*keep, F.explode("rings").alias("ring"))
    r = r.where(F.size("ring") >= 2)
    seg = F.transform(F.sequence(F.lit(1), F.size("ring") - 1), lambda i: F.struct(
        F.col("ring")[i - 1]["x"].alias("x1"), F.col("ring")[i - 1]["y"].alias("y1"),
        F.col("ring")[i]["x"].alias("x2"), F.col("ring")[i]["y"].alias("y2")))
    if numbered:
        return r.select(*keep, F.posexplode(seg).alias("_seg", "e")).select(*keep, "_seg", "e.*")
    return r.select(*keep, F.explode(seg).alias("e")).select(*keep, "e.*")


def row_centre_y(py: Column, spec: RasterSpec) -> Column:
    return F.lit(spec.uly) + (py + F.lit(0.5)) * F.lit(spec.scale_y)


def col_centre_x(px: Column, spec: RasterSpec) -> Column:
    return F.lit(spec.ulx) + (px + F.lit(0.5)) * F.lit(spec.scale_x)


def first_col_at_or_after(x: Column, spec: RasterSpec) -> Column:
    """Smallest pixel column whose centre x is >= ``x`` (north-up grids)."""
    c = F.ceil((x - F.lit(spec.ulx)) / F.lit(spec.scale_x) - F.lit(0.5))
    c = F.when(col_centre_x(c - 1, spec) >= x, c - 1).otherwise(c)
    return F.when(col_centre_x(c, spec) < x, c + 1).otherwise(c)


def edge_crossings(edges: DataFrame, spec: RasterSpec, keep: Sequence[str]) -> DataFrame:
    """Every (edge, pixel row) whose row centre the edge crosses, with the x of
    the crossing.  Rows outside the raster are never generated."""
    ys1 = (F.col("y1") - F.lit(spec.uly)) / F.lit(spec.scale_y)
    ys2 = (F.col("y2") - F.lit(spec.uly)) / F.lit(spec.scale_y)
    lo = F.greatest(F.ceil(F.least(ys1, ys2) - F.lit(0.5)) - 1, F.lit(0)).cast("int")
    hi = F.least(F.floor(F.greatest(ys1, ys2) - F.lit(0.5)) + 1, F.lit(spec.height - 1)).cast("int")
    e = edges.where(F.col("y1") != F.col("y2")).withColumns({"_lo": lo, "_hi": hi}).where(F.col("_lo") <= F.col("_hi"))
    e = e.withColumn("py", F.explode(F.sequence("_lo", "_hi")))
    yc = row_centre_y(F.col("py"), spec)
    e = e.where((F.col("y1") > yc) != (F.col("y2") > yc))
    xc = F.col("x1") + (yc - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    return e.select(*keep, "py", xc.alias("xc"))


def zone_spans(zones: DataFrame, spec: RasterSpec, keep: Sequence[str] | None = None) -> DataFrame:
    """SPAN: ``(keep..., py, c0, c1)``: pixels ``c0 <= px < c1`` of row ``py``
    have their centre inside the zone.  Only rows and columns inside the
    raster are produced.  One group per (zone, pixel row): bounded by the
    number of ring edges crossing one row.

    Crossings pair by the even-odd rule within a zone row; the spans of all rows
    of a zone are united, so spans never share a pixel.  A ring inside another
    of its row is a hole; rings of a row that partly cover each other fail the
    query."""
    keep = list(keep) if keep is not None else attribute_columns(zones)
    zones = check_rings(check_srid(zones, spec))
    own = ["_row", "_ring", "_seg"]
    x = edge_crossings(zone_edges(zones, keep, numbered=True), spec, [*keep, *own])
    # the first pixel right of a crossing is found here, once, not in the lambdas below
    x = x.select(*keep, "py", *own, "xc", first_col_at_or_after(F.col("xc"), spec).cast("int").alias("c"))
    # a set: a zone row that stands twice has the same crossings and counts once
    g = x.groupBy(*keep, "py").agg(F.array_sort(F.collect_set(F.struct("_row", "_ring", "xc", "_seg", "c"))).alias("xs"))

    def spans(xs: Column) -> Column:
        """The pixel spans (row, c0, -c1) of neighbours 2k and 2k + 1, none empty."""
        pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / 2).cast("int") - 1), lambda k: F.struct(
            F.get(xs, k * 2)["_row"].alias("row"), F.greatest(F.get(xs, k * 2)["c"], F.lit(0)).alias("c0"),
            (-F.least(F.get(xs, k * 2 + 1)["c"], F.lit(spec.width))).alias("end")))
        return F.filter(pairs, lambda p: -p["end"] > p["c0"])

    # a closed ring crosses a pixel row an even number of times, so no pair spans two rings or two rows
    by_ring = spans(F.col("xs"))
    by_row = spans(F.array_sort(F.transform("xs", lambda c: F.struct(
        c["_row"].alias("_row"), c["xc"].alias("xc"), c["_seg"].alias("_seg"), c["c"].alias("c")))))
    several = (F.get("xs", F.lit(0))["_row"] != F.element_at("xs", -1)["_row"]) | (
        F.get("xs", F.lit(0))["_ring"] != F.element_at("xs", -1)["_ring"])
    g = g.where(F.size("xs") >= 2).withColumn("_crossed", F.when(several, partly_covered(F.array_sort(by_ring))).otherwise(F.lit(False)))
    fault = F.concat(F.lit("overlapping rings in a row of zone "), F.coalesce(F.col(keep[0]).cast("string"), F.lit("null")))
    g = g.withColumn("_spans", F.when(F.col("_crossed"), F.raise_error(fault).cast("array<struct<row:bigint,c0:int,end:int>>"))
                     .otherwise(by_row))
    g = g.select(*keep, "py", F.array_sort(F.transform("_spans", lambda p: p["c0"])).alias("_from"),
                 F.array_sort(F.transform("_spans", lambda p: -p["end"])).alias("_to")).where(F.size("_from") > 0)
    # the k-th start begins a united span when the k spans before it have ended
    n = F.size("_from")
    g = g.withColumn("_first", F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == 0) | (F.get("_to", k - 1) < F.get("_from", k))))
    united = F.transform("_first", lambda k, i: F.struct(
        F.get("_from", k).alias("c0"), F.get("_to", F.coalesce(F.get("_first", i + 1), n) - 1).alias("c1")))
    return g.select(*keep, "py", F.explode(united).alias("p")).select(*keep, "py", "p.c0", "p.c1")


def partly_covered(spans: Column) -> Column:
    """Whether two of the spans (row, c0, -c1) of rings, sorted, of one row share
    pixels without one holding the other."""
    start = F.struct(F.lit(False).alias("bad"), F.lit(-1).cast("long").alias("row"), F.array().cast("array<int>").alias("ends"))

    def step(a, s):
        around = F.when(a["row"] == s["row"], F.filter(a["ends"], lambda e: e > s["c0"])).otherwise(F.array().cast("array<int>"))
        return F.struct((a["bad"] | F.exists(around, lambda e: e < -s["end"])).alias("bad"), s["row"].alias("row"),
                        F.concat(around, F.array(-s["end"])).alias("ends"))

    return F.aggregate(spans, start, step, lambda a: a["bad"])


def span_pieces(spans: DataFrame, spec: RasterSpec, keep: Sequence[str]) -> DataFrame:
    """Split spans at tile borders: ``(keep..., tile_col, tile_row, r, lc0, lc1)``
    with local row ``r`` and local columns ``lc0 <= c < lc1`` of that tile."""
    tw, th = spec.tile_w, spec.tile_h
    s = spans.withColumns({
        "tile_row": F.floor(F.col("py") / th).cast("int"),
        "tile_col": F.explode(F.sequence(F.floor(F.col("c0") / tw).cast("int"),
                                         F.floor((F.col("c1") - 1) / tw).cast("int"))),
    })
    return s.select(*keep, "tile_col", "tile_row",
                    (F.col("py") - F.col("tile_row") * th).cast("int").alias("r"),
                    F.greatest(F.col("c0") - F.col("tile_col") * tw, F.lit(0)).cast("int").alias("lc0"),
                    F.least(F.col("c1") - F.col("tile_col") * tw, F.lit(tw)).cast("int").alias("lc1"))


def piece_values(pieces: DataFrame, tiles: DataFrame, keep: Sequence[str],
                 tile_cols: Sequence[str] = ()) -> DataFrame:
    """Join span pieces to tiles on the tile key and cut each piece's pixel
    values out of the tile array (``vals``); ragged tiles are respected."""
    t = tiles.select("tile_col", "tile_row", "width", "height", "nodata", "data", *tile_cols)
    j = pieces.join(t, ["tile_col", "tile_row"])
    j = j.where((F.col("r") < F.col("height")) & (F.col("lc0") < F.col("width")))
    n = F.least(F.col("lc1"), F.col("width")) - F.col("lc0")
    return j.select(*keep, "tile_col", "tile_row", "r", "lc0", "nodata", *tile_cols,
                    F.slice("data", F.col("r") * F.col("width") + F.col("lc0") + 1, n).alias("vals"))


def cells_in_zones(tiles: DataFrame, zones: DataFrame, spec: RasterSpec,
                   keep: Sequence[str] | None = None) -> DataFrame:
    """Every (zone, pixel) pair with the pixel centre inside the zone,
    as ``(keep..., px, py, v, nodata)``."""
    keep = list(keep) if keep is not None else attribute_columns(zones)
    p = span_pieces(zone_spans(zones, spec, keep), spec, keep)
    v = piece_values(p, tiles, keep)
    v = v.select(*keep, "tile_col", "tile_row", "r", "lc0", "nodata", F.posexplode("vals").alias("i", "v"))
    return v.select(*keep,
                    (F.col("tile_col") * spec.tile_w + F.col("lc0") + F.col("i")).cast("int").alias("px"),
                    (F.col("tile_row") * spec.tile_h + F.col("r")).cast("int").alias("py"),
                    "v", "nodata")


# ------------------------------------------------------------ J1: tiles x zones

def _tile_rect(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    ulx, uly = F.col(prefix + "ulx"), F.col(prefix + "uly")
    x_end = ulx + F.col(prefix + "width") * F.col(prefix + "scale_x")
    y_end = uly + F.col(prefix + "height") * F.col(prefix + "scale_y")
    return F.least(ulx, x_end), F.greatest(ulx, x_end), F.least(uly, y_end), F.greatest(uly, y_end)


def segment_meets_rect(rx0: Column, rx1: Column, ry0: Column, ry1: Column) -> Column:
    """Closed segment (x1,y1)-(x2,y2) meets the closed rectangle: boxes overlap
    and the rectangle corners are not all strictly on one side of the line."""
    x1, y1, x2, y2 = F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")
    box = ((F.greatest(x1, x2) >= rx0) & (F.least(x1, x2) <= rx1)
           & (F.greatest(y1, y2) >= ry0) & (F.least(y1, y2) <= ry1))
    dx, dy = x2 - x1, y2 - y1
    sides = [dx * (cy - y1) - dy * (cx - x1) for cx, cy in ((rx0, ry0), (rx1, ry0), (rx1, ry1), (rx0, ry1))]
    all_pos = sides[0] > 0
    all_neg = sides[0] < 0
    for s in sides[1:]:
        all_pos = all_pos & (s > 0)
        all_neg = all_neg & (s < 0)
    return box & ~all_pos & ~all_neg


def tile_keys(tiles: DataFrame) -> DataFrame:
    """The tile footprint columns only; Parquet never reads the pixel column."""
    return tiles.select("rid", "tile_col", "tile_row", "ulx", "uly", "width", "height", "scale_x", "scale_y")


def edge_tile_candidates(zones: DataFrame, spec: RasterSpec, keep: Sequence[str]) -> DataFrame:
    """``(keep..., x1, y1, x2, y2, tile_col, tile_row)``: the tiles each edge may
    meet.  An edge is cut into the tile-row bands it spans; inside one band it
    covers a short run of tile columns, so candidates stay linear in its length."""
    tw, th = spec.tile_w, spec.tile_h
    e = zone_edges(check_srid(zones, spec), keep)
    gx1 = (F.col("x1") - F.lit(spec.ulx)) / F.lit(spec.scale_x)
    gx2 = (F.col("x2") - F.lit(spec.ulx)) / F.lit(spec.scale_x)
    gy1 = (F.col("y1") - F.lit(spec.uly)) / F.lit(spec.scale_y)
    gy2 = (F.col("y2") - F.lit(spec.uly)) / F.lit(spec.scale_y)
    # names of their own: column names differ by more than case
    e = e.withColumns({"_grid_x1": gx1, "_grid_x2": gx2, "_grid_y1": gy1, "_grid_y2": gy2})
    ylo, yhi = F.least("_grid_y1", "_grid_y2"), F.greatest("_grid_y1", "_grid_y2")
    r0 = F.greatest(F.floor(ylo / th) - 1, F.lit(0)).cast("int")
    r1 = F.least(F.floor(yhi / th) + 1, F.lit(spec.nty - 1)).cast("int")
    e = e.withColumns({"_r0": r0, "_r1": r1}).where(F.col("_r0") <= F.col("_r1"))
    e = e.withColumn("tile_row", F.explode(F.sequence("_r0", "_r1")))
    # x-range of the edge inside band [tile_row*th, (tile_row+1)*th]
    b0 = F.greatest(F.col("tile_row") * th, ylo)
    b1 = F.least((F.col("tile_row") + 1) * th, yhi)
    slope = (F.col("_grid_x2") - F.col("_grid_x1")) / (F.col("_grid_y2") - F.col("_grid_y1"))
    xa = F.when(F.col("_grid_y1") == F.col("_grid_y2"), F.col("_grid_x1")).otherwise(F.col("_grid_x1") + (b0 - F.col("_grid_y1")) * slope)
    xb = F.when(F.col("_grid_y1") == F.col("_grid_y2"), F.col("_grid_x2")).otherwise(F.col("_grid_x1") + (b1 - F.col("_grid_y1")) * slope)
    c0 = F.greatest(F.floor(F.least(xa, xb) / tw) - 1, F.lit(0)).cast("int")
    c1 = F.least(F.floor(F.greatest(xa, xb) / tw) + 1, F.lit(spec.ntx - 1)).cast("int")
    e = e.withColumns({"_c0": c0, "_c1": c1}).where(F.col("_c0") <= F.col("_c1"))
    e = e.withColumn("tile_col", F.explode(F.sequence("_c0", "_c1")))
    return e.select(*keep, "x1", "y1", "x2", "y2", "tile_col", "tile_row")


def edge_grid_hits(zones: DataFrame, spec: RasterSpec, keep: Sequence[str]) -> DataFrame:
    """``(keep..., tile_col, tile_row)``: grid tiles that some ring edge meets, from
    the raster header alone (no tile table is read)."""
    e = edge_tile_candidates(zones, spec, keep)
    px0, py0 = F.col("tile_col") * spec.tile_w, F.col("tile_row") * spec.tile_h
    e = e.select("*", (F.lit(spec.ulx) + px0 * F.lit(spec.scale_x)).alias("ulx"),
                 (F.lit(spec.uly) + py0 * F.lit(spec.scale_y)).alias("uly"),
                 F.lit(spec.scale_x).alias("scale_x"), F.lit(spec.scale_y).alias("scale_y"),
                 F.least(F.lit(spec.tile_w), F.lit(spec.width) - px0).alias("width"),
                 F.least(F.lit(spec.tile_h), F.lit(spec.height) - py0).alias("height"))
    return e.where(segment_meets_rect(*_tile_rect())).select(*keep, "tile_col", "tile_row").distinct()


def edge_tile_hits(tiles: DataFrame, zones: DataFrame, spec: RasterSpec,
                   keep: Sequence[str], distinct: bool = True) -> DataFrame:
    """Pairs (keep..., rid) where some ring edge meets the tile footprint:
    candidates refined by the exact segment/rectangle test."""
    cand = edge_tile_candidates(zones, spec, keep)
    j = cand.join(tile_keys(tiles), ["tile_col", "tile_row"])
    rx0, rx1, ry0, ry1 = _tile_rect()
    hits = j.where(segment_meets_rect(rx0, rx1, ry0, ry1)).select(*keep, "rid")
    return hits.distinct() if distinct else hits


def intersect_pairs(tiles: DataFrame, zones: DataFrame, spec: RasterSpec,
                    keep: Sequence[str] | None = None, how: str = "inner") -> DataFrame:
    """``(keep..., rid)`` for every zone and tile whose footprint the zone
    intersects (touching counts).  = tiles met by an edge, plus tiles holding
    a pixel centre inside the zone (which covers tiles wholly inside it).
    ``how='left'`` adds zones that meet no tile, with a null ``rid``."""
    if how not in ("inner", "left"):
        raise ValueError(how)
    keep = list(keep) if keep is not None else attribute_columns(zones)
    hits = edge_tile_hits(tiles, zones, spec, keep)
    p = span_pieces(zone_spans(zones, spec, keep), spec, keep)
    t = tiles.select("rid", "tile_col", "tile_row", "width", "height")
    inner = (p.join(t, ["tile_col", "tile_row"])
             .where((F.col("r") < F.col("height")) & (F.col("lc0") < F.col("width")))
             .select(*keep, "rid"))
    pairs = hits.unionByName(inner).distinct()
    if how == "inner":
        return pairs
    # the count reads the pairs' own shuffle again (a reused exchange), so the zones are not joined twice
    met = pairs.groupBy(*keep).agg(F.count("rid").alias("_n"))
    off = left_by(zones.select(*keep).distinct(), met, keep).where(F.col("_n").isNull())
    return pairs.unionByName(off.select(*keep, F.lit(None).cast(pairs.schema["rid"].dataType).alias("rid")))


def left_by(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left outer join on equal ``by`` columns, nulls equal to nulls; ``by`` comes from the left."""
    r = right.withColumnsRenamed({c: f"_right_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in by]
    return left.join(r, on, "left").drop(*[f"_right_{c}" for c in by])


def feature_tiles(pairs: DataFrame, tiles: DataFrame, keep: Sequence[str] = ("gid", "name")) -> DataFrame:
    """The tile ids each feature needs, as sorted id arrays per (feature,
    row of tiles).  The reference builds one list per feature; a list per band
    keeps every id but bounds each group by the tiles in one row, so a zone
    covering the whole raster never gathers all ids into one task."""
    keep = list(keep)
    p = pairs.join(tiles.select("rid", "tile_row"), "rid")
    return p.groupBy(*keep, "tile_row").agg(F.array_sort(F.collect_list("rid")).alias("ids"))
