"""Zonal summary statistics (A1, A2), per-tile summaries (X3) and the merge
of partial results (A5).

Plan of ``zonal_stats``: zone rings -> scanline spans -> spans cut at tile
borders -> equi-join with the tile table on ``(tile_col, tile_row)``, read
once -> moments of every zone, combined inside each task -> one merge per
zone.  The span side is small next to the pixels; AQE turns the join into a
broadcast when its measured size allows, and one huge zone is spread over all
tiles it covers because the join key is the tile, not the zone.  What reaches
a zone's merge is one row per task, however many tiles or edges the zone has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.model import RasterSpec
from tilespark.operators.zones import (
    edge_grid_hits, edge_tile_hits, left_by, piece_values, span_pieces, zone_spans,
)

STAT_COLUMNS = ["count", "sum", "mean", "stddev", "min", "max"]


def valid_value(v: Column, nodata: Column, exclude_nodata: bool = True) -> Column:
    """``v`` when it counts, else null (NoData excluded when asked)."""
    if not exclude_nodata:
        return v
    return F.when(nodata.isNull() | (v != nodata), v)


def summary_aggs(v: Column) -> list[Column]:
    """count, sum, mean, population stddev, min, max of non-null ``v``;
    sum/mean/stddev/min/max are null when nothing counts."""
    return [
        F.count(v).alias("count"),
        F.sum(v).alias("sum"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("stddev"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    ]


def zonal_stats(tiles: DataFrame, zones: DataFrame, spec: RasterSpec,
                by: Sequence[str] = ("gid", "name"), exclude_nodata: bool = True,
                keep_empty: bool = True, engine: str = "numpy", how: str = "inner") -> DataFrame:
    """A1/A2: summary statistics of the pixels whose centre lies in each zone.

    Zones that meet the raster but hold no counted pixel give ``count = 0``
    and nulls (``keep_empty``); zones away from the raster give no row, as an
    inner join does.  ``keep_empty=False`` drops the count-0 rows.  With
    ``how='left'`` zones away from the raster stay too, all their statistics null,
    the count as well (so they differ from zones that meet it).

    A zone is what ``by`` names: rows that differ in a ``by`` column are zones
    of their own, rows equal in ``gid`` and ``by`` are parts of one zone.  Any
    column types do.  Null pixels never count; NaN pixels count as Spark's
    aggregates count them, unless NaN is the declared NoData.

    ``engine='numpy'`` (default) cuts the pieces out of the tiles where they are
    joined and reduces them in ``mapInArrow``; a task combines the moments of all its
    pieces and Spark merges the tasks' rows exactly (Chan's pairwise formula).
    ``engine='sql'`` explodes each piece inside the join stage and aggregates
    in codegen.  Same statistics; at small tiles the engines are alike in
    speed, the numpy engine gains with pixels per tile.
    """
    by = list(by)
    if how not in ("inner", "left") or how == "left" and not keep_empty:
        raise ValueError("how is 'inner' or 'left'; a left join keeps empty zones")
    if engine == "numpy":
        return _zonal_numpy(tiles, zones, spec, by, exclude_nodata, keep_empty, how)
    keep = list(dict.fromkeys(["gid", *by]))
    pieces = span_pieces(zone_spans(zones, spec, keep), spec, keep)
    vals = piece_values(pieces, tiles, keep)
    cells = vals.select(*by, "nodata", F.explode("vals").alias("v"))
    if keep_empty:
        # Zones that only graze tiles (no pixel centre inside) still pair with
        # them: one null-valued row each joins the same aggregation (every
        # statistic skips nulls), so no second pass and no anti-join.
        grazing = edge_tile_hits(tiles, zones, spec, keep, distinct=False).select(*by).distinct()
        cells = cells.unionByName(grazing.select(*by, F.lit(None).cast("double").alias("nodata"),
                                                 F.lit(None).cast("double").alias("v")))
    v = valid_value(F.col("v"), F.col("nodata"), exclude_nodata)
    stats = cells.groupBy(*by).agg(*summary_aggs(v))
    if how == "left":
        return left_by(zones.select(*by).distinct(), stats, by)
    return stats if keep_empty else stats.where(F.col("count") > 0)


def tile_summary(tiles: DataFrame, exclude_nodata: bool = True) -> DataFrame:
    """Per-tile summary statistics computed on the tile array with
    higher-order functions (no explode, no shuffle)."""
    nod = F.col("nodata")
    kept = F.filter("data", lambda x: nod.isNull() | (x != nod)) if exclude_nodata else F.col("data")
    t = tiles.select("rid", kept.alias("_v"))
    n = F.size("_v")
    s = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x)
    t2 = t.withColumn("_n", n).withColumn("_s", s)
    mean = F.col("_s") / F.col("_n")
    ss = F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return t2.select(
        "rid", F.col("_n").cast("long").alias("count"),
        F.when(F.col("_n") > 0, F.col("_s")).alias("sum"),
        F.when(F.col("_n") > 0, mean).alias("mean"),
        F.when(F.col("_n") > 0, F.sqrt(ss / F.col("_n"))).alias("stddev"),
        F.array_min("_v").alias("min"), F.array_max("_v").alias("max"))


def zonal_partials(tiles: DataFrame, zones: DataFrame, spec: RasterSpec,
                   by: Sequence[str] = ("gid", "name")) -> DataFrame:
    """Partial zonal results per part (the per-node results of the
    reference): ``(part, by..., min, max, count, sum, m2)``, ``m2`` being the sum
    of squared differences from the part's own mean.  ``tiles`` carry a ``part``
    column (``plans.partition.assign_parts``)."""
    by = list(by)
    keep = list(dict.fromkeys(["gid", *by]))
    pieces = span_pieces(zone_spans(zones, spec, keep), spec, keep)
    vals = piece_values(pieces, tiles, keep, tile_cols=["part"])
    cells = vals.select("part", *keep, "nodata", F.explode("vals").alias("v"))
    v = valid_value(F.col("v"), F.col("nodata"))
    return cells.groupBy("part", *by).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count"),
        F.sum(v).alias("sum"), (F.var_pop(v) * F.count(v)).alias("m2"))


def merge_partials(partials: DataFrame, by: Sequence[str] = ("gid",)) -> DataFrame:
    """A5: merge partial zonal results.  Null-skipping min/max, summed counts;
    when ``sum``/``m2`` are present mean and stddev merge too, without squaring
    raw values.  Partials of a zone are one row per part: bounded."""
    by = list(by)
    if "m2" not in partials.columns:
        return partials.groupBy(*by).agg(F.min("min").alias("min"), F.max("max").alias("max"), F.sum("count").alias("count"))
    return merge_moments(partials.select(*by, F.col("count").alias("n"), F.col("sum").alias("s"), "m2",
                                         F.col("min").alias("lo"), F.col("max").alias("hi")), by)


def merge_moments(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Merge partial moments ``(n, s, m2, lo, hi)`` per group, pair by pair:
    ``m2 = m2_a + m2_b + (mean_a - mean_b)^2 * n_a * n_b / (n_a + n_b)``.  One
    shuffle on ``by``; a group is one row per task or part that saw it."""
    by = list(by)

    def pair(a, x):
        n = a["n"] + x["n"]
        gap = a["s"] / a["n"] - x["s"] / x["n"]
        m2 = a["m2"] + x["m2"] + gap * gap * (a["n"].cast("double") * x["n"] / n)
        return F.struct(n.alias("n"), (a["s"] + x["s"]).alias("s"), m2.alias("m2"))

    one = F.struct("n", F.col("s").cast("double").alias("s"), F.col("m2").cast("double").alias("m2"))
    g = parts.groupBy(*by).agg(F.collect_list(F.when(F.col("n") > 0, one)).alias("_all"),
                               F.min("lo").alias("min"), F.max("hi").alias("max"))
    total = F.aggregate("_all", F.lit(None).cast("struct<n:bigint,s:double,m2:double>"),
                        lambda a, x: F.when(a.isNull(), x).otherwise(pair(a, x)))
    g = g.select(*by, total.alias("_t"), "min", "max")
    n = F.coalesce(F.col("_t.n"), F.lit(0).cast("long"))
    return g.select(*by, n.alias("count"), F.col("_t.s").alias("sum"), (F.col("_t.s") / F.col("_t.n")).alias("mean"),
                    F.sqrt(F.col("_t.m2") / F.col("_t.n")).alias("stddev"), "min", "max")


# ------------------------------------------------------------ numpy engine

MOMENTS = "_zone long, n long, s double, m2 double, lo double, hi double"
#: Zones that a task holds before it passes their moments on, and pixels it looks at together.
ZONES_HELD, PIXELS_AT_ONCE = 100_000, 1 << 20


def _zonal_numpy(tiles: DataFrame, zones: DataFrame, spec: RasterSpec, by: list[str],
                 exclude_nodata: bool, keep_empty: bool, how: str = "inner") -> DataFrame:
    from tilespark.session import bound_arrow_batches, ship_by_value
    bound_arrow_batches(tiles.sparkSession)
    # a number for each zone; nulls are told apart from missing columns
    zone = F.xxhash64(*[x for c in by for x in (F.col(c), F.col(c).isNull())])
    z = zones.withColumn("_zone", zone)
    pieces = span_pieces(zone_spans(z, spec, list(dict.fromkeys(["gid", "_zone"]))), spec, ["_zone"])
    if keep_empty:
        # tiles that a zone's edge only touches: no pixels, but the zone meets the raster
        graze = edge_grid_hits(z, spec, ["_zone"])
        none = F.lit(0)
        pieces = pieces.unionByName(graze.select("_zone", "tile_col", "tile_row", F.lit(-1).alias("r"), none.alias("lc0"), none.alias("lc1")))
    t = tiles.select("tile_col", "tile_row", "width", "height", "nodata", "data")
    j = pieces.join(t, ["tile_col", "tile_row"]).where((F.col("r") < F.col("height")) & (F.col("lc0") < F.col("width")))
    # a row carries its own pixels and no tile, so the pieces of a tile that very many zones share can be split over tasks
    stretch = F.slice("data", F.col("r") * F.col("width") + F.col("lc0") + 1, F.least(F.col("lc1"), F.col("width")) - F.col("lc0"))
    cut = j.select("_zone", "nodata", F.when(F.col("r") >= 0, stretch).otherwise(F.array().cast("array<double>")).alias("vals"))
    ship_by_value(__name__)

    def run(batches):
        import pyarrow as pa
        held: dict[int, tuple] = {}

        def passed_on():
            cols = [list(held), *zip(*held.values())]
            types = [pa.int64(), pa.int64()] + [pa.float64()] * 4
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["_zone", "n", "s", "m2", "lo", "hi"])

        for group in _gathered(batches):
            for k, *x in zip(*(c.tolist() for c in _moments(group, exclude_nodata))):
                held[k] = _merged(held[k], x) if k in held else _merged((0, 0.0, 0.0, None, None), x)
            if len(held) > ZONES_HELD:
                yield passed_on()
        if held:
            yield passed_on()

    merged = merge_moments(cut.mapInArrow(run, MOMENTS), ["_zone"])
    names = z.select("_zone", *by).distinct()
    out = names.join(merged, "_zone", how).select(*by, *STAT_COLUMNS)
    return out if keep_empty else out.where(F.col("count") > 0)


def _merged(a, x):
    """Moments (n, s, m2, lo, hi) of two sets of pixels; lo and hi follow Spark,
    where NaN is above all numbers."""
    n, s, m2, lo, hi = x
    if not n:
        return a
    if not a[0]:
        return n, s, m2, lo, hi
    gap = a[1] / a[0] - s / n
    low = lo if a[3] != a[3] else a[3] if lo != lo else min(a[3], lo)
    high = hi if hi != hi or a[4] != a[4] and hi != hi else a[4] if a[4] != a[4] else max(a[4], hi)
    return a[0] + n, a[1] + s, a[2] + m2 + gap * gap * a[0] * n / (a[0] + n), low, high


def _gathered(batches):
    """Arrow batches put together until they hold PIXELS_AT_ONCE pixels, as one each."""
    import pyarrow as pa
    group, pixels = [], 0
    for b in batches:
        group.append(b)
        pixels += len(b.column("vals").flatten())
        if pixels >= PIXELS_AT_ONCE:
            yield pa.Table.from_batches(group).combine_chunks().to_batches()[0]
            group, pixels = [], 0
    if sum(b.num_rows for b in group):
        yield pa.Table.from_batches(group).combine_chunks().to_batches()[0]


def _moments(b, exclude_nodata):
    """Pieces (zone, NoData, pixels) -> arrays (zone, n, s, m2, lo, hi), one entry per zone; a zone without a
    counted pixel has n = 0."""
    import numpy as np
    zone = b.column("_zone").to_numpy(zero_copy_only=False)
    nod_col = b.column("nodata")
    nod_null = nod_col.is_null().to_numpy(zero_copy_only=False)
    nods = nod_col.fill_null(0.0).to_numpy(zero_copy_only=False)
    lists = b.column("vals")
    lens = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    vals = flat.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    keep = ~flat.is_null().to_numpy(zero_copy_only=False)
    if exclude_nodata:
        nod = np.repeat(nods, lens)
        keep &= np.repeat(nod_null, lens) | ~((vals == nod) | np.isnan(vals) & np.isnan(nod))
    zs, inv = np.unique(zone, return_inverse=True)
    inv, vals = np.repeat(inv, lens)[keep], vals[keep]
    n = np.bincount(inv, minlength=zs.size)
    s = np.bincount(inv, weights=vals, minlength=zs.size)
    m2 = np.bincount(inv, weights=(vals - (s / np.maximum(n, 1))[inv]) ** 2, minlength=zs.size)
    lo, hi = np.full(zs.size, np.nan), np.full(zs.size, -np.inf)
    np.fmin.at(lo, inv, vals)
    np.maximum.at(hi, inv, vals)
    return zs, n, s, m2, lo, hi
