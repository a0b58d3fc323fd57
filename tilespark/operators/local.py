"""Local (per-tile) operators: value counts (A3), pixel count (A4), NoData
remap (P9), reclassify (P10, P11), NoData exclusion (P4), rid / IN filters
(P1, P2).

All work on the tile array with higher-order functions, so a tile is never
exploded unless the result is per value; the only shuffles are the final
(small) aggregates.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions.pixels import clamp_to_type


def rid_range(tiles: DataFrame, lo: int, hi: int) -> DataFrame:
    """Tiles with ``lo <= rid <= hi``; pushed to the Parquet scan."""
    return tiles.where(F.col("rid").between(lo, hi))


def in_lists(df: DataFrame, **lists: Iterable) -> DataFrame:
    """``col IN (...)`` for each keyword list (``rid=[..], name=[..]``)."""
    cond = F.lit(True)
    for c, values in lists.items():
        cond = cond & F.col(c).isin(list(values))
    return df.where(cond)


def exclude_nodata(tiles: DataFrame) -> DataFrame:
    """P4 on arrays: drop NoData pixels from each tile's value list
    (``vals``); for per-cell frames use ``valid_value``."""
    nod = F.col("nodata")
    return tiles.withColumn("vals", F.filter("data", lambda x: nod.isNull() | (x != nod)))


def value_counts(tiles: DataFrame, exclude_nodata: bool = True) -> DataFrame:
    """A3: ``(rid, value, count)`` histogram of every tile; NoData excluded.
    A tile lives in one task, so the partial aggregate already holds the final
    counts.  Grouping also on the tile key lets a table bucketed on
    ``(tile_col, tile_row)`` satisfy the distribution: then nothing is
    shuffled; otherwise only (rid, value, count) rows are."""
    nod = F.col("nodata")
    arr = F.filter("data", lambda x: nod.isNull() | (x != nod)) if exclude_nodata else F.col("data")
    c = tiles.select("tile_col", "tile_row", "rid", F.explode(arr).alias("value"))
    g = c.groupBy("tile_col", "tile_row", "rid", "value").agg(F.count(F.lit(1)).alias("count"))
    return g.select("rid", "value", "count")


def pixel_count(tiles: DataFrame, value: float, by: Sequence[str] = ()) -> DataFrame:
    """A4: ``(by..., value, count)`` of pixels equal to ``value`` over the raster
    (or per group of tiles, such as their part).
    Counted per tile with ``size(filter(..))`` (no explode); NoData never
    counts, and a value that never occurs gives no row."""
    v = F.lit(float(value))
    nod = F.col("nodata")
    per_tile = F.when(nod.isNull() | (nod != v), F.size(F.filter("data", lambda x: x == v))).otherwise(0)
    out = tiles.groupBy(*by).agg(F.sum(per_tile.cast("long")).alias("count"))
    return out.where(F.col("count") > 0).select(*by, v.alias("value"), "count")


def remap_nodata(tiles: DataFrame, src: float = -999.0, dst: float = -999.0) -> DataFrame:
    """Pixels equal to ``src`` become ``dst`` and ``dst`` is declared NoData."""
    s, d = F.lit(float(src)), F.lit(float(dst))
    return tiles.withColumns({
        "data": F.transform("data", lambda x: F.when(x == s, d).otherwise(x)),
        "nodata": d,
    })


Rule = tuple  # (old, new) or (lo, hi, new), bounds inclusive


def reclass_expression(x: Column, rules: Sequence[Rule], nodata_out: Column,
                       nodata_in: Column) -> Column:
    expr = None
    for r in rules:
        if len(r) == 2:
            cond, new = x == F.lit(float(r[0])), r[1]
        else:
            cond, new = (x >= F.lit(float(r[0]))) & (x <= F.lit(float(r[1]))), r[2]
        expr = F.when(cond, F.lit(float(new))) if expr is None else expr.when(cond, F.lit(float(new)))
    is_nd = nodata_in.isNotNull() & (x == nodata_in)
    return F.when(is_nd, nodata_out).otherwise(expr.otherwise(nodata_out) if expr is not None else nodata_out)


def reclassify(tiles: DataFrame, rules: Sequence[Rule], pixel_type: str = "8BUI",
               nodata: float = 0.0) -> DataFrame:
    """P10: map values by ``rules`` into a new pixel type; values matched by no
    rule and input NoData become ``nodata``, which is declared on the result."""
    nd = F.lit(float(nodata))
    # data first: it reads the input's NoData before the new one is declared
    out = tiles.withColumn("data", F.transform("data", lambda x: clamp_to_type(
        reclass_expression(x, rules, nd, F.col("nodata")), pixel_type, keep_null=False)))
    return out.withColumn("pixel_type", F.lit(pixel_type)).withColumn("nodata", nd)


def sorted_rules(rules: Sequence[Rule]) -> tuple[list[float], list[float], list[float]]:
    """Bounds and new values of (old, new) and (lo, hi, new) rules by their lower bound; rules that overlap, or
    whose bounds are turned round, raise."""
    full = sorted((float(r[0]), float(r[-2]), float(r[-1])) for r in rules)
    for lo, hi, _ in full:
        if not lo <= hi:
            raise ValueError(f"a rule ends before it begins: {lo} to {hi}")
    for a, b in zip(full, full[1:]):
        if b[0] <= a[1]:
            raise ValueError(f"rules overlap: {a[0]} to {a[1]} and {b[0]} to {b[1]}")
    return [r[0] for r in full], [r[1] for r in full], [r[2] for r in full]


def reclassify_table(tiles: DataFrame, rules: Sequence[Rule], pixel_type: str = "8BUI", nodata: float = 0.0) -> DataFrame:
    """P10 for long rule tables: the result of ``reclassify`` for rules that do not overlap (others raise).

    The rules' sorted bounds go to the tasks (three numbers a rule), and every pixel is found among
    them by binary search, so ten thousand rules cost little more than ten.  Null pixels stay null.
    """
    from tilespark.session import bound_arrow_batches, ship_by_value

    lo, hi, new = sorted_rules(rules)
    bound_arrow_batches(tiles.sparkSession)
    ship_by_value(__name__)
    schema = tiles.select("data").schema
    names = tiles.columns

    def run(batches):
        import numpy as np
        import pyarrow as pa
        first, last, value = (np.array(x) for x in (lo, hi, new))
        for b in batches:
            lists = b.column("data")
            offsets = lists.offsets.to_numpy()
            flat = lists.flatten()
            x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
            own = b.column("nodata")
            void = np.repeat(own.fill_null(np.nan).to_numpy(zero_copy_only=False), np.diff(offsets))
            out = np.full(len(x), float(nodata))
            if len(first):
                k = np.clip(np.searchsorted(first, x, "right") - 1, 0, None)
                ok = (x >= first[k]) & (x <= last[k]) & (x != void)
                out[ok] = value[k[ok]]
            gone = flat.is_null().to_numpy(zero_copy_only=False)
            data = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(out, pa.float64(), mask=gone))
            yield pa.RecordBatch.from_arrays([data if c == "data" else b.column(c) for c in names], names)

    out = tiles.mapInArrow(run, tiles.schema)
    kept = F.transform("data", lambda v: clamp_to_type(v, pixel_type, keep_null=True))
    return out.withColumns({"data": kept.cast(schema["data"].dataType), "pixel_type": F.lit(pixel_type), "nodata": F.lit(float(nodata))})


def reclass_rids(tiles: DataFrame, rules: Sequence[Rule], lo: int | None = None,
                 hi: int | None = None) -> DataFrame:
    """The reference's reclassify query selects only ``rid``; the reclass
    expression is pruned by the optimizer, the rid filter reaches the scan."""
    t = reclassify(tiles, rules)
    if lo is not None:
        t = rid_range(t, lo, hi)
    return t.select("rid")
