import numpy as np
from pyspark.sql import functions as F

import catalog
from tests.conftest import SF
from tests.helpers import raster
from tilespark.operators import algebra
from tilespark.operators.focal import focal, focal_udf
from tilespark.sources import fixtures as fx
from tilespark.sources.tiling import tile_raster, tiles_to_cells


def _cells(t):
    return {(r["px"], r["py"]): r["v"] for r in tiles_to_cells(t, keep=()).collect()}


def test_focal_tile_scope_by_hand(spark):
    vals = [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12], [13, 14, 15, 255]]
    t, _ = raster(spark, vals, 4, nodata=255.0)
    c = _cells(focal(t, "mean", 1, 1, scope="tile"))
    assert c[(1, 1)] == 6.0            # mean of 1..11 window = 6
    assert c[(2, 2)] == 10.0           # (6+7+8+10+11+12+14+15)/8 = 10.375 -> 10 (NoData ignored)
    assert c[(0, 0)] == 255.0 and c[(3, 1)] == 255.0   # border: no full window


def test_focal_tile_vs_mosaic(spark):
    vals = [[(x * 7 + y) % 13 for x in range(9)] for y in range(7)]
    t3, _ = raster(spark, vals, 3)
    t9, _ = raster(spark, vals, 9)
    m3 = _cells(focal(t3, "sum", 1, 1, scope="mosaic", pixel_type=None, nodata=-1))
    m9 = _cells(focal(t9, "sum", 1, 1, scope="mosaic", pixel_type=None, nodata=-1))
    assert m3 == m9                       # mosaic does not depend on tiling
    s9 = _cells(focal(t9, "sum", 1, 1, scope="tile", pixel_type=None, nodata=-1))
    assert m3 == s9                       # one tile = the whole raster


def test_focal_shrink_edges(spark):
    vals = [[1, 1], [1, 1]]
    t, _ = raster(spark, vals, 2)
    c = _cells(focal(t, "count", 1, 1, scope="mosaic", edge="shrink", pixel_type=None))
    assert set(c.values()) == {4.0}


def test_focal_udf_per_window_matches_builtin(spark):
    vals = [[(x * 5 + y * 3) % 11 for x in range(8)] for y in range(6)]
    t, _ = raster(spark, vals, 4)
    a = _cells(focal(t, "max", 1, 1, scope="mosaic", pixel_type=None, nodata=-1))
    b = _cells(focal_udf(t, lambda w: float(np.nanmax(w)), 1, 1, scope="mosaic", nodata=-1, vectorized=False))
    assert a == b


def test_map_algebra_nodata_and_clamp(spark):
    a, _ = raster(spark, [[16, 255, 3, 4]], 4, nodata=255.0)
    b, _ = raster(spark, [[16, 2, 300, 1]], 4)
    (r,) = algebra.map_algebra(a, b, "[rast1]*[rast2]", "8BUI").collect()
    assert r["data"] == [255.0, 255.0, 255.0, 4.0] and r["nodata"] == 255.0


def test_map_algebra_intersection_extent(spark):
    a, _ = raster(spark, [[1, 2, 3], [4, 5, 6], [7, 8, 9]], 2)
    b, _ = raster(spark, [[1, 1, 1], [1, 1, 1]], 2)
    out = _cells(algebra.map_algebra(a, b, lambda x, y: x + y, "8BUI"))
    assert out == {(x, y): float(1 + x + 3 * y + 1) for x in range(3) for y in range(2)}


def test_tile_pairs_no_cartesian(spark):
    a, sa = catalog.tiles_a(spark, SF, 10)
    b, sb = catalog.tiles_b(spark, SF, 25)
    plan = algebra.tile_pairs(a, b, sa, sb)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def _exchanges_under_join(plan: str) -> int:
    return plan.count("Exchange hashpartitioning(tile_col")


def test_bucketed_tiles_avoid_shuffles(spark, scratch):
    from tilespark.sources import io
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        a, sa = catalog.tiles_a(spark, SF)
        b, _ = catalog.tiles_b(spark, SF)
        ta = io.write_tiles_bucketed(a, "t_a", 4, scratch + "/ta")
        tb = io.write_tiles_bucketed(b, "t_b", 4, scratch + "/tb")
        m = algebra.map_algebra(ta, tb, lambda x, y: x * y)
        plan = m._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan                       # both sides bucketed on the key
        got = sorted(map(tuple, tiles_to_cells(m, keep=()).collect()))
        ref = sorted(map(tuple, tiles_to_cells(algebra.map_algebra(a, b, lambda x, y: x * y), keep=()).collect()))
        assert got == ref
        f = focal(ta, "mean", 1, 1, scope="mosaic", engine="sql")
        fplan = f._jdf.queryExecution().executedPlan().toString()
        # only the strip side is shuffled onto the tile table's buckets
        assert _exchanges_under_join(fplan) == 1
        assert _cells(f) == _cells(focal(a, "mean", 1, 1, scope="mosaic", engine="sql"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_all_nodata_window_is_nodata(spark):
    vals = [[255, 255, 255, 1], [255, 255, 255, 2], [255, 255, 255, 3], [4, 5, 6, 7]]
    t, _ = raster(spark, vals, 4, nodata=255.0)
    for engine in ("numpy", "sql"):
        c = _cells(focal(t, "mean", 1, 1, scope="tile", engine=engine))
        assert c[(1, 1)] == 255.0, engine          # every window cell is NoData
        assert c[(2, 2)] == 4.0, engine            # (1+2+3+5+6+7)/6 = 4 (counted cells only)
