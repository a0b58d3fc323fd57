import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import catalog
from tests.conftest import SF
from tests.helpers import point_in_rings, raster, rect, zones
from tilespark.operators import zones as Z
from tilespark.operators.zonal import merge_partials, zonal_partials, zonal_stats
from tilespark.plans.partition import assign_parts
from tilespark.sources import fixtures as fx

VALS = [[(x * 3 + y * 5) % 7 for x in range(12)] for y in range(10)]


def _stats(df):
    return {r["gid"]: (r["count"], r["sum"], r["min"], r["max"]) for r in df.collect()}


def _brute(vals, rings, nodata=None):
    vs = [float(vals[y][x]) for y in range(len(vals)) for x in range(len(vals[0]))
          if point_in_rings(x, y, rings) and (nodata is None or vals[y][x] != nodata)]
    return (len(vs), float(sum(vs)) if vs else None, min(vs) if vs else None, max(vs) if vs else None)


def test_hole_multipart_concave(spark):
    t, spec = raster(spark, VALS, 4)
    hole = [rect(0.2, 0.2, 7.8, 7.8), rect(2.3, 2.3, 5.7, 5.7)]
    multi = [rect(0.1, 0.1, 2.9, 2.9), rect(8.1, 6.1, 11.9, 9.9)]
    concave = [[(1, 1), (10, 1), (10, 8), (6, 8), (6, 4), (4, 4), (4, 8), (1, 8), (1, 1)]]
    z = zones(spark, [(1, "hole", hole), (2, "multi", multi), (3, "concave", concave)])
    got = _stats(zonal_stats(t, z, spec))
    for gid, rings in ((1, hole), (2, multi), (3, concave)):
        assert got[gid] == _brute(VALS, rings), gid


def test_empty_grazing_outside_and_overlap(spark):
    vals = [[9, 9, 1, 2], [9, 9, 3, 4], [5, 6, 7, 8], [1, 1, 1, 1]]
    t, spec = raster(spark, vals, 2, nodata=9.0)
    z = zones(spark, [
        (1, "nodata only", [rect(0.1, 0.1, 1.9, 1.9)]),
        (2, "sliver", [rect(2.6, 0.1, 2.9, 3.9)]),        # no pixel centre inside
        (3, "outside", [rect(10, 10, 12, 12)]),
        (4, "a", [rect(1.1, 1.1, 3.9, 3.9)]),
        (5, "b", [rect(1.1, 1.1, 3.9, 3.9)]),             # overlaps 4 completely
        (6, "corner touch", [rect(4.0, 4.0, 5.0, 5.0)]),   # touches the raster corner only
    ])
    got = _stats(zonal_stats(t, z, spec))
    assert got[1] == (0, None, None, None)
    assert got[2] == (0, None, None, None)
    assert 3 not in got
    assert got[4] == got[5] == _brute(vals, [rect(1.1, 1.1, 3.9, 3.9)], 9)
    assert got[6] == (0, None, None, None)
    dropped = _stats(zonal_stats(t, z, spec, keep_empty=False))
    assert set(dropped) == {4, 5}


def test_exact_pairs_include_slivers(spark):
    vals = [[1] * 6 for _ in range(6)]
    t, spec = raster(spark, vals, 3)
    z = zones(spark, [(1, "sliver", [rect(2.9, 0.2, 3.1, 0.4)]), (2, "inside", [rect(3.5, 3.5, 4.5, 4.5)])])
    pairs = sorted((r["gid"], r["rid"]) for r in Z.intersect_pairs(t, z, spec, ["gid"]).collect())
    assert pairs == [(1, 1), (1, 2), (2, 4)]


@settings(max_examples=8, deadline=None)
@given(st.integers(min_value=0, max_value=10_000))
def test_random_polygons_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randint(3, 7)
    ring = [(rnd.uniform(-1, 13), rnd.uniform(-1, 11)) for _ in range(n)]
    ring.append(ring[0])
    t, spec = raster(spark, VALS, rnd.choice([3, 4, 5]))
    z = zones(spark, [(1, "r", [ring])])
    got = {(r["px"], r["py"]) for r in Z.cells_in_zones(t, z, spec, ["gid"]).collect()}
    exp = {(x, y) for y in range(10) for x in range(12) if point_in_rings(x, y, [ring])}
    assert got == exp


def test_zonal_does_not_depend_on_tile_size(spark):
    z = fx.zones_tracts(spark, SF)
    res = []
    for tile in (7, 10, 100):
        spec = fx.spec_a(spark, SF, tile)
        from tilespark.sources.tiling import tile_raster
        t = tile_raster(fx.cells_a(spark, SF), spec)
        res.append(sorted(tuple(r) for r in zonal_stats(t, z, spec).select("gid", "count", "sum", "min", "max").collect()))
    assert res[0] == res[1] == res[2]


def test_merged_partials_equal_single_pass(spark):
    t, spec = catalog.tiles_a(spark, SF)
    z = fx.zones_tracts(spark, SF)
    one = {r["gid"]: (r["count"], r["sum"], r["min"], r["max"], round(r["stddev"], 9))
           for r in zonal_stats(t, z, spec, keep_empty=False).collect()}
    parts = zonal_partials(assign_parts(t, 3), z, spec)
    merged = {r["gid"]: (r["count"], r["sum"], r["min"], r["max"], round(r["stddev"], 9))
              for r in merge_partials(parts, ["gid"]).collect()}
    assert one == merged


def test_zonal_plan_has_no_cartesian(spark):
    t, spec = catalog.tiles_a(spark, SF)
    from tilespark.operators.algebra import map_algebra
    b, _ = catalog.tiles_b(spark, SF)
    for df in (zonal_stats(t, fx.zones_tracts(spark, SF), spec),
               zonal_stats(t, fx.zones_tracts(spark, SF), spec, engine="sql"),
               Z.intersect_pairs(t, fx.zones_tracts(spark, SF), spec, ["gid"]),
               Z.cells_in_zones(t, fx.zones_states(spark, SF), spec, ["gid"]),
               map_algebra(t, b, lambda x, y: x * y)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_merge_partials_skips_null_min(spark):
    p = spark.createDataFrame([(0, 1, None, None, 0, None, None), (1, 1, 2.0, 5.0, 3, 10.0, 38.0 - 100.0 / 3)],
                              "node int, gid long, min double, max double, count long, sum double, m2 double")
    (r,) = merge_partials(p, ["gid"]).collect()
    assert (r["min"], r["max"], r["count"], r["sum"]) == (2.0, 5.0, 3, 10.0)


def test_engines_agree_on_edge_cases(spark):
    vals = [[9, 9, 1, 2, 5], [9, 9, 3, 4, 6], [5, 6, 7, 8, 1], [1, 1, 1, 1, 2]]
    t, spec = raster(spark, vals, 2, nodata=9.0)
    z = zones(spark, [
        (1, "nodata only", [rect(0.1, 0.1, 1.9, 1.9)]),
        (2, "sliver", [rect(2.6, 0.1, 2.9, 3.9)]),
        (3, "outside", [rect(10, 10, 12, 12)]),
        (4, "a", [rect(1.1, 1.1, 4.9, 3.9)]),
        (5, "b", [rect(1.1, 1.1, 4.9, 3.9)]),
        (6, "hole", [rect(0.2, 0.2, 4.8, 3.8), rect(1.3, 1.3, 3.7, 2.7)]),
    ])
    for keep_empty in (True, False):
        for ex in (True, False):
            a = zonal_stats(t, z, spec, keep_empty=keep_empty, exclude_nodata=ex, engine="sql")
            b = zonal_stats(t, z, spec, keep_empty=keep_empty, exclude_nodata=ex, engine="numpy")
            cols = ["gid", "count", "sum", "min", "max", F.round("mean", 9), F.round("stddev", 9)]
            assert sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))


def test_unequal_srid_is_an_error(spark):
    import pytest
    t, spec = raster(spark, VALS, 4)
    z = zones(spark, [(1, "a", [rect(1, 1, 3, 3)])]).withColumn("srid", F.lit(3857))
    with pytest.raises(Exception, match="SRID"):
        zonal_stats(t, z, spec.with_(srid=4326)).collect()


def test_overlapping_rows_of_one_zone_count_once(spark):
    import pytest
    t, spec = raster(spark, VALS, 4)
    a, b, hole = rect(0.2, 0.2, 5.8, 5.8), rect(3.2, 2.2, 9.8, 8.8), rect(1.2, 1.2, 2.8, 2.8)
    turned = [*b[2:], *b[1:3]]
    z = zones(spark, [(1, "twice", [a, hole]), (1, "twice", [a, hole]), (2, "parts", [a]), (2, "parts", [b]),
                      (3, "turned", [b]), (3, "turned", [turned]), (4, "apart", [hole]), (4, "apart", [rect(6, 6, 8, 8)])])
    shapes = {1: ([a, hole],), 2: ([a], [b]), 3: ([b],), 4: ([hole], [rect(6, 6, 8, 8)])}
    for engine in ("numpy", "sql"):
        got = _stats(zonal_stats(t, z, spec, engine=engine))
        for gid, rows in shapes.items():
            vs = [float(VALS[y][x]) for y in range(10) for x in range(12) if any(point_in_rings(x, y, r) for r in rows)]
            assert got[gid] == (len(vs), sum(vs), min(vs), max(vs)), gid
        for rings in ([a, b], [b, turned], [b, b[::-1]]):
            with pytest.raises(Exception, match="ring"):
                zonal_stats(t, zones(spark, [(1, "x", rings)]), spec, engine=engine).collect()
