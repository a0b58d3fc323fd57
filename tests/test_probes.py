"""Inputs off the fixtures' beaten track: gaps, duplicates, foreign grids, odd ids, NaN."""

import math

import pytest
from pyspark.sql import functions as F

from tests.helpers import raster, rect, zones
from tilespark.functions.arrays import let
from tilespark.model import RasterSpec
from tilespark.operators import algebra, clip
from tilespark.operators.focal import focal, focal_udf
from tilespark.operators.validate import validate_tiles
from tilespark.operators.zonal import merge_moments, zonal_stats
from tilespark.plans import partition as P
from tilespark.sources import io
from tilespark.sources.tiling import retile, tile_raster, tile_raster_multi, tiles_from_rows, tiles_to_cells


def cells(spark, rows):
    return spark.createDataFrame([(int(x), int(y), None if v is None else float(v)) for x, y, v in rows], "px int, py int, v double")


def spec(w, h, t, **kw):
    return RasterSpec(width=w, height=h, tile_w=t, tile_h=t, ulx=0.0, uly=float(h), scale_x=1.0, scale_y=-1.0, **{"srid": 0, **kw})


def grid(w, h, skip=lambda x, y: False):
    return [(x, y, 10 * y + x) for y in range(h) for x in range(w) if not skip(x, y)]


def data(df):
    return {(r["tile_col"], r["tile_row"]): r["data"] for r in df.collect()}


def fails(df, text):
    with pytest.raises(Exception, match=text):
        df.collect()


def test_tile_raster_checks_positions(spark):
    ok = spec(2, 2, 2, nodata=9.0)
    assert data(tile_raster(cells(spark, [(0, 0, 1), (1, 0, None), (1, 1, 4)]), ok)) == {(0, 0): [1.0, 9.0, 9.0, 4.0]}
    fails(tile_raster(cells(spark, [(0, 0, 1), (0, 0, 9), (0, 1, 3), (1, 1, 4)]), ok), "twice")
    fails(tile_raster(cells(spark, [(0, 0, 1)] * 2 + [(x, y, 1) for x in (0, 1) for y in (0, 1)]), ok), "twice")
    fails(tile_raster(cells(spark, [(0, 0, 1)]), spec(2, 2, 2)), "no NoData")
    fails(tile_raster(cells(spark, [(0, 0, 1), (5, 0, 1)]), ok), "outside")
    assert data(tile_raster(cells(spark, [(0, 0, 1), (5, 0, 1)]), ok, outside="drop")) == {(0, 0): [1.0, 9.0, 9.0, 9.0]}


def test_sparse_multi_and_retile_fill_gaps(spark):
    s = spec(4, 4, 2, nodata=99.0)
    c = cells(spark, grid(4, 4, lambda x, y: x < 2 and y < 2))
    multi = tile_raster_multi(c, s, [2, 4])
    whole = tile_raster(c, s.with_tiles(4))
    assert data(multi.where("tile_size = 4")) == data(whole)
    for t in (multi, retile(tile_raster(c, s), s.with_tiles(3)), whole):
        r = t.agg(F.sum(F.size("data")), F.sum(F.col("width") * F.col("height"))).first()
        assert r[0] == r[1] > 0
    out, _ = clip.clip_to_extent(tile_raster(c, s), zones(spark, [(1, "z", [rect(0, 0, 4, 4)])]), s, nodata=-1, tile=4)
    (d,) = data(out).values()
    assert len(d) == 16 and d[:2] == [-1.0, -1.0] and d[2] == 2.0


def test_tiles_from_rows_gaps(spark):
    rows = spark.createDataFrame([(0, [0.0, 1.0, 2.0, 3.0]), (2, [8.0, 9.0, 10.0, 11.0]), (3, [12.0])], "py int, values array<double>")
    t = tiles_from_rows(rows, spec(4, 4, 4, nodata=-1.0))
    assert data(t)[0, 0] == [0, 1, 2, 3, -1, -1, -1, -1, 8, 9, 10, 11, 12, -1, -1, -1]
    fails(tiles_from_rows(rows, spec(4, 4, 4)), "no NoData")
    fails(tiles_from_rows(rows.union(rows), spec(4, 4, 4, nodata=-1.0)), "twice")
    fails(tiles_from_rows(rows, spec(3, 4, 4, nodata=-1.0)), "outside")


@pytest.mark.parametrize("tile", [2, 3, 8])
def test_focal_window_wider_than_a_tile(spark, tile):
    t = tile_raster(cells(spark, [(x, y, 1) for x in range(8) for y in range(8)]), spec(8, 8, tile, pixel_type="64BF"))
    assert tiles_to_cells(focal(t, "sum", 3, 3, scope="mosaic", edge="shrink")).agg(F.sum("v")).first()[0] == 1936
    u = focal_udf(t, lambda w: float((w == 1).sum()), 3, 3, scope="mosaic", edge="shrink", vectorized=False)
    assert tiles_to_cells(u).agg(F.sum("v")).first()[0] == 1936
    if tile < 3:
        with pytest.raises(ValueError):
            focal(t, "sum", 3, 3, scope="mosaic", edge="shrink", engine="sql")


def test_focal_needs_a_nodata(spark):
    t = tile_raster(cells(spark, grid(3, 3)), spec(3, 3, 3))
    for engine in ("numpy", "sql"):
        fails(focal(t, "mean", engine=engine), "NoData")
        r = focal(t, "mean", engine=engine, pixel_type=None, nodata=-5).first()
        assert r["nodata"] == -5 and r["data"] == [-5] * 4 + [11.0] + [-5] * 4


def stats(df, by):
    n = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else x if x is None or isinstance(x, str) else round(x, 9)
    return sorted([tuple(n(r[c]) for c in (*by, "count", "sum", "mean", "stddev", "min", "max")) for r in df.collect()], key=str)


@pytest.mark.parametrize("by", [["gid", "name"], ["name"], ["gid"], ["statefp", "name"]])
@pytest.mark.parametrize("case", ["plain", "null", "nan", "nan nodata"])
def test_zonal_engines_agree(spark, by, case):
    nod = math.nan if case == "nan nodata" else 99.0
    t = tile_raster(cells(spark, grid(6, 6)), spec(6, 6, 2, nodata=nod, pixel_type="64BF"))
    odd = {"plain": None, "null": F.lit(None).cast("double"), "nan": F.lit(math.nan), "nan nodata": F.lit(math.nan)}[case]
    if odd is not None or case == "null":
        t = t.withColumn("data", F.transform("data", lambda x: F.when(x % 7 == 3, odd).otherwise(x)))
    z = zones(spark, [(1, "a", [rect(0, 0, 4, 4)]), (1, "b", [rect(1, 1, 3, 3)]), (2, "a", [rect(3, 3, 6, 6)]), (2, "a", [rect(0, 5, 1, 6)]),
                      (3, None, [rect(0.1, 0.1, 0.4, 0.4)]), (None, "c", [rect(2, 2, 5, 5)]), (4, "out", [rect(50, 50, 60, 60)])])
    s = spec(6, 6, 2)
    got = [stats(zonal_stats(t, z, s, by=by, engine=e), by) for e in ("numpy", "sql")]
    assert got[0] == got[1] and len(got[0]) >= 2


def test_zonal_two_names_and_text_ids(spark):
    t, s = tile_raster(cells(spark, grid(4, 4)), spec(4, 4, 2, nodata=99.0)), spec(4, 4, 2)
    z = zones(spark, [(1, "a", [rect(0, 0, 4, 4)]), (1, "b", [rect(1, 1, 3, 3)])]).withColumn("gid", F.lit("US1"))
    assert {r["name"]: r["count"] for r in zonal_stats(t, z, s).collect()} == {"a": 16, "b": 4}
    plan = zonal_stats(t, z, s)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") >= 1


def test_merged_moments_keep_small_deviations(spark):
    vals = [1e9 + k for k in range(16)]
    parts = [(1, 4, sum(v), sum((x - sum(v) / 4) ** 2 for x in v), min(v), max(v)) for v in (vals[k:k + 4] for k in range(0, 16, 4))]
    parts += [(1, 0, None, None, None, None), (2, 0, None, None, None, None)]
    got = {r["gid"]: r for r in merge_moments(spark.createDataFrame(parts, "gid int, n long, s double, m2 double, lo double, hi double"), ["gid"]).collect()}
    assert got[1]["stddev"] == pytest.approx(4.609772228646444) and got[1]["count"] == 16
    assert (got[2]["count"], got[2]["sum"], got[2]["stddev"]) == (0, None, None)


def test_map_algebra_wants_one_grid(spark):
    a = tile_raster(cells(spark, grid(4, 4)), spec(4, 4, 2))
    for other in (spec(4, 4, 2, srid=5070), spec(4, 4, 2).with_(ulx=100.0), spec(4, 4, 2).with_(scale_x=2.0), spec(4, 4, 3)):
        fails(algebra.map_algebra(a, tile_raster(cells(spark, grid(4, 4)), other), lambda x, y: x + y), "aligned")
    wide = tile_raster(cells(spark, grid(5, 4)), spec(5, 4, 2))  # a ragged column on one side only
    got = {(r["px"], r["py"]): r["v"] for r in tiles_to_cells(algebra.map_algebra(a, wide, "rast1 + rast2", "64BF"), keep=()).collect()}
    assert got == {(x, y): 2.0 * v for x, y, v in grid(4, 4)}


def test_clip_keeps_true_zeros(spark):
    t = tile_raster(cells(spark, [(x, y, 0) for x in range(4) for y in range(4)]), spec(4, 4, 4))
    z = zones(spark, [(1, "tri", [[(0, 0), (4, 0), (4, 4), (0, 0)]])])
    fails(clip.clip_to_zones(t, z, spec(4, 4, 4)), "no NoData")
    r = clip.clip_to_zones(t, z, spec(4, 4, 4), nodata=-1).first()
    assert r["nodata"] == -1 and r["data"].count(0.0) == 10 - 4 + 0 or r["data"].count(0.0) + r["data"].count(-1.0) == r["width"] * r["height"]
    assert 0.0 in r["data"] and -1.0 in r["data"]


def test_validation_finds_faults(spark):
    t = tile_raster(cells(spark, grid(5, 4)), spec(5, 4, 2, nodata=99.0))
    assert all(r["ok"] for r in validate_tiles(t).collect()) and all(r["ok"] for r in validate_tiles(t.limit(0)).collect())
    bad = t.withColumn("data", F.when(F.col("rid") == 1, F.slice("data", F.lit(1), F.lit(3))).when(
        F.col("rid") == 2, F.transform("data", lambda x, i: F.when(i > 0, x))).otherwise(F.col("data")))
    got = {r["check"]: r["n_bad"] for r in validate_tiles(bad).collect()}
    assert got["array_length"] == 1 and got["null_pixels"] == 1 and sum(got.values()) == 2


def test_read_zones_rejects_bad_rings(spark, scratch):
    good = zones(spark, [(1, "a", [rect(0, 0, 2, 2), rect(3, 3, 4, 4)])])
    good.write.parquet(scratch + "/good")
    assert io.read_zones(spark, scratch + "/good").count() == 1
    assert io.read_zones(spark, scratch + "/good").select("rings").first()[0]
    for rings in ([rect(0, 0, 2, 2)] * 2, [rect(0, 0, 2, 2)[:-1]], [[(0, 0), (1, 1), (0, 0)]]):
        fails(io.check_rings(zones(spark, [(1, "a", rings)])), "ring")


def test_dump_keeps_fractions(spark):
    t = tile_raster(cells(spark, [(0, 0, 0.75), (1, 0, -3), (0, 1, 1e300), (1, 1, 2.5e-7)]), spec(2, 2, 2, pixel_type="64BF"))
    back = io.parse_tile_lines(io.tile_lines(io.tile_dump_lines(t, "x"))).first()
    assert back["data"] == [0.75, -3.0, 1e300, 2.5e-7]


def test_row_index_ties(spark):
    df = spark.range(500).select(F.lit(1).alias("k"), "id").repartition(5)
    got = sorted(r["_i"] for r in P.row_index(df, ["k"]).collect())
    assert got == list(range(500))
    same = {r["id"]: r["_i"] for r in P.row_index(df, ["k"]).collect()}
    assert same == {r["id"]: r["_i"] for r in P.row_index(df.repartition(3), ["k"]).collect()}


def test_let_binds_once(spark):
    assert spark.range(1).select(let(F.lit(2), lambda x: x * x)).first()[0] == 4


def test_checkpoint_dir_of_sessions_without_a_setting():
    from types import SimpleNamespace

    from tilespark.session import checkpoint_dir

    def session(master, setting=None):
        seen = []
        sc = SimpleNamespace(master=master, applicationId=f"app-{master}-{setting}", setCheckpointDir=seen.append)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: setting), sparkContext=sc), seen

    local, seen = session("local[4]")
    assert checkpoint_dir(local) == checkpoint_dir(local) == seen[0] and len(seen) == 1
    with pytest.raises(ValueError, match="share"):
        checkpoint_dir(session("spark://host:7077")[0])
    with pytest.raises(ValueError, match="share"):
        checkpoint_dir(session("local-cluster[3,2,1024]")[0])
    assert checkpoint_dir(session("yarn", "hdfs://x/y")[0]) == "hdfs://x/y"
