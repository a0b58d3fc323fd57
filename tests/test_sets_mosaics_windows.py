"""Interval sets, zones off the raster, parts as files, nested tile sizes, mosaics, wide windows."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import catalog
from tests.conftest import SF
from tests.helpers import grid_spec, raster, rect, zones
from tilespark.operators import focal as focal_mod, intervals, local, zonal, zones as Z
from tilespark.operators.validate import validate_blocking
from tilespark.plans import partition as P
from tilespark.sources import fixtures as fx
from tilespark.sources import io
from tilespark.sources.tiling import mosaic, size_families, tile_raster, tile_raster_multi, tiles_to_cells


def final_plan(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("+- == Initial Plan ==")[0]


def exchanges(plan: str) -> int:
    """Shuffles that were run; reused ones do not count."""
    return sum(bool(re.search(r" Exchange (hash|range|Single)", line)) and "ReusedExchange" not in line for line in plan.splitlines())


# ------------------------------------------------------------ interval sets

def outlines(seed):
    r = random.Random(seed)
    out = []
    for g in range(12):
        cx, cy, n = r.uniform(-5, 65), r.uniform(-5, 65), r.randrange(3, 8)
        angles = sorted(r.uniform(0, 6.28) for _ in range(n))
        ring = [(cx + 20 * np.cos(a), cy + 20 * np.sin(a)) for a in angles]
        out.append((g, f"z{g}", [ring + ring[:1]]))
    return out + [(100, "all", [rect(-1, -1, 61, 61)]), (101, "hole", [rect(1, 1, 59, 59), rect(12, 12, 49, 49)]), (102, None, [rect(5, 5, 6, 6)]),
                  (103, "off", [rect(500, 500, 510, 510)])]


@pytest.mark.parametrize("kept", ["true", "rid % 5 <> 2", "rid IN (1, 2, 36)"])
def test_ranges_expand_to_the_pairs(spark, kept):
    t, spec = raster(spark, [[(x * y) % 7 for x in range(60)] for y in range(60)], 10)
    t = t.where(kept)
    z = zones(spark, outlines(1))
    ranges = intervals.feature_rid_ranges(t, z, spec)
    got = sorted((r["gid"], r["rid"]) for r in intervals.expand_ranges(ranges).collect())
    assert got == sorted((r["gid"], r["rid"]) for r in Z.intersect_pairs(t, z, spec, keep=["gid"]).collect())
    for r in ranges.collect():
        flat = [x for a in r["ranges"] for x in a]
        assert flat == sorted(flat) and all(b - a > 1 for a, b in zip(flat[1::2], flat[2::2]))  # none touches the next
        assert r["n_tiles"] == sum(b - a + 1 for a, b in r["ranges"])


def test_a_zone_over_everything_is_one_range(spark):
    t, spec = raster(spark, [[1] * 60 for _ in range(60)], 10)
    (r,) = intervals.feature_rid_ranges(t, zones(spark, [(1, "all", [rect(0, 0, 60, 60)])]), spec).collect()
    assert [tuple(x) for x in r["ranges"]] == [(1, 36)]
    df = spark.createDataFrame([([(1, 3), (7, 7)],)], "ranges array<struct<first:long,last:long>>")
    assert df.select(intervals.ranges_text(F.col("ranges"))).first()[0] == "1-3,7"
    assert [df.select(intervals.in_ranges(F.col("ranges"), F.lit(k))).first()[0] for k in (1, 3, 4, 7)] == [True, True, False, True]


# ------------------------------------------------------------ zones off the raster

def test_left_join_keeps_zones_off_the_raster(spark):
    t, spec = raster(spark, [[x + y for x in range(20)] for y in range(20)], 5)
    z = zones(spark, [(1, "in", [rect(2, 2, 9, 9)]), (2, "off", [rect(50, 50, 60, 60)]), (3, None, [rect(-9, -9, -5, -5)]),
                      (4, "grazes", [rect(19.8, 19.8, 30, 30)])])
    by = ["gid", "name"]
    a, b = ({r["gid"]: tuple(r) for r in zonal.zonal_stats(t, z, spec, how="left", engine=e).collect()} for e in ("numpy", "sql"))
    assert a == b and set(a) == {1, 2, 3, 4}
    assert a[2][2:] == a[3][2:] == (None,) * 6 and a[4][2] == 0 and a[1][2] == 49
    inner = {tuple(r) for r in zonal.zonal_stats(t, z, spec).collect()}
    assert inner == {a[1], a[4]}
    pairs = [tuple(r) for r in Z.intersect_pairs(t, z, spec, keep=by, how="left").collect()]
    assert sorted(p[0] for p in pairs if p[2] is None) == [2, 3]
    assert {p for p in pairs if p[2] is not None} == {tuple(r) for r in Z.intersect_pairs(t, z, spec, keep=by).collect()}
    with pytest.raises(ValueError):
        zonal.zonal_stats(t, z, spec, how="left", keep_empty=False)


def test_left_pairs_read_the_zones_join_once(spark):
    t, spec = catalog.tiles_a(spark, SF)
    plan = final_plan(Z.intersect_pairs(t, catalog._zones_on_and_off(spark, SF), spec, keep=["gid"], how="left"))
    assert "ReusedExchange" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# ------------------------------------------------------------ parts as files

@pytest.mark.parametrize("rows,n,per_file", [(100, 3, 1000), (100, 3, 7), (101, 3, 10), (5, 1, 2), (2, 4, 3), (0, 3, 5)])
def test_parts_are_files(spark, scratch, rows, n, per_file):
    df = spark.createDataFrame([(i * 7 % 101, f"r{i}") for i in range(rows)], "k long, name string")
    P.write_parts(df, n, ["k"], scratch + "/p", rows_per_file=per_file, partitions=3)
    want = {(r["k"], r["part"]) for r in P.chunk_assign(df, n, ["k"], partitions=3).collect()}
    if not rows:
        return
    back = P.read_parts(spark, scratch + "/p", per_file).withColumn("path", F.input_file_name()).collect()
    assert {(r["k"], r["part"]) for r in back} == want and len(back) == rows
    files = {}
    for r in back:
        files.setdefault(r["path"], []).append(r)
    for path, own in files.items():
        assert f"/part={own[0]['part']}/file={own[0]['file']}/" in path
        assert len({(r["part"], r["file"]) for r in own}) == 1 and len(own) <= per_file
    assert len(files) == len({(r["part"], r["file"]) for r in back})  # one file each
    for part in {r["part"] for r in back}:
        own = sorted((r for r in back if r["part"] == part), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own))) and [r["k"] for r in own] == sorted(r["k"] for r in own)


def test_a_part_is_read_alone(spark, scratch):
    P.write_parts(spark.range(50).withColumnRenamed("id", "k"), 5, ["k"], scratch + "/p", rows_per_file=4)
    q = P.read_parts(spark, scratch + "/p", 4).where("part = 2")
    assert "PartitionFilters: [isnotnull(part" in q._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["k"] for r in q.collect()) == list(range(20, 30))


def test_many_small_files_take_few_tasks(spark, scratch):
    """240 files of two rows: runs of files are written by one task, folders are listed by few."""
    path, shuffled = scratch + "/p", int(spark.conf.get("spark.sql.shuffle.partitions"))
    P.write_parts(spark.range(480).select(F.reverse(F.col("id").cast("string")).alias("k"), "id"), 3, ["id"], path, rows_per_file=2)
    key, sc = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext
    before = spark.conf.get(key)
    sc.setJobGroup(path, "reading the parts")
    try:
        back = P.read_parts(spark, path, 2)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = [i for j in sc.statusTracker().getJobIdsForGroup(path) for i in sc.statusTracker().getJobInfo(j).stageIds]
    assert stages and max(sc.statusTracker().getStageInfo(i).numTasks for i in stages) <= shuffled
    assert spark.conf.get(key) == before
    rows = back.withColumn("path", F.input_file_name()).collect()
    assert sorted((r["id"], r["part"], r["file"], r["place"]) for r in rows) == [
        (i, i // 160, i % 160 // 2, i % 160) for i in range(480)]
    assert len({r["path"] for r in rows}) == 240
    assert len({re.search(r"/part-(\d+)-", r["path"])[1] for r in rows}) <= shuffled + 1  # tasks


def test_runs_of_files_end_at_their_bounds(spark, scratch, monkeypatch):
    monkeypatch.setattr(P, "FILES_PER_TASK", 5)
    P.write_parts(spark.range(240).withColumnRenamed("id", "k"), 2, ["k"], scratch + "/f", rows_per_file=2)
    monkeypatch.setattr(P, "ROWS_PER_TASK", 6)
    P.write_parts(spark.range(240).withColumnRenamed("id", "k"), 2, ["k"], scratch + "/r", rows_per_file=2)
    for path, most in (("/f", 5), ("/r", 3)):
        rows = P.read_parts(spark, scratch + path, 2).withColumn("path", F.input_file_name()).collect()
        assert sorted((r["k"], r["part"], r["place"]) for r in rows) == [(i, i // 120, i % 120) for i in range(240)]
        by_task = {}
        for r in rows:
            by_task.setdefault(re.search(r"/part-(\d+)-", r["path"])[1], set()).add(r["path"])
        assert len(set().union(*by_task.values())) == 120 and max(map(len, by_task.values())) == most


# ------------------------------------------------------------ nested tile sizes

def test_size_families():
    assert size_families([50, 100, 200, 400]) == [(400, [400, 200, 100, 50])]
    assert size_families([10, 25, 40, 25]) == [(40, [40, 10]), (25, [25])]


def test_nested_sizes_take_two_shuffles(spark):
    cells = fx.cells_a(spark, SF)
    t = tile_raster_multi(cells, fx.spec_a(spark, SF), [5, 10, 20, 40])
    assert exchanges(final_plan(t)) == 2
    for s in (5, 10, 20, 40):
        want = sorted((r["rid"], r["width"], r["height"], r["data"]) for r in tile_raster(cells, fx.spec_a(spark, SF).with_tiles(s)).collect())
        assert sorted((r["rid"], r["width"], r["height"], r["data"]) for r in t.where(F.col("tile_size") == s).collect()) == want


def test_sizes_that_do_not_nest_and_gaps(spark):
    cells = spark.createDataFrame([(x, y, float(x + 10 * y)) for x in range(11) for y in range(9) if (x + y) % 4], "px int, py int, v double")
    spec = grid_spec(11, 9, 1, nodata=-1.0, pixel_type="32BF")
    t = tile_raster_multi(cells, spec, [2, 3, 6, 4])
    for s in (2, 3, 4, 6):
        want = sorted((r["px"], r["py"], r["v"]) for r in tiles_to_cells(tile_raster(cells, spec.with_tiles(s))).collect())
        assert sorted((r["px"], r["py"], r["v"]) for r in tiles_to_cells(t.where(F.col("tile_size") == s)).collect()) == want


# ------------------------------------------------------------ mosaics

def file_of(spark, values, tile, name, priority, x0, y0, nodata=None):
    t, _ = raster(spark, values, tile, nodata)
    return t.withColumns({"ulx": F.col("ulx") + x0, "uly": F.col("uly") + y0, "filename": F.lit(name), "priority": F.lit(priority)})


def painted(files, width, height):
    out = [[None] * width for _ in range(height)]
    for values, name, priority, x0, y0, nodata in sorted(files, key=lambda f: (f[2], f[1]), reverse=True):
        for y, row in enumerate(values):
            for x, v in enumerate(row):
                if v != nodata and 0 <= x + x0 < width and 0 <= y + y0 < height:
                    out[y + y0][x + x0] = (float(v), name)
    return out


def test_mosaic_of_overlapping_files(spark):
    r = random.Random(2)
    files = [([[r.randrange(5) for _ in range(w)] for _ in range(h)], name, p, x0, y0, nod)
             for name, p, w, h, x0, y0, nod in (("c", 1, 9, 7, 0, 0, 0), ("b", 0, 6, 6, 4, 3, 1), ("a", 1, 12, 5, -3, 5, None), ("d", 2, 3, 14, 8, -2, 2))]
    tiles = None
    for k, (v, name, p, x0, y0, nod) in enumerate(files):
        t = file_of(spark, v, 3 + k, name, p, x0, y0, nod)
        tiles = t if tiles is None else tiles.unionByName(t)
    got = mosaic(tiles, grid_spec(13, 11, 4, nodata=-9.0))
    want = painted(files, 13, 11)
    for r in tiles_to_cells(got).collect():
        assert r["v"] == (want[r["py"]][r["px"]] or (-9.0,))[0]
    order = {name: (p, name) for _, name, p, *_ in files}
    for r in got.collect():
        inside = [want[y][x] for y in range(r["py0"], r["py0"] + r["height"]) for x in range(r["px0"], r["px0"] + r["width"])]
        names = {c[1] for c in inside if c}
        assert r["filename"] == (min(names, key=order.get) if names else None)


def test_mosaic_fails_off_the_grid_and_without_nodata(spark):
    a = file_of(spark, [[1, 2], [3, 4]], 2, "a", 0, 0.5, 0)
    with pytest.raises(Exception, match="does not lie on the pixels"):
        mosaic(a, grid_spec(4, 4, 2, nodata=0.0)).collect()
    b = file_of(spark, [[1, 2], [3, 4]], 2, "b", 0, 1, 0)
    with pytest.raises(Exception, match="declares no NoData"):
        mosaic(b, grid_spec(4, 4, 2)).collect()


# ------------------------------------------------------------ wide windows

@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 13])
def test_running_results(size):
    x = np.random.default_rng(size).integers(-50, 50, (6, 13)).astype(float)
    for op, plain in ((np.add, np.sum), (np.fmin, np.min), (np.fmax, np.max)):
        for axis in (0, 1):
            n = x.shape[axis]
            if size <= n:
                want = np.stack([plain(np.take(x, range(i, i + size), axis), axis=axis) for i in range(n - size + 1)], axis=axis)
                assert (focal_mod.running(x, size, op, axis) == want).all()


@pytest.mark.parametrize("fn", ["mean", "sum", "min", "max", "count"])
@pytest.mark.parametrize("scope", ["tile", "mosaic"])
def test_wide_windows_against_a_plain_version(spark, fn, scope):
    rng = np.random.default_rng(4)
    v = rng.integers(0, 9, (17, 14)).tolist()
    t, _ = raster(spark, v, 5, nodata=0, pixel_type="64BF")
    got = {(r["px"], r["py"]): r["v"] for r in tiles_to_cells(focal_mod.focal(t, fn, 7, 6, scope=scope, edge="shrink")).collect()}
    plain = {"mean": np.mean, "sum": np.sum, "min": np.min, "max": np.max, "count": len}[fn]
    for (px, py), x in got.items():
        lo = (px // 5 * 5, py // 5 * 5) if scope == "tile" else (0, 0)
        hi = (min(lo[0] + 5, 14), min(lo[1] + 5, 17)) if scope == "tile" else (14, 17)
        win = [v[j][i] for j in range(max(lo[1], py - 6), min(hi[1], py + 7)) for i in range(max(lo[0], px - 7), min(hi[0], px + 8)) if v[j][i]]
        assert x == pytest.approx(float(plain(win)) if win else 0.0)


def test_work_does_not_grow_with_the_window():
    pad = np.random.default_rng(0).integers(0, 255, (1100, 1100)).astype(float)

    def seconds(n):
        took = []
        for _ in range(3):
            t = time.perf_counter()
            focal_mod._reduce_np(pad[:1000 + 2 * n, :1000 + 2 * n], "mean", n, n)
            took.append(time.perf_counter() - t)
        return min(took)

    assert seconds(50) < 3 * seconds(1)


def test_user_function_gets_bounded_windows(spark, monkeypatch):
    seen = []

    def f(w):
        seen.append(w.size)
        return w.max(axis=1)

    monkeypatch.setattr(focal_mod, "WINDOW_CELLS", 300)
    view = np.lib.stride_tricks.sliding_window_view(np.arange(400.0).reshape(20, 20), (3, 3))
    rows = max(1, focal_mod.WINDOW_CELLS // (18 * 9))
    out = np.concatenate([focal_mod._called(f, "vectorized", view[r:r + rows]) for r in range(0, 18, rows)])
    assert max(seen) <= 300 and (out == view.max(axis=(2, 3))).all()
    each = focal_mod._called(lambda w: float(w.max()), "python", view)
    assert (each == out).all()


# ------------------------------------------------------------ long rule tables, blocking, layout

def test_rule_tables_equal_short_rules(spark):
    t, _ = raster(spark, [[(x * 7 + y * 3) % 30 for x in range(12)] for y in range(9)], 5, nodata=4)
    rules = [(0, 3, 9), (5, 5.5, 300), (7, 2), (20, 29, -4)]
    key = lambda df: sorted((r["rid"], r["pixel_type"], r["nodata"], r["data"]) for r in df.collect())
    assert key(local.reclassify_table(t, rules[::-1], "8BUI", 1)) == key(local.reclassify(t, rules, "8BUI", 1))
    assert key(local.reclassify_table(t, [], "16BSI", -1)) == key(local.reclassify(t, [], "16BSI", -1))
    for bad in ([(0, 3, 1), (3, 4, 2)], [(5, 2, 1)], [(7, 1), (6, 8, 2)]):
        with pytest.raises(ValueError):
            local.reclassify_table(t, bad)


def test_blocking(spark):
    t, _ = raster(spark, [[1] * 23 for _ in range(17)], 5)
    told = lambda df: {r["check"]: r["n_bad"] for r in validate_blocking(df).collect()}
    assert told(t) == {"regular_blocking": 0, "extent": 0} == told(t.limit(0))
    assert told(t.where("rid <> 7")) == {"regular_blocking": 0, "extent": 1}
    assert told(t.unionByName(t.where("rid = 3"))) == {"regular_blocking": 1, "extent": 0}
    assert told(t.withColumn("px0", F.when(F.col("rid") == 7, F.col("px0") + 1).otherwise(F.col("px0")))) == {"regular_blocking": 1, "extent": 0}


def test_a_small_box_opens_few_files(spark, scratch):
    t, spec = raster(spark, [[x + y for x in range(64)] for y in range(64)], 2)
    io.write_tiles_curve(t, scratch + "/c", partitions=16)
    box = io.read_tiles_box(spark, scratch + "/c", 3, 4.5, 6.5, 6.5)
    assert len(box.inputFiles()) <= 4 < 16 <= len(spark.read.parquet(scratch + "/c/tiles").inputFiles())
    want = {r["rid"] for r in t.collect() if r["ulx"] <= 6.5 and r["ulx"] + 2 >= 3 and r["uly"] <= 6.5 and r["uly"] + 2 >= 4.5}
    assert {r["rid"] for r in box.collect()} == want
    assert io.read_tiles_box(spark, scratch + "/c", 900, 900, 901, 901).collect() == []
    keys = spark.range(64).select(F.col("id"), io.curve_key(F.col("id") % 8, F.floor(F.col("id") / 8)).alias("k")).collect()
    assert all(r["k"] == sum(((r["id"] % 8) >> b & 1) << 2 * b | ((r["id"] // 8) >> b & 1) << (2 * b + 1) for b in range(3)) for r in keys)
