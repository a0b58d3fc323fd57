from pyspark.sql import functions as F

from tests.helpers import grid_spec, raster
from tilespark.sources.tiling import tile_raster, tiles_to_cells, tiles_from_rows, tile_raster_multi
from tilespark.operators.validate import validate_tiles


def test_ragged_tiles_and_rids(spark):
    vals = [[x + 10 * y for x in range(5)] for y in range(3)]
    t, spec = raster(spark, vals, 2)
    rows = {r["rid"]: r for r in t.collect()}
    # 3 tile columns x 2 tile rows, row-major 1-based ids
    assert sorted(rows) == [1, 2, 3, 4, 5, 6]
    assert (rows[3]["width"], rows[3]["height"]) == (1, 2)
    assert (rows[6]["width"], rows[6]["height"]) == (1, 1)
    assert rows[1]["data"] == [0.0, 1.0, 10.0, 11.0]
    assert rows[4]["data"] == [20.0, 21.0]


def test_tiles_to_cells_round_trip(spark):
    vals = [[(x * 7 + y * 3) % 11 for x in range(13)] for y in range(9)]
    t, spec = raster(spark, vals, 4)
    cells = {(r["px"], r["py"]): r["v"] for r in tiles_to_cells(t).collect()}
    assert cells == {(x, y): float(vals[y][x]) for y in range(9) for x in range(13)}
    again = tile_raster(tiles_to_cells(t, keep=()), spec)
    assert sorted(map(tuple, again.select("rid", "data").collect())) == sorted(map(tuple, t.select("rid", "data").collect()))


def test_missing_cells_filled_with_nodata(spark):
    spec = grid_spec(3, 2, 3, nodata=9.0)
    cells = spark.createDataFrame([(0, 0, 1.0), (2, 1, 5.0)], "px int, py int, v double")
    (row,) = tile_raster(cells, spec).collect()
    assert row["data"] == [1.0, 9.0, 9.0, 9.0, 9.0, 5.0]


def test_rows_and_cells_give_same_tiles(spark):
    vals = [[float(x * y % 7) for x in range(11)] for y in range(6)]
    t, spec = raster(spark, vals, 4)
    rows = spark.createDataFrame([(y, vals[y]) for y in range(6)], "py int, values array<double>")
    t2 = tiles_from_rows(rows, spec)
    a = sorted(map(tuple, t.select("rid", "width", "height", "data").collect()))
    b = sorted(map(tuple, t2.select("rid", "width", "height", "data").collect()))
    assert a == b


def test_multi_size(spark):
    vals = [[x for x in range(10)] for _ in range(10)]
    cells = spark.createDataFrame([(x, y, float(vals[y][x])) for y in range(10) for x in range(10)],
                                  "px int, py int, v double")
    t = tile_raster_multi(cells, grid_spec(10, 10, 1), [3, 5])
    counts = {r["tile_size"]: r["n"] for r in t.groupBy("tile_size").agg(F.count("*").alias("n")).collect()}
    assert counts == {3: 16, 5: 4}
    assert {r["table_name"] for r in t.select("table_name").distinct().collect()} == {"raster_3", "raster_5"}


def test_validate_detects_bad_tiles(spark):
    vals = [[1] * 8 for _ in range(8)]
    t, _ = raster(spark, vals, 4)
    ok = {r["check"]: r["ok"] for r in validate_tiles(t).collect()}
    assert all(ok.values())
    bad = t.withColumn("srid", F.when(F.col("rid") == 2, 3857).otherwise(F.col("srid"))) \
           .withColumn("ulx", F.when(F.col("rid") == 3, F.col("ulx") + 0.5).otherwise(F.col("ulx"))) \
           .withColumn("nodata", F.when(F.col("rid") == 4, F.lit(0.0)).otherwise(F.col("nodata")))
    res = {r["check"]: r["ok"] for r in validate_tiles(bad).collect()}
    assert not res["srid"] and not res["same_alignment"] and not res["nodata_values"]
    assert res["scale_x"] and res["blocksize_x"]


def test_retile_equals_direct_tiling(spark):
    from tilespark.sources.tiling import retile
    vals = [[(x * 7 + y * 13) % 17 for x in range(23)] for y in range(19)]
    t4, spec = raster(spark, vals, 4)
    t7, spec7 = raster(spark, vals, 7)
    got = sorted(map(tuple, retile(t4, spec7).select("rid", "width", "height", "data").collect()))
    exp = sorted(map(tuple, t7.select("rid", "width", "height", "data").collect()))
    assert got == exp
    # a window with an offset: destination pixel (x, y) = source (x + 3, y + 2)
    win = grid_spec(15, 11, 5)
    sub = [row[3:18] for row in vals[2:13]]
    t5, _ = raster(spark, sub, 5)
    got = sorted(map(tuple, retile(t4, win, dx=3, dy=2).select("rid", "data").collect()))
    assert got == sorted(map(tuple, t5.select("rid", "data").collect()))
