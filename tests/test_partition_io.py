from pyspark.sql import functions as F

import catalog
from tests.conftest import SF
from tests.helpers import raster
from tilespark.plans import partition as P
from tilespark.sources import io
from tilespark.streaming.tiles import run_tile_stream
from tilespark.operators import local


def test_partition_ranges_cover_and_keep_bands(spark):
    t, _ = catalog.tiles_a(spark, "/root/testdata/sf0.01")
    parts = sorted(tuple(r) for r in P.partition_raster(t, 4).collect())
    assert [p[0] for p in parts] == [0, 1, 2, 3]
    rids = sorted(r["rid"] for r in t.select("rid").collect())
    covered = sorted(x for _, lo, hi in parts for x in rids if lo <= x <= hi)
    assert covered == rids
    bands = {r["tile_row"]: r["part"] for r in P.band_parts(t, 4).collect()}
    for _, lo, hi in parts:
        assert lo % 10 == 1 and hi % 10 == 0          # whole rows of tiles


def test_ntile_equals_array_split(spark):
    import numpy as np
    for n_rows, n in ((10, 3), (17, 4), (5, 5), (23, 12)):
        df = spark.createDataFrame([(i, i * 10 + 1, i * 10 + 10) for i in range(n_rows)],
                                   "tile_row int, min_rid long, max_rid long")
        split = np.array_split(np.arange(n_rows), n)
        exp = [k for k, chunk in enumerate(split) for _ in chunk]
        tiles = df.select("tile_row", F.col("min_rid").alias("rid"))
        parts = {r["tile_row"]: r["part"] for r in P.band_parts(tiles, n).collect()}
        assert [parts[i] for i in range(n_rows)] == exp


def test_chunk_assign_examples(spark):
    for n_rec, n, exp in ((7, 3, [0, 0, 1, 1, 2, 2, 0]), (3, 5, [0, 1, 2]), (4, 1, [0, 0, 0, 0])):
        df = spark.createDataFrame([(i,) for i in range(n_rec)], "k long")
        got = [r["part"] for r in P.chunk_assign(df, n, ["k"], partitions=3).orderBy("k").collect()]
        assert got == exp


def test_first_ids(spark):
    t, _ = catalog.tiles_a(spark, SF)
    (r,) = P.first_ids(t, 4, 8).collect()
    assert r["ids"] == [4, 5, 6, 7, 8]


def test_write_read_and_rid_pruning(spark, scratch):
    t, _ = catalog.tiles_a(spark, "/root/testdata/sf0.01")
    io.write_tiles(t, scratch + "/t", partitions=4)
    back = io.read_tiles(spark, scratch + "/t")
    q = local.rid_range(back, 21, 40)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(rid), GreaterThanOrEqual(rid,21), LessThanOrEqual(rid,40)]" in plan
    assert q.count() == 20


def test_csv_and_head(spark, scratch):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "gid long, name string")
    io.write_csv(df, scratch + "/csv")
    back = spark.read.option("header", True).csv(scratch + "/csv")
    assert back.columns == ["gid", "name"] and back.count() == 2
    assert [r["gid"] for r in io.head(df, 1).collect()] == [1]


def test_stream_reclassify(spark, scratch):
    t, _ = raster(spark, [[16, 3], [16, 255]], 2, nodata=255.0)
    src = scratch + "/in"
    t.write.parquet(src)
    q = run_tile_stream(spark, src, scratch + "/out", scratch + "/ckpt",
                        lambda s: local.reclassify(s, [(16, 1)]), t.schema)
    q.awaitTermination(120)
    (r,) = spark.read.parquet(scratch + "/out").collect()
    assert r["data"] == [1.0, 0.0, 1.0, 0.0]


def test_analyze_catalog_table(spark, scratch):
    t, _ = raster(spark, [[1, 2], [3, 4]], 1)
    io.write_tiles_bucketed(t, "t_analyze", 2, scratch + "/ta")
    io.analyze(spark, "t_analyze")
    stats = spark.sql("DESCRIBE TABLE EXTENDED t_analyze").where("col_name = 'Statistics'").collect()
    assert stats and "4 rows" in stats[0]["data_type"]
