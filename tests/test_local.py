from pyspark.sql import functions as F

from tests.helpers import raster
from tilespark.functions.pixels import clamp_to_type
from tilespark.operators import local
from tilespark.operators.zonal import tile_summary


def test_pixel_count_semantics(spark):
    t, _ = raster(spark, [[1, 2, 2], [9, 2, 9]], 2, nodata=9.0)
    assert [tuple(r) for r in local.pixel_count(t, 2).collect()] == [(2.0, 3)]
    assert local.pixel_count(t, 7).count() == 0      # absent class: no row
    assert local.pixel_count(t, 9).count() == 0      # NoData never counts


def test_value_counts_excludes_nodata(spark):
    t, _ = raster(spark, [[1, 2, 2, 9]], 4, nodata=9.0)
    got = sorted(tuple(r) for r in local.value_counts(t).collect())
    assert got == [(1, 1.0, 1), (1, 2.0, 2)]


def test_reclassify_unmatched_and_nodata(spark):
    t, _ = raster(spark, [[16, 3, 255, 16]], 4, nodata=255.0)
    (r,) = local.reclassify(t, [(16, 1)], "8BUI", 0).collect()
    assert r["data"] == [1.0, 0.0, 0.0, 1.0] and r["nodata"] == 0.0 and r["pixel_type"] == "8BUI"


def test_reclassify_identity(spark):
    vals = [[x for x in range(10)]]
    t, _ = raster(spark, vals, 5)
    out = local.reclassify(t, [(v, v) for v in range(10)], "8BUI", 255)
    assert sorted(map(tuple, out.select("rid", "data").collect())) == sorted(map(tuple, t.select("rid", "data").collect()))


def test_clamp(spark):
    df = spark.createDataFrame([(300.0,), (-5.0,), (2.7,), (-2.7,), (255.9,)], "v double")
    b = [r[0] for r in df.select(clamp_to_type(F.col("v"), "8BUI")).collect()]
    s = [r[0] for r in df.select(clamp_to_type(F.col("v"), "16BSI")).collect()]
    assert b == [255.0, 0.0, 2.0, 0.0, 255.0]
    assert s == [300.0, -5.0, 2.0, -2.0, 255.0]


def test_remap_nodata(spark):
    t, _ = raster(spark, [[255, 1]], 2, nodata=None)
    (r,) = local.remap_nodata(t, 255, -999).collect()
    assert r["data"] == [-999.0, 1.0] and r["nodata"] == -999.0


def test_tile_summary(spark):
    t, _ = raster(spark, [[1, 3, 9, 9]], 4, nodata=9.0)
    (r,) = tile_summary(t).collect()
    assert (r["count"], r["sum"], r["mean"], r["stddev"], r["min"], r["max"]) == (2, 4.0, 2.0, 1.0, 1.0, 3.0)
    t2, _ = raster(spark, [[9, 9]], 2, nodata=9.0)
    (r2,) = tile_summary(t2).collect()
    assert r2["count"] == 0 and r2["mean"] is None and r2["min"] is None


def test_pixel_count_plan_has_no_generate(spark):
    t, _ = raster(spark, [[1, 2]], 2)
    plan = local.pixel_count(t, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_value_counts_on_bucketed_tiles_needs_no_shuffle(spark, scratch):
    from tilespark.sources import io
    import catalog
    from tests.conftest import SF
    t, _ = catalog.tiles_a(spark, SF)
    tb = io.write_tiles_bucketed(t, "t_vc", 4, scratch + "/vc")
    vc = local.value_counts(tb)
    assert "Exchange" not in vc._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, vc.collect())) == sorted(map(tuple, local.value_counts(t).collect()))
