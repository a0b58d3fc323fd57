"""Skewed rasters: the six-term affine, hulls of tiles, zones moved onto the grid."""

import math
import random

import pytest
from pyspark.sql import functions as F

import catalog
from tests.conftest import SF
from tilespark.functions.affine import Affine, zones_off_grid, zones_on_grid
from tilespark.operators import hull, zonal, zones as Z
from tilespark.sources import fixtures as fx


@pytest.mark.parametrize("angle", [0, 17, 90, 133, 301])
def test_pixels_come_back(spark, angle):
    """A rotated grid of 30 m pixels: centres name their own pixel, corners are within half a pixel."""
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    a = Affine(512_000.3, 4_100_250.7, 30 * c, -30 * c, 30 * s, 30 * s)
    df = spark.range(4000).select((F.col("id") % 71).alias("c"), F.floor(F.col("id") / 71).alias("r"))
    x, y = a.world(F.col("c") + 0.5, F.col("r") + 0.5)
    col, line = a.pixel(x, y)
    gc, gr = a.grid(*a.world(F.col("c"), F.col("r")))
    bad = df.where((col != F.col("c")) | (line != F.col("r")) | (F.abs(gc - F.col("c")) > 1e-3) | (F.abs(gr - F.col("r")) > 1e-3))
    assert bad.count() == 0
    assert df.limit(1).select(*a.pixel(F.lit(None).cast("double"), F.lit(1.0))).first()[0] is None


def test_no_area(spark):
    with pytest.raises(ValueError):
        Affine(0.0, 0.0, 2.0, 2.0, 4.0, 1.0).grid(F.lit(0.0), F.lit(0.0))


def test_rotated_tile_by_hand(spark):
    """A quarter turn: columns run down, lines run left."""
    a = Affine(10.0, 20.0, 0.0, 0.0, -2.0, -3.0)
    df = spark.createDataFrame([(1, 2, 4, 5)], "px0 int, py0 int, width int, height int")
    # column c, line r stands at x = 10 - 2 r, y = 20 - 3 c
    assert df.select(a.footprint_wkt(*map(F.col, df.columns))).first()[0] == \
        "POLYGON((6.0 17.0,6.0 5.0,-4.0 5.0,-4.0 17.0,6.0 17.0))"


def test_hull_by_hand(spark):
    t = spark.createDataFrame([("a", 0, 0, 10, 10), ("a", 10, 10, 10, 10), ("a", 10, 20, 10, 5), ("b", 0, 0, 10, 10), ("b", 10, 0, 10, 10),
                               ("b", 0, 10, 10, 10), ("b", 10, 10, 10, 10), (None, 3, 4, 1, 1), (None, 3, 4, 1, 1)],
                              "zone string, px0 int, py0 int, width int, height int")
    got = {r["zone"]: [tuple(p) for p in r["hull"]] for r in hull.tile_hulls(t, ["zone"], Affine(0.0, 0.0, 1.0, 1.0)).collect()}
    assert got == {"a": [(0, 0), (10, 0), (20, 10), (20, 25), (10, 25), (0, 10)],
                   "b": [(0, 0), (20, 0), (20, 20), (0, 20)], None: [(3, 4), (4, 4), (4, 5), (3, 5)]}
    turned = hull.tile_hulls(t.where("zone = 'b'"), ["zone"], Affine(10.0, 20.0, 0.0, 0.0, -2.0, -3.0)).first()["hull"]
    assert [tuple(p) for p in turned] == [(10, 20), (10, -40), (-30, -40), (-30, 20)]
    assert hull.tile_hulls(t.limit(0), ["zone"], Affine(0.0, 0.0, 1.0, 1.0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_ring_is_the_hull(seed):
    rng = random.Random(seed)
    pts = {(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randrange(3, 40))} | {(3, 3), (4, 3), (3, 4)}
    lines = sorted({y for _, y in pts})
    got = hull.ring([(y, min(x for x, v in pts if v == y), max(x for x, v in pts if v == y)) for y in lines])

    def turn(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    assert len(got) == len(set(got)) and set(got) <= pts
    for a, b, c in zip(got, got[1:] + got[:1], got[2:] + got[:2]):
        assert turn(a, b, c) > 0 and all(turn(a, b, p) >= 0 for p in pts)


def test_zones_come_back(spark):
    _, spec = catalog.tiles_a(spark, SF)
    zones = fx.zones_tracts(spark, SF)
    far = zones_off_grid(zones, catalog.SKEWED, spec)
    back = zones_on_grid(far, catalog.SKEWED, spec)
    assert back.columns == zones.columns
    for a, f, b in zip(*(df.orderBy("gid").collect() for df in (zones, far, back))):
        assert a["gid"] == b["gid"] and a["rings"] != f["rings"]
        assert [b[c] for c in ("xmin", "xmax", "ymin", "ymax")] == pytest.approx([a[c] for c in ("xmin", "xmax", "ymin", "ymax")])
        for p, q in zip(sum(a["rings"], []), sum(b["rings"], [])):
            assert tuple(p) == pytest.approx(tuple(q))


def test_hull_plan_combines_lines_first(spark):
    t, spec = catalog.tiles_a(spark, SF)
    pairs = Z.intersect_pairs(t, fx.zones_tracts(spark, SF), spec, keep=["gid"])
    own = pairs.join(t.select("rid", "px0", "py0", "width", "height"), "rid")
    plan = hull.tile_hulls(own, ["gid"], catalog.SKEWED)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_zones_between_pixel_centres(spark):
    """A sliver that holds no pixel centre meets its tiles, in a grid whose pixels are not world units."""
    t, spec = catalog.tiles_a(spark, SF, 4)
    x, y = spec.ulx + 3.6 * spec.scale_x, spec.uly + 2.6 * spec.scale_y  # between the centres of columns 3 and 4
    rings = [[(x, y), (x + 0.7 * spec.scale_x, y), (x + 0.7 * spec.scale_x, y + 3 * spec.scale_y), (x, y + 3 * spec.scale_y), (x, y)]]
    z = spark.createDataFrame([(7, spec.srid, rings)], "gid long, srid int, rings array<array<struct<x:double,y:double>>>")
    met = {r["rid"] for r in Z.intersect_pairs(t, z, spec, keep=["gid"]).collect()}
    assert met == {r * spec.ntx + c + 1 for c in (0, 1) for r in (0, 1)}
    assert [tuple(r)[:2] for r in zonal.zonal_stats(t, z, spec, by=["gid"]).select("gid", "count").collect()] == [(7, 0)]
