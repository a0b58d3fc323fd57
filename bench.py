"""Benchmark of the headline analytics.

Like the reference's runs, the raster is tiled and loaded once (timed as
``load_tiles``), then every analytic reads the tile table from Parquet.
Every query runs once to warm up, then ``BENCH_RUNS`` interleaved rounds;
the median per query is reported.  Results go to Spark's ``noop`` sink, so nothing is collected.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_RUNS (default 5), BENCH_TILE (default 10),
     BENCH_LAYOUT (bucketed | rid-range, default bucketed), BENCH_BUCKETS (default 2*cpus)
prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    tile = int(os.environ.get("BENCH_TILE", "10"))

    from pyspark.sql import functions as F

    from tilespark.session import checkpoint_dir, get_spark
    from tilespark.sources import fixtures as fx
    from tilespark.sources import io
    from tilespark.sources.tiling import tile_raster, tiles_from_rows
    from tilespark.operators import algebra, clip, focal, local, zonal
    from tilespark.plans import partition as P

    spark = get_spark(f"local[{cpus}]", cpus)
    scratch = checkpoint_dir(spark)

    bucketed = os.environ.get("BENCH_LAYOUT", "bucketed") == "bucketed"
    buckets = int(os.environ.get("BENCH_BUCKETS", str(2 * cpus)))
    spec = fx.spec_a(spark, sf, tile)
    path_a = f"{scratch}/cells_a_{tile}"
    path_b = f"{scratch}/cells_b_{tile}"
    spec_b = fx.spec_b(spark, sf, tile)
    t0 = time.time()
    if bucketed:
        # tile tables bucketed on the tile key: tile-key joins and per-tile
        # aggregates need no shuffle of the tile side
        io.write_tiles_bucketed(tile_raster(fx.cells_a(spark, sf), spec), "bench_a", buckets, path_a)
        load_s = time.time() - t0
        io.write_tiles_bucketed(tile_raster(fx.cells_b(spark, sf), spec_b), "bench_b", buckets, path_b)
    else:
        io.write_tiles(tile_raster(fx.cells_a(spark, sf), spec), path_a)
        load_s = time.time() - t0
        io.write_tiles(tile_raster(fx.cells_b(spark, sf), spec_b), path_b)

    def A():
        return spark.table("bench_a") if bucketed else io.read_tiles(spark, path_a)

    def B():
        return spark.table("bench_b") if bucketed else io.read_tiles(spark, path_b)

    tracts = fx.zones_tracts(spark, sf)
    states = fx.zones_states(spark, sf)

    def q_zonal_tracts():
        return zonal.zonal_stats(A(), tracts, spec)

    def q_zonal_tracts_sql():
        return zonal.zonal_stats(A(), tracts, spec, engine="sql")

    def q_zonal_states():
        return zonal.zonal_stats(A(), states, spec, by=["statefp", "name"])

    def q_pixel_count():
        return local.pixel_count(A(), 16)

    def q_value_counts():
        return local.value_counts(A())

    def q_reclassify():
        return local.reclassify(A(), [(16, 1)], "8BUI", 0)

    def q_focal_tile():
        return focal.focal(A(), "mean", 1, 1, scope="tile")

    def q_focal_mosaic():
        return focal.focal(A(), "mean", 1, 1, scope="mosaic")

    def q_raster_square():
        a = A()
        return algebra.map_algebra(a, a, "[rast1]*[rast2]", "8BUI")

    def q_raster_multiply():
        return algebra.map_algebra(A(), B(), lambda x, y: x * y, "8BUI")

    def q_partition():
        return P.partition_raster(A(), 4)

    def q_tile_raster():
        return tile_raster(fx.cells_a(spark, sf), spec)

    # a raster of millions of pixels in large tiles, with the same zones
    big = fx.spec_large(spark, sf)
    big_rows = fx.rows_large(spark, sf)
    path_big = f"{scratch}/large"
    io.write_tiles_bucketed(tiles_from_rows(big_rows, big), "bench_large", buckets, path_big)

    def L():
        return spark.table("bench_large")

    large = {
        "large_tiles_from_rows": lambda: tiles_from_rows(big_rows, big),
        "large_zonal_stats": lambda: zonal.zonal_stats(L(), tracts, big),
        "large_zonal_by_state": lambda: zonal.zonal_stats(L(), states, big, by=["statefp", "name"]),
        "large_clip_zones": lambda: clip.clip_to_zones(L(), tracts, big, keep=["gid"]),
        "large_value_counts": lambda: local.value_counts(L()),
        "large_focal_mosaic": lambda: focal.focal(L(), "mean", 1, 1, scope="mosaic"),
        "large_multiply": lambda: algebra.map_algebra(L(), L().withColumn("rid", F.col("rid")), lambda x, y: x * y, "16BUI"),
    }

    queries = {
        "zonal_stats": q_zonal_tracts,
        "zonal_stats_sql": q_zonal_tracts_sql,
        "zonal_by_state": q_zonal_states,
        "pixel_count": q_pixel_count,
        "value_counts": q_value_counts,
        "reclassify": q_reclassify,
        "focal_mean": q_focal_tile,
        "focal_mosaic": q_focal_mosaic,
        "raster_square": q_raster_square,
        "raster_multiply": q_raster_multiply,
        "partition_raster": q_partition,
        "tile_raster": q_tile_raster,
    } | large
    only = os.environ.get("BENCH_ONLY")
    if only:
        queries = {k: v for k, v in queries.items() if k in only.split(",")}
    # One warm-up pass over every query (JIT, Python workers), then the timed
    # runs interleaved, so no query pays for start-up and drift hits all alike.
    for fn in queries.values():
        fn().write.format("noop").mode("overwrite").save()
    samples: dict[str, list[float]] = {k: [] for k in queries}
    for _ in range(runs):
        for name, fn in queries.items():
            s = time.time()
            fn().write.format("noop").mode("overwrite").save()
            samples[name].append(time.time() - s)
    times = {k: round(statistics.median(v), 3) for k, v in samples.items()}
    for k, v in times.items():
        print(f"# {k}: {v}s", file=sys.stderr, flush=True)
    n_pixels = spec.width * spec.height
    out = {
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "load_tiles_sec": round(load_s, 3),
        "pixels": n_pixels,
        "tile": tile,
        "layout": "bucketed" if bucketed else "rid-range",
        "cpus": cpus,
        "runs": runs,
        "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
