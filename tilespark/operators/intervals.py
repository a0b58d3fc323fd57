"""Interval sets of tile ids (J5): all tiles that a zone meets as a few ranges.

Tiles are numbered row by row, so the tiles of a zone in one row of tiles are
one or a few runs of ids.  Runs come from the zone's spans and edges as
intervals; a tile inside a zone is never listed on its own, so the work grows with a
zone's outline and its rows, not with its area.  The tile table is an interval set
too (its runs per row of tiles), and the two are intersected row by row: a table
with holes gives the ids it has.  Runs that touch across rows become one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.model import RasterSpec
from tilespark.operators.zones import edge_grid_hits, zone_spans

RANGES = "array<struct<first:bigint,last:bigint>>"


def united(first: Column, last: Column) -> Column:
    """The union of closed integer intervals, given by the sorted arrays of
    their ends, as an array of ``(first, last)``; intervals that touch are one.
    The k-th start begins a new one when the k intervals before it have ended."""
    n = F.size(first)
    fresh = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == 0) | (F.get(last, k - 1) + 1 < F.get(first, k)))
    return F.when(n == 0, F.array().cast(RANGES)).otherwise(F.transform(fresh, lambda k, i: F.struct(
        F.get(first, k).alias("first"), F.get(last, F.coalesce(F.get(fresh, i + 1), n) - 1).alias("last"))))


def with_ranges(runs: DataFrame, by: Sequence[str], name: str = "ranges") -> DataFrame:
    """``(by..., name)`` from rows ``(by..., first, last)``: one row per group with its united
    intervals.  What is gathered is a group's runs, not its members."""
    g = runs.groupBy(*by).agg(F.array_sort(F.collect_list("first")).alias("_first"), F.array_sort(F.collect_list("last")).alias("_last"))
    return g.select(*by, united(F.col("_first"), F.col("_last")).alias(name))


def zone_runs(zones: DataFrame, spec: RasterSpec, keep: Sequence[str]) -> DataFrame:
    """``(keep..., tile_row, first, last)``: runs of tile columns that a zone meets."""
    spans = zone_spans(zones, spec, keep).select(
        *keep, F.floor(F.col("py") / spec.tile_h).cast("int").alias("tile_row"),
        F.floor(F.col("c0") / spec.tile_w).cast("long").alias("first"), F.floor((F.col("c1") - 1) / spec.tile_w).cast("long").alias("last"))
    col = F.col("tile_col").cast("long")
    edges = edge_grid_hits(zones, spec, keep).select(*keep, "tile_row", col.alias("first"), col.alias("last"))
    runs = with_ranges(spans.unionByName(edges), [*keep, "tile_row"])
    return runs.select(*keep, "tile_row", F.inline("ranges"))


def table_runs(tiles: DataFrame) -> DataFrame:
    """``(tile_row, shift, first, last)``: runs of tile columns of a table whose ids are the column plus ``shift``."""
    col = F.col("tile_col").cast("long")
    t = tiles.select("tile_row", (F.col("rid") - col).alias("shift"), col.alias("first"), col.alias("last"))
    return with_ranges(t, ["tile_row", "shift"]).select("tile_row", "shift", F.inline("ranges"))


def feature_rid_ranges(tiles: DataFrame, zones: DataFrame, spec: RasterSpec, keep: Sequence[str] = ("gid", "name")) -> DataFrame:
    """``(keep..., ranges, n_tiles)``: one row per zone with every tile id it needs, as
    ascending ranges ``(first, last)``, none touching the next; expanded they are J1's pairs.

    A row holds a few ranges per row of tiles at most, whatever the zone's area.
    Zones that meet no tile of the table give no row.
    """
    keep = list(keep)
    z = zone_runs(zones, spec, keep)
    t = table_runs(tiles).select("tile_row", "shift", F.col("first").alias("_a"), F.col("last").alias("_b"))
    both = z.join(t, "tile_row").where((F.col("first") <= F.col("_b")) & (F.col("_a") <= F.col("last")))
    ids = both.select(*keep, (F.greatest("first", "_a") + F.col("shift")).alias("first"), (F.least("last", "_b") + F.col("shift")).alias("last"))
    n = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    return with_ranges(ids, keep).withColumn("n_tiles", n)


def expand_ranges(ranges: DataFrame, keep: Sequence[str] = ("gid", "name")) -> DataFrame:
    """``(keep..., rid)`` from rows with ``ranges``."""
    return (ranges.select(*keep, F.inline("ranges"))
            .select(*keep, F.explode(F.sequence("first", "last")).alias("rid")))


def in_ranges(ranges: Column, rid: Column) -> Column:
    """Whether an id is in the ranges."""
    return F.exists(ranges, lambda r: (rid >= r["first"]) & (rid <= r["last"]))


def ranges_text(ranges: Column) -> Column:
    """``1-4,7,9-12``."""
    def one(r):
        return F.when(r["first"] == r["last"], r["first"].cast("string")).otherwise(F.concat(
            r["first"].cast("string"), F.lit("-"), r["last"].cast("string")))

    return F.array_join(F.transform(ranges, one), ",")
