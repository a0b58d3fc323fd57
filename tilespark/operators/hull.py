"""F6 over many tiles: the convex hull of the tiles of each group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilespark.functions.affine import Affine
from tilespark.session import bound_arrow_batches, ship_by_value


def chain(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The right-turning chain (lines run downward) over points sorted from its first to its last."""
    out: list[tuple[int, int]] = []
    for x, y in points:
        while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-1][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-1][0]):
            out.pop()
        if not out or out[-1] != (x, y):
            out.append((x, y))
    return out


def ring(sides: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Hull of (line, least column, greatest column) in line order: clockwise from the upper left, not closed."""
    (top, left, _), (_, _, right) = sides[0], sides[-1]
    down = chain([(left, top)] + [(hi, y) for y, _, hi in sides])
    up = chain([(right, sides[-1][0])] + [(lo, y) for y, lo, _ in reversed(sides)])
    return down[:-1] + up[:-1]


def tile_hulls(tiles: DataFrame, by: Sequence[str], affine: Affine) -> DataFrame:
    """``(by..., hull)``: world points of the convex hull of each group's tiles, clockwise in the grid from the
    upper left; ``hull`` is not closed and holds no point between two others on a side.

    An affine maps hulls to hulls, so the hull is found among whole pixel numbers, exactly, and skew only
    moves its points.  Of a line of corners only the outermost two can be on it: tiles meet in a combined
    minimum and maximum per group and line, and one row per group holds two numbers for each line."""
    by = list(by)
    ship_by_value("tilespark.operators.hull")
    bound_arrow_batches(tiles.sparkSession)
    lines = (tiles.select(*by, "px0", (F.col("px0") + F.col("width")).alias("_to"),
                          F.explode(F.array("py0", F.col("py0") + F.col("height"))).alias("_line"))
             .groupBy(*by, "_line").agg(F.min("px0").alias("_lo"), F.max("_to").alias("_hi")))
    cast = [F.col(c).cast("long").alias(n) for c, n in (("_line", "y"), ("_lo", "lo"), ("_hi", "hi"))]
    rows = lines.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*cast))).alias("_sides"))
    point = T.StructType([T.StructField("c", T.LongType()), T.StructField("r", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = b.column(len(by)).to_pylist()
            hulls = [[{"c": c, "r": r} for c, r in ring([(s["y"], s["lo"], s["hi"]) for s in own])] for own in sides]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(by))),
                                              pa.array(hulls, pa.list_(pa.struct([("c", pa.int64()), ("r", pa.int64())])))], [*by, "_hull"])

    found = rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in by), T.StructField("_hull", T.ArrayType(point))]))

    def moved(p):
        x, y = affine.world(p["c"], p["r"])
        return F.struct(x.alias("x"), y.alias("y"))

    return found.select(*by, F.transform("_hull", moved).alias("hull"))
