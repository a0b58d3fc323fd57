"""Scalar pixel functions: pixel-type clamping (F10) and two-raster cell
expressions (F9, X2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilespark.model import PIXEL_RANGES

CellExpr = Callable[[Column, Column], Column]


def clamp_to_type(v: Column, pixel_type: str | None, keep_null: bool = True) -> Column:
    """force a value into a pixel type: clamp to its range, and for
    integer types truncate toward zero (as a C cast does).

    ``greatest``/``least`` skip nulls, so a null (no value) would come out as
    the range bound; with ``keep_null`` it stays null.  Pass
    ``keep_null=False`` only for inputs that cannot be null (saves evaluating
    ``v`` twice inside lambdas)."""
    if pixel_type == "32BF":
        return v.cast("float").cast("double")
    rng = PIXEL_RANGES.get(pixel_type) if pixel_type else None
    if rng is None:
        return v
    lo, hi = rng
    # clamp, then truncate toward zero by a cast
    c = F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi))).cast("long").cast("double")
    return F.when(v.isNotNull(), c) if keep_null else c


def clamp_to_type_col(v: Column, pixel_type: Column) -> Column:
    """F10 with the pixel type taken from a column (one plan for any type)."""
    ranges = F.create_map(*[x for k, r in PIXEL_RANGES.items() if r is not None
                            for x in (F.lit(k), F.struct(F.lit(float(r[0])).alias("lo"),
                                                         F.lit(float(r[1])).alias("hi")))])
    lohi = F.element_at(ranges, pixel_type)
    as_int = F.least(F.greatest(v, lohi["lo"]), lohi["hi"]).cast("long").cast("double")
    as_float = F.when(pixel_type == "32BF", v.cast("float").cast("double")).otherwise(v)
    # null stays null (greatest/least would turn it into a bound)
    return F.when(v.isNull(), F.lit(None).cast("double")).when(lohi.isNull(), as_float).otherwise(as_int)


def zip_cells(a: str, b: str, expr: str | CellExpr, finish: Callable[[Column, Column, Column], Column] | None = None) -> Column:
    """Apply a cell expression pairwise to two equal-length array
    columns.  ``expr`` is a Python function of two Columns, or Spark SQL text
    over ``rast1``/``rast2`` (``[rast1]`` accepted), parsed by Spark itself.
    ``finish(x, y, result)`` makes the cell's final value."""
    if callable(expr):
        return F.zip_with(a, b, lambda x, y: finish(x, y, expr(x, y)) if finish else expr(x, y))
    body = expr.replace("[rast1]", "rast1").replace("[rast2]", "rast2")
    if not finish:
        return F.expr(f"zip_with(`{a}`, `{b}`, (rast1, rast2) -> {body})")
    cells = F.expr(f"zip_with(`{a}`, `{b}`, (rast1, rast2) -> struct(rast1 as x, rast2 as y, {body} as r))")
    return F.transform(cells, lambda c: finish(c["x"], c["y"], c["r"]))
