"""Coordinate and text functions (F1-F8, F12-F15) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def world_to_pixel(x: Column, y: Column, ulx: float, uly: float, scale_x: float,
                   scale_y: float | None = None) -> tuple[Column, Column]:
    """world -> (pixel column, line), truncated toward zero like ``int()``.
    The reference divides both axes by the x size; with ``scale_y`` given the
    row uses ``abs(scale_y)`` (equal for square pixels)."""
    sy = abs(scale_y) if scale_y is not None else scale_x
    col = ((x - F.lit(ulx)) / F.lit(scale_x)).cast("int")
    line = ((F.lit(uly) - y) / F.lit(sy)).cast("int")
    return col, line


def pixel_to_world(col: Column, line: Column, ulx: float, uly: float, scale_x: float,
                   scale_y: float | None = None) -> tuple[Column, Column]:
    """pixel corner (upper-left) -> world coordinates."""
    sy = abs(scale_y) if scale_y is not None else scale_x
    return F.lit(ulx) + col * F.lit(scale_x), F.lit(uly) - line * F.lit(sy)


def window_size(a: Column, b: Column) -> Column:
    """``abs(int(b - a))`` pixels between two pixel indexes."""
    return F.abs((b - a).cast("int"))


def snap_to_pixel(x: Column, y: Column, ulx: float, uly: float, scale_x: float,
                  scale_y: float | None = None) -> tuple[Column, Column]:
    """snap a coordinate to the upper-left corner of its pixel."""
    c, r = world_to_pixel(x, y, ulx, uly, scale_x, scale_y)
    return pixel_to_world(c, r, ulx, uly, scale_x, scale_y)


def ids_text(ids: Column) -> Column:
    """id array as comma text (the reference strips braces from array text)."""
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")


def first_id(ids: Column) -> Column:
    """``a[1]`` (1-based)."""
    return F.element_at(ids, 1)


def last_id(ids: Column) -> Column:
    """``a[array_length(a, 1)]``."""
    return F.element_at(ids, -1)


def id_slice(ids: Column, lo: int, hi: int) -> Column:
    """F8: ``a[lo:hi]``, inclusive and 1-based, clipped to the array."""
    return F.slice(ids, lo, hi - lo + 1)


def footprint_wkt(ulx: Column, uly: Column, width: Column, height: Column,
                  scale_x: Column, scale_y: Column) -> Column:
    """tile footprint polygon as WKT (corners UL, UR, LR, LL, UL)."""
    x2 = ulx + width * scale_x
    y2 = uly + height * scale_y
    def pt(x, y):
        return F.concat_ws(" ", x.cast("string"), y.cast("string"))
    return F.concat(F.lit("POLYGON(("), F.concat_ws(",", pt(ulx, uly), pt(x2, uly), pt(x2, y2),
                                                    pt(ulx, y2), pt(ulx, uly)), F.lit("))"))


def band_y_text(wkt: Column) -> Column:
    """``split_part(split_part(wkt, ',', 1), ' ', 2)``: the y text of the
    footprint's first vertex, which the reference uses as a band key."""
    return F.split_part(F.split_part(wkt, F.lit(","), F.lit(1)), F.lit(" "), F.lit(2))


def dataset_of(table_name: Column) -> Column:
    """everything before the last ``_``."""
    return F.regexp_extract(table_name, r"^(.*)_([^_]+)$", 1)


def tilesize_of(table_name: Column) -> Column:
    """the part after the last ``_``."""
    return F.regexp_extract(table_name, r"^(.*)_([^_]+)$", 2)


def class_of(dataset: Column, classes: dict[str, int]) -> Column:
    """target class by substring of the dataset name (first match wins)."""
    e = None
    for k, v in classes.items():
        cond = dataset.contains(k)
        e = F.when(cond, F.lit(v)) if e is None else e.when(cond, F.lit(v))
    return e


def table_name(dataset: Column, tile_size: Column) -> Column:
    """``"%s_%s" % (dataset, tile_size)``."""
    return F.concat_ws("_", dataset, tile_size.cast("string"))
