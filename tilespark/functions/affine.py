"""Six-term affine between pixels and the world, for rotated and skewed rasters."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.model import RasterSpec


class Affine(NamedTuple):
    """``x = ulx + col * scale_x + line * skew_x``, ``y = uly + col * skew_y + line * scale_y``."""
    ulx: float
    uly: float
    scale_x: float
    scale_y: float
    skew_x: float = 0.0
    skew_y: float = 0.0

    @staticmethod
    def of(spec: RasterSpec) -> "Affine":
        """A header's grid, which has no skew."""
        return Affine(spec.ulx, spec.uly, spec.scale_x, spec.scale_y)

    def world(self, col: Column, line: Column) -> tuple[Column, Column]:
        """F2: world coordinates of a place in the grid; whole numbers are upper-left corners, ``+ 0.5`` a pixel's centre."""
        return (F.lit(self.ulx) + col * F.lit(self.scale_x) + line * F.lit(self.skew_x),
                F.lit(self.uly) + col * F.lit(self.skew_y) + line * F.lit(self.scale_y))

    def grid(self, x: Column, y: Column) -> tuple[Column, Column]:
        """The inverse: the place in the grid, with fractions, of world coordinates."""
        det = self.scale_x * self.scale_y - self.skew_x * self.skew_y
        if not det:
            raise ValueError("the pixel has no area, so world coordinates name no pixel")
        dx, dy = x - F.lit(self.ulx), y - F.lit(self.uly)
        return ((F.lit(self.scale_y) * dx - F.lit(self.skew_x) * dy) / F.lit(det),
                (F.lit(self.scale_x) * dy - F.lit(self.skew_y) * dx) / F.lit(det))

    def pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(pixel column, line) of world coordinates, truncated toward zero."""
        col, line = self.grid(x, y)
        return col.cast("int"), line.cast("int")

    def footprint_wkt(self, px0: Column, py0: Column, width: Column, height: Column) -> Column:
        """a tile's corners as a WKT polygon (upper left, upper right, lower right, lower left, upper left).
        An affine keeps a rectangle convex, so this is the tile's convex hull."""
        corners = [(px0, py0), (px0 + width, py0), (px0 + width, py0 + height), (px0, py0 + height), (px0, py0)]
        points = [F.concat_ws(" ", *(v.cast("string") for v in self.world(c, r))) for c, r in corners]
        return F.concat(F.lit("POLYGON(("), F.concat_ws(",", *points), F.lit("))"))


def _moved(zones: DataFrame, move) -> DataFrame:
    """``zones`` with every ring point moved, and the boxes of the moved rings."""
    def point(p: Column) -> Column:
        x, y = move(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    out = zones.withColumn("rings", F.transform("rings", lambda ring: F.transform(ring, point)))
    boxes = {"min": F.array_min, "max": F.array_max}
    return out.withColumns({f"{c}{name}": least(F.transform(F.flatten("rings"), lambda p: p.getField(c)))  # noqa: B023
                            for c in ("x", "y") for name, least in boxes.items() if f"{c}{name}" in zones.columns})


def zones_on_grid(zones: DataFrame, affine: Affine, spec: RasterSpec) -> DataFrame:
    """Zones in the world of a skewed raster, moved to where ``spec`` (the same pixels without skew) has them.

    An affine keeps what is inside a ring inside, so every zone operator then works on a skewed raster's
    tiles as they are: the zones, which are few, move, and no pixel does."""
    own = Affine.of(spec)
    return _moved(zones, lambda x, y: own.world(*affine.grid(x, y)))


def zones_off_grid(zones: DataFrame, affine: Affine, spec: RasterSpec) -> DataFrame:
    """The inverse of ``zones_on_grid``."""
    own = Affine.of(spec)
    return _moved(zones, lambda x, y: affine.world(*own.grid(x, y)))
