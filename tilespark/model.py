"""Data model: the raster header (``RasterSpec``) and the column layouts of
the tile, cell, zone, edge and span tables.

TILE  rid, filename, srid, tile_col, tile_row, px0, py0, ulx, uly, scale_x,
      scale_y, width, height, pixel_type, nodata, data ARRAY<DOUBLE> (row-major)
CELL  px, py, v                      (global pixel index, value)
ZONE  gid, name, statefp, srid, rings ARRAY<ARRAY<STRUCT<x,y>>>, xmin..ymax
EDGE  gid, name, x1, y1, x2, y2      (one row per ring segment)
SPAN  gid, name, py, c0, c1          (pixels c0 <= px < c1 of row py are inside)
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

TILE_COLUMNS = [
    "rid", "filename", "srid", "tile_col", "tile_row", "px0", "py0", "ulx", "uly",
    "scale_x", "scale_y", "width", "height", "pixel_type", "nodata", "data",
]

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RINGS = T.ArrayType(T.ArrayType(POINT))

# PostGIS pixel type names and their value ranges (inclusive).
PIXEL_RANGES = {
    "1BB": (0, 1),
    "2BUI": (0, 3),
    "4BUI": (0, 15),
    "8BSI": (-128, 127),
    "8BUI": (0, 255),
    "16BSI": (-32768, 32767),
    "16BUI": (0, 65535),
    "32BSI": (-2147483648, 2147483647),
    "32BUI": (0, 4294967295),
    "32BF": None,
    "64BF": None,
}


@dataclass(frozen=True)
class RasterSpec:
    """Raster header: the grid every tile of one raster is cut from.

    ``width``/``height`` are the raster size in pixels, ``tile_w``/``tile_h``
    the block size; ``ulx, uly, scale_x, scale_y`` the geotransform without
    rotation (``scale_y`` negative for north-up rasters).
    """

    width: int
    height: int
    tile_w: int = 10
    tile_h: int = 10
    ulx: float = -180.0
    uly: float = 90.0
    scale_x: float = 0.25
    scale_y: float = -0.25
    srid: int = 4326
    pixel_type: str = "8BUI"
    nodata: float | None = None

    @property
    def ntx(self) -> int:
        return -(-self.width // self.tile_w)

    @property
    def nty(self) -> int:
        return -(-self.height // self.tile_h)

    def with_tiles(self, tile_w: int, tile_h: int | None = None) -> "RasterSpec":
        return replace(self, tile_w=tile_w, tile_h=tile_h or tile_w)

    def with_(self, **kw) -> "RasterSpec":
        return replace(self, **kw)
