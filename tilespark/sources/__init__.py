from tilespark.sources.tiling import (
    tile_raster, tile_raster_multi, tiles_to_cells, tiles_from_rows, assign_rid,
)
from tilespark.sources.io import read_tiles, read_zones, write_tiles

__all__ = [
    "tile_raster", "tile_raster_multi", "tiles_to_cells", "tiles_from_rows", "assign_rid",
    "read_tiles", "read_zones", "write_tiles",
]
