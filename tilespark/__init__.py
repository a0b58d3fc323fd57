"""tilespark: tiled-raster and zonal analytics as Spark DataFrame operators."""

from tilespark.model import RasterSpec
from tilespark.session import get_spark, checkpoint_dir

__all__ = ["RasterSpec", "get_spark", "checkpoint_dir"]
