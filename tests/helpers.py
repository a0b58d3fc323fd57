"""Small hand-made rasters and zones for unit tests."""

from tilespark.model import RasterSpec
from tilespark.sources.fixtures import with_bbox
from tilespark.sources.tiling import tile_raster

UNIT = dict(ulx=0.0, uly=0.0, scale_x=1.0, scale_y=1.0, srid=0)


def grid_spec(width, height, tile, nodata=None, pixel_type="8BUI"):
    """A grid where world = pixel coordinates (y down, pixel centres at .5)."""
    return RasterSpec(width=width, height=height, tile_w=tile, tile_h=tile, nodata=nodata,
                      pixel_type=pixel_type, **UNIT)


def raster(spark, values, tile, nodata=None, pixel_type="8BUI"):
    """Tiles of a raster given as a list of rows."""
    h, w = len(values), len(values[0])
    cells = spark.createDataFrame([(x, y, float(values[y][x])) for y in range(h) for x in range(w)],
                                  "px int, py int, v double")
    spec = grid_spec(w, h, tile, nodata, pixel_type)
    return tile_raster(cells, spec), spec


def zones(spark, rows):
    """rows: (gid, name, [ring, ...]) with rings as [(x, y), ...] (closed)."""
    data = [(g, n, 0, 0, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings])
            for g, n, rings in rows]
    df = spark.createDataFrame(
        data, "gid long, name string, statefp int, srid int, rings array<array<struct<x:double,y:double>>>")
    return with_bbox(df)


def point_in_rings(px, py, rings):
    """Even-odd test of the pixel centre, half-open crossings."""
    xc, yc = px + 0.5, py + 0.5
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:]):
            if (y1 > yc) != (y2 > yc):
                x = x1 + (yc - y1) * (x2 - x1) / (y2 - y1)
                if x > xc:
                    inside = not inside
    return inside


def rect(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
