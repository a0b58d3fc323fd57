"""Registered queries over the driver's tables and their DuckDB oracle SQL.

Each entry of ``QUERIES`` takes ``(spark, sf_dir)`` and returns a DataFrame;
``ORACLE`` holds the SQL that DuckDB runs over the same tables.  Derived
doubles are rounded to 6 places on both sides, arrays are compared as text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle_sql as O
from tilespark.functions import coords as C
from tilespark.functions.affine import Affine, zones_off_grid, zones_on_grid
from tilespark.functions.pixels import clamp_to_type
from tilespark.operators import algebra, clip, focal as focal_mod, hull, intervals, local, zonal, zones as Z
from tilespark.operators.validate import validate_blocking, validate_tiles
from tilespark.plans import partition as P
from tilespark.session import checkpoint_dir
from tilespark.sources import fixtures as fx
from tilespark.sources import io
from tilespark.sources.tiling import assign_rid, mosaic, tile_raster, tile_raster_multi, tiles_from_rows, tiles_to_cells

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ------------------------------------------------------------ helpers

def tiles_a(spark: SparkSession, sf: str, t: int = 10):
    spec = fx.spec_a(spark, sf, t)
    return tile_raster(fx.cells_a(spark, sf), spec), spec


def _written(spark: SparkSession, sf: str) -> DataFrame:
    """Raster A's tile table, written to the shared folder and read back."""
    path = f"{checkpoint_dir(spark)}/tiles-{uuid.uuid4().hex}"
    io.write_tiles(tiles_a(spark, sf)[0], path)
    return io.read_tiles(spark, path)


def tiles_b(spark: SparkSession, sf: str, t: int = 10):
    spec = fx.spec_b(spark, sf, t)
    return tile_raster(fx.cells_b(spark, sf), spec), spec


def tiles_f(spark: SparkSession, sf: str, t: int = 16):
    spec = fx.spec_f(spark, sf, t)
    return tiles_from_rows(fx.rows_f(spark, sf), spec), spec


def text(c: str | Column = "data") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), " ")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def stats_out(df: DataFrame, by) -> DataFrame:
    return df.select(*by, "count", "sum", r6(F.col("mean")).alias("mean"), r6(F.col("stddev")).alias("stddev"),
                     "min", "max")


TXT = "string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ' ' ORDER BY py, px)"


def tiles_text_sql(cells: str, t: int, width: int, name: str) -> str:
    """Tiles of a cell view with their pixels as text, plus key columns."""
    return f"""{name} AS (
  SELECT CAST(px // {t} AS INTEGER) AS tile_col, CAST(py // {t} AS INTEGER) AS tile_row,
         CAST((py // {t}) * {-(-width // t)} + px // {t} + 1 AS BIGINT) AS rid,
         CAST((px // {t}) * {t} AS INTEGER) AS px0, CAST((py // {t}) * {t} AS INTEGER) AS py0,
         CAST(LEAST({t}, {width} - (px // {t}) * {t}) AS INTEGER) AS width,
         CAST(LEAST({t}, (SELECT max(py) + 1 FROM {cells}) - (py // {t}) * {t}) AS INTEGER) AS height,
         {TXT} AS data_text, count(*) AS n
  FROM {cells} GROUP BY 1, 2, 3, 4, 5, 6, 7)"""


def stats_sql(src: str, by: str, nod: str = "v <> 255") -> str:
    f = f"FILTER (WHERE {nod})"
    return f"""SELECT {by}, count(v) {f} AS count, sum(v) {f} AS sum,
  ROUND(avg(v) {f}, 6) AS mean, ROUND(stddev_pop(v) {f}, 6) AS stddev,
  min(v) {f} AS min, max(v) {f} AS max FROM {src} GROUP BY {by}"""


W = 100  # fixture raster width (cells_a, cells_b)

# ------------------------------------------------------------ S: sources


@query("tile_raster", f"""WITH {O.CELLS_A}, {tiles_text_sql('cells_a', 10, W, 'ta')}
SELECT rid, tile_col, tile_row, px0, py0, width, height,
       {O.wx('px0')} AS ulx, {O.wy('py0')} AS uly, data_text FROM ta""")
def q_tile_raster(spark, sf):
    t, _ = tiles_a(spark, sf)
    return t.select("rid", "tile_col", "tile_row", "px0", "py0", "width", "height", "ulx", "uly",
                    text().alias("data_text"))


_MULTI = [10, 25, 40]
_NESTED = [5, 10, 20, 40]


@query("tile_nested", "WITH " + O.CELLS_A + ", " + ", ".join(
    tiles_text_sql("cells_a", t, W, f"t{t}") for t in _NESTED) + "\n" + "\nUNION ALL ".join(
    f"SELECT {t} AS tile_size, 'cells_a_{t}' AS table_name, rid, width, height, data_text FROM t{t}" for t in _NESTED))
def q_tile_nested(spark, sf):
    """Sizes that divide each other: one shuffle of pixels and one of row slices for all."""
    t = tile_raster_multi(fx.cells_a(spark, sf), fx.spec_a(spark, sf), _NESTED, name="cells_a")
    return t.select("tile_size", "table_name", "rid", "width", "height", text().alias("data_text"))


#: Raster B lies on the mosaic 40 pixels right of and 25 below raster A.
_RIGHT, _BELOW = 40, 25


@query("tile_mosaic", f"""WITH {O.CELLS_A}, {O.CELLS_B}, b AS (SELECT px + {_RIGHT} AS px, py + {_BELOW} AS py, v FROM cells_b),
size AS (SELECT greatest((SELECT max(py) FROM cells_a), (SELECT max(py) FROM b)) + 1 AS h),
m AS (SELECT CAST(x.x AS INTEGER) AS px, CAST(y.y AS INTEGER) AS py, COALESCE(CASE WHEN a.v <> 255 THEN a.v END, b.v, {O.D(255)}) AS v,
  CASE WHEN a.v <> 255 THEN 1 WHEN b.v IS NOT NULL THEN 2 WHEN a.v IS NOT NULL THEN 3 END AS source
  FROM range({W + _RIGHT}) x(x), size, range(size.h) y(y) LEFT JOIN cells_a a ON a.px = x.x AND a.py = y.y LEFT JOIN b ON b.px = x.x AND b.py = y.y),
{tiles_text_sql('m', 32, W + _RIGHT, 'tm')},
f AS (SELECT px // 32 AS c, py // 32 AS r, min(source) AS source FROM m GROUP BY 1, 2)
SELECT rid, width, height, data_text, CASE source WHEN 1 THEN 'a.tif' WHEN 2 THEN 'b.tif' END AS filename
FROM tm JOIN f ON f.c = tile_col AND f.r = tile_row WHERE source IS NOT NULL""")
def q_tile_mosaic(spark, sf):
    """Two files that overlap: file a's pixels where it has any, then file b's; tiles that no file reaches are left out."""
    a, spec = tiles_a(spark, sf)
    b, spec_b = tiles_b(spark, sf, 25)
    move = {"ulx": F.col("ulx") + _RIGHT * spec.scale_x, "uly": F.col("uly") + _BELOW * spec.scale_y}
    files = a.withColumns({"filename": F.lit("a.tif"), "priority": F.lit(0)}).unionByName(
        b.withColumns(move | {"filename": F.lit("b.tif"), "priority": F.lit(1)}))
    whole = spec.with_(width=W + _RIGHT, height=max(spec.height, spec_b.height + _BELOW), nodata=255.0).with_tiles(32)
    return mosaic(files, whole).select("rid", "width", "height", text().alias("data_text"), "filename")


@query("tile_multi", "WITH " + O.CELLS_A + ", " + ", ".join(
    tiles_text_sql("cells_a", t, W, f"t{t}") for t in _MULTI) + "\n" + "\nUNION ALL ".join(
    f"SELECT {t} AS tile_size, 'cells_a_{t}' AS table_name, rid, width, height, data_text FROM t{t}" for t in _MULTI))
def q_tile_multi(spark, sf):
    spec = fx.spec_a(spark, sf)
    t = tile_raster_multi(fx.cells_a(spark, sf), spec, _MULTI, name="cells_a")
    return t.select("tile_size", "table_name", "rid", "width", "height", text().alias("data_text"))


@query("tile_multi_class", f"WITH {O.CELLS_A}\n" + "\nUNION ALL ".join(
    f"SELECT 'cells_a_{t}' AS table_name, 'cells_a' AS dataset, '{t}' AS tilesize, 16 AS pixel_value, count(*) FILTER (WHERE v = 16) AS count FROM cells_a"
    for t in _MULTI))
def q_tile_multi_class(spark, sf):
    """Each size's table: data set and tile size from its name, the data set's class, and its pixels of that class."""
    t = tile_raster_multi(fx.cells_a(spark, sf), fx.spec_a(spark, sf), _MULTI, name="cells_a")
    t = t.withColumns({"dataset": C.dataset_of(F.col("table_name")), "tilesize": C.tilesize_of(F.col("table_name"))})
    t = t.withColumn("pixel_value", C.class_of(F.col("dataset"), {"cells_b": 21, "cells_a": 16}))
    n = F.size(F.filter("data", lambda x: x == F.col("pixel_value")))
    return t.groupBy("table_name", "dataset", "tilesize", "pixel_value").agg(F.sum(n.cast("long")).alias("count"))


_SPARSE_SQL = f"""cells_s AS (SELECT px, py, v FROM cells_a WHERE NOT (px // 20 = 2 AND py // 5 = 1) AND (px * 7 + py * 3) % 11 <> 0),
full_s AS (SELECT a.px, a.py, coalesce(s.v, {O.D(255)}) AS v FROM cells_a a LEFT JOIN cells_s s USING (px, py))"""


@query("tile_multi_sparse", f"WITH {O.CELLS_A}, {_SPARSE_SQL}, " + ", ".join(
    tiles_text_sql("full_s", t, W, f"t{t}") for t in (5, 20)) + "\n" + "\nUNION ALL ".join(
    f"""SELECT {t} AS tile_size, rid, width, height, data_text FROM t{t}
  WHERE rid IN (SELECT (py // {t}) * {-(-W // t)} + px // {t} + 1 FROM cells_s)""" for t in (5, 20)))
def q_tile_multi_sparse(spark, sf):
    """Missing cells, a missing block of tiles, and every other size re-cut from the gaps."""
    c = fx.cells_a(spark, sf)
    s = c.where(~((F.floor(F.col("px") / 20) == 2) & (F.floor(F.col("py") / 5) == 1)) & ((F.col("px") * 7 + F.col("py") * 3) % 11 != 0))
    t = tile_raster_multi(s, fx.spec_a(spark, sf), [5, 20], name="cells_s")
    return t.select("tile_size", "rid", "width", "height", text().alias("data_text"))


@query("assign_rid", f"""WITH {O.CELLS_A}
SELECT DISTINCT CAST(px // 25 AS INTEGER) AS tile_col, CAST(py // 25 AS INTEGER) AS tile_row,
       CAST((py // 25) * 4 + px // 25 + 1 AS BIGINT) AS rid FROM cells_a""")
def q_assign_rid(spark, sf):
    c = fx.cells_a(spark, sf).select(F.floor(F.col("px") / 25).cast("int").alias("tile_col"),
                                     F.floor(F.col("py") / 25).cast("int").alias("tile_row")).distinct()
    return assign_rid(c, -(-W // 25)).select("tile_col", "tile_row", "rid")


@query("tiles_from_rows", f"""WITH {O.CELLS_F},
tf AS (SELECT CAST(px // 16 AS INTEGER) AS tile_col, CAST(py // 16 AS INTEGER) AS tile_row,
  list(v ORDER BY py, px) AS d, count(*) AS n FROM cells_f GROUP BY 1, 2)
SELECT CAST(tile_row * 4 + tile_col + 1 AS BIGINT) AS rid, tile_col, tile_row, n,
  list_min(d) AS vmin, list_max(d) AS vmax, d[1] AS first_v, d[len(d)] AS last_v, d[len(d) // 2 + 1] AS mid_v
FROM tf""")
def q_tiles_from_rows(spark, sf):
    t, _ = tiles_f(spark, sf, 16)
    d = F.col("data")
    return t.select("rid", "tile_col", "tile_row", F.size(d).cast("long").alias("n"),
                    F.array_min(d).alias("vmin"), F.array_max(d).alias("vmax"),
                    F.element_at(d, 1).alias("first_v"), F.element_at(d, -1).alias("last_v"),
                    F.element_at(d, F.floor(F.size(d) / 2).cast("int") + 1).alias("mid_v"))


@query("tiles_filename", f"""WITH {O.CELLS_A}, {tiles_text_sql('cells_a', 10, W, 'ta')}
SELECT rid, 'orders.parquet' AS filename, n FROM ta""")
def q_tiles_filename(spark, sf):
    o = io.with_filename(spark.read.parquet(f"{sf}/orders.parquet"))
    c = o.select((F.col("o_orderkey") % W).cast("int").alias("px"), F.floor(F.col("o_orderkey") / W).cast("int").alias("py"),
                 F.when(F.col("o_orderstatus") == "P", 255.0).otherwise((F.col("o_custkey") % 25).cast("double")).alias("v"), "filename")
    t = tile_raster(c, fx.spec_a(spark, sf))
    return t.select("rid", "filename", F.size("data").cast("long").alias("n"))


def _dump(spark, sf):
    t, _ = tiles_a(spark, sf)
    return io.tile_dump_lines(t, "cells_a_10")


_LINE_SQL = f"""WITH {O.CELLS_A}, {tiles_text_sql('cells_a', 10, W, 'ta')}
SELECT width || 'x' || height || '@' || tile_col || ',' || tile_row || ':' || data_text || chr(9) AS value FROM ta"""


@query("tile_lines", _LINE_SQL)
def q_tile_lines(spark, sf):
    return io.tile_lines(_dump(spark, sf)).select("value")


@query("tile_tsv", f"""WITH {O.CELLS_A}, {tiles_text_sql('cells_a', 10, W, 'ta')}
SELECT tile_col, tile_row, width, height, data_text FROM ta""")
def q_tile_tsv(spark, sf):
    """The whole load path: dump to text, keep the tile lines, write, bulk-load."""
    path = f"{checkpoint_dir(spark)}/dump-{uuid.uuid4().hex}"
    io.tile_lines(_dump(spark, sf)).select("value").write.text(path)
    t = io.load_tile_tsv(spark, path)
    return t.select("tile_col", "tile_row", "width", "height", text().alias("data_text"))


@query("tile_tsv_float", f"""WITH {O.CELLS_F}
SELECT CAST(px // 16 AS INTEGER) AS tile_col, CAST(py // 16 AS INTEGER) AS tile_row, count(*) AS n, min(v) AS vmin, max(v) AS vmax
FROM cells_f GROUP BY 1, 2""")
def q_tile_tsv_float(spark, sf):
    t = io.parse_tile_lines(io.tile_lines(io.tile_dump_lines(tiles_f(spark, sf, 16)[0], "cells_f")))
    return t.select("tile_col", "tile_row", F.size("data").cast("long").alias("n"), F.array_min("data").alias("vmin"),
                    F.array_max("data").alias("vmax"))


@query("write_roundtrip", f"""WITH {O.CELLS_A}, {tiles_text_sql('cells_a', 10, W, 'ta')}
SELECT rid, width, height, data_text FROM ta""")
def q_write_roundtrip(spark, sf):
    return _written(spark, sf).select("rid", "width", "height", text().alias("data_text"))


def _validate_sql(tiles: str, pixels: str) -> str:
    """``tiles``: one row per tile; ``pixels``: (rid, n, n_null) per tile, from its pixels."""
    uniform = {"srid": "srid", "scale_x": "scale_x", "scale_y": "scale_y", "blocksize_x": "CASE WHEN tile_col < mc THEN width END",
               "blocksize_y": "CASE WHEN tile_row < mr THEN height END",
               "same_alignment": "ROUND((ulx - px0 * scale_x) / scale_x, 6) || ' ' || ROUND((uly - py0 * scale_y) / scale_y, 6)",
               "pixel_types": "pixel_type", "nodata_values": "coalesce(CAST(nodata AS VARCHAR), 'none')"}
    bad = {"array_length": "n <> width * height", "null_pixels": "n_null > 0", "tile_position": "rid <> tile_row * (mc + 1) + tile_col + 1"}
    parts = [f"SELECT '{k}' AS c, CAST(count(DISTINCT {e}) > 1 AS BIGINT) AS n FROM tm" for k, e in uniform.items()]
    parts += [f"SELECT '{k}', CAST(count(*) FILTER (WHERE {e}) AS BIGINT) FROM tm" for k, e in bad.items()]
    return f"""tm AS (SELECT t.*, p.n, p.n_null, (SELECT max(tile_col) FROM {tiles}) AS mc, (SELECT max(tile_row) FROM {tiles}) AS mr
  FROM {tiles} t JOIN {pixels} p USING (rid))
SELECT c AS "check", n = 0 AS ok, n AS n_bad FROM ({" UNION ALL ".join(parts)})"""


_HEADERS_SQL = f"""{O.CELLS_A}, {O.tiles_sql('cells_a', 10, W, 'tk')},
th AS (SELECT *, 4326 AS srid, {O.SX} AS scale_x, {O.SY} AS scale_y, {O.wx('px0')} AS ulx, {O.wy('py0')} AS uly,
  '8BUI' AS pixel_type, {O.D(255)} AS nodata FROM tk),
np AS (SELECT CAST((py // 10) * 10 + px // 10 + 1 AS BIGINT) AS rid, count(*) AS n, count(*) - count(v) AS n_null FROM cells_a GROUP BY 1)"""


@query("validate_tiles", f"WITH {_HEADERS_SQL}, {_validate_sql('th', 'np')}")
def q_validate_tiles(spark, sf):
    t, _ = tiles_a(spark, sf)
    return validate_tiles(t)


@query("validate_bad", f"""WITH {_HEADERS_SQL},
tb AS (SELECT tile_col, tile_row, CASE WHEN rid % 7 = 0 THEN rid + 1000000 ELSE rid END AS rid, px0, py0,
  CASE WHEN rid % 9 = 4 THEN width - 1 ELSE width END AS width, height, CASE WHEN rid = 2 THEN 5070 ELSE srid END AS srid, scale_x, scale_y,
  CASE WHEN rid % 11 = 0 THEN ulx + {O.D(0.1)} ELSE ulx END AS ulx, uly, CASE WHEN rid % 2 = 0 THEN '32BF' ELSE '8BUI' END AS pixel_type,
  CASE WHEN rid <> 3 THEN nodata END AS nodata FROM th),
nb AS (SELECT CASE WHEN rid % 7 = 0 THEN rid + 1000000 ELSE rid END AS rid,
  n - CASE WHEN rid % 5 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN rid % 6 = 1 THEN 1 ELSE 0 END AS n_null FROM np), {_validate_sql('tb', 'nb')}""")
def q_validate_bad(spark, sf):
    """A damaged copy of the tile table: every kind of check has something to find."""
    t, _ = tiles_a(spark, sf)
    rid = F.col("rid")
    d = F.when(rid % 5 == 0, F.slice("data", F.lit(1), F.size("data") - 1)).otherwise(F.col("data"))
    t = t.select("*", d.alias("d")).withColumn("data", F.when(rid % 6 == 1, F.transform("d", lambda x, i: F.when(i > 0, x))).otherwise(F.col("d")))
    t = t.withColumns({
        "srid": F.when(rid == 2, 5070).otherwise(F.col("srid")), "width": F.when(rid % 9 == 4, F.col("width") - 1).otherwise(F.col("width")),
        "ulx": F.when(rid % 11 == 0, F.col("ulx") + 0.1).otherwise(F.col("ulx")),
        "pixel_type": F.when(rid % 2 == 0, "32BF").otherwise(F.col("pixel_type")), "nodata": F.when(rid != 3, F.col("nodata"))})
    return validate_tiles(t.withColumn("rid", F.when(rid % 7 == 0, rid + 1000000).otherwise(rid)))


@query("head_zones", """SELECT CAST(n_nationkey AS BIGINT) AS gid, n_name AS name, CAST(n_regionkey AS INTEGER) AS statefp
FROM nation ORDER BY gid LIMIT 5""")
def q_head_zones(spark, sf):
    """A zone table written and read back with its rings checked."""
    path = f"{checkpoint_dir(spark)}/zones-{uuid.uuid4().hex}"
    fx.zones_states(spark, sf).write.parquet(path)
    return io.head(io.read_zones(spark, path).where("size(rings) > 0").select("gid", "name", "statefp"), 5, ["gid"])


# ------------------------------------------------------------ P: filters and local operators


@query("rid_range", f"""WITH {O.CELLS_A}, {tiles_text_sql('cells_a', 10, W, 'ta')}
SELECT rid, width, height, data_text FROM ta WHERE rid BETWEEN 21 AND 60""")
def q_rid_range(spark, sf):
    t = _written(spark, sf)
    return local.rid_range(t, 21, 60).select("rid", "width", "height", text().alias("data_text"))


_IN_NAMES = ["NATION_0", "NATION_2", "NATION_3"]


@query("in_lists", f"""WITH {O.CELLS_A}, {O.EDGES_STATES}, {O.inside('cells_a', 'edges_states')}
{stats_sql(f"(SELECT * FROM inside WHERE (py // 10) * 10 + px // 10 + 1 IN (1,2,3,4,5,6,7,8,9,10,11,12,13,14,15) AND name IN ('NATION_0','NATION_2','NATION_3'))", 'gid, name')}""")
def q_in_lists(spark, sf):
    t, spec = tiles_a(spark, sf)
    z = local.in_lists(fx.zones_states(spark, sf), name=_IN_NAMES)
    tt = local.in_lists(t, rid=list(range(1, 16)))
    # keep_empty=False: restricting tiles changes which zones meet the raster
    return stats_out(zonal.zonal_stats(tt, z, spec, keep_empty=False), ["gid", "name"])


@query("exclude_nodata", f"""WITH {O.CELLS_A}
SELECT CAST((py // 10) * 10 + px // 10 + 1 AS BIGINT) AS rid, count(*) AS n_all,
       count(*) FILTER (WHERE v <> 255) AS n_valid FROM cells_a GROUP BY 1""")
def q_exclude_nodata(spark, sf):
    t, _ = tiles_a(spark, sf)
    e = local.exclude_nodata(t)
    return e.select("rid", F.size("data").cast("long").alias("n_all"), F.size("vals").cast("long").alias("n_valid"))


@query("remap_nodata", f"""WITH {O.CELLS_A}, c2 AS (SELECT px, py, CASE WHEN v = 255 THEN {O.D(-999)} ELSE v END AS v FROM cells_a),
{tiles_text_sql('c2', 10, W, 'ta')}
SELECT rid, {O.D(-999)} AS nodata, data_text FROM ta""")
def q_remap_nodata(spark, sf):
    t, _ = tiles_a(spark, sf)
    return local.remap_nodata(t, 255, -999).select("rid", "nodata", text().alias("data_text"))


@query("reclassify", f"""WITH {O.CELLS_A}, c2 AS (SELECT px, py, CASE WHEN v = 16 THEN {O.D(1)} ELSE {O.D(0)} END AS v FROM cells_a),
{tiles_text_sql('c2', 10, W, 'ta')}
SELECT rid, '8BUI' AS pixel_type, {O.D(0)} AS nodata, data_text FROM ta""")
def q_reclassify(spark, sf):
    t, _ = tiles_a(spark, sf)
    r = local.reclassify(t, [(16, 1)], "8BUI", 0)
    return r.select("rid", "pixel_type", "nodata", text().alias("data_text"))


@query("reclass_ranges", f"""WITH {O.CELLS_A}, c2 AS (SELECT px, py, CASE WHEN v = 255 THEN {O.D(0)}
  WHEN v BETWEEN 0 AND 9 THEN {O.D(1)} WHEN v BETWEEN 10 AND 19 THEN {O.D(300)} WHEN v = 21 THEN {O.D(-5)} ELSE {O.D(0)} END AS v FROM cells_a),
c3 AS (SELECT px, py, CASE WHEN v > 255 THEN {O.D(255)} WHEN v < 0 THEN {O.D(0)} ELSE v END AS v FROM c2),
{tiles_text_sql('c3', 10, W, 'ta')}
SELECT rid, data_text FROM ta""")
def q_reclass_ranges(spark, sf):
    t, _ = tiles_a(spark, sf)
    r = local.reclassify(t, [(0, 9, 1), (10, 19, 300), (21, -5)], "8BUI", 0)
    return r.select("rid", text().alias("data_text"))


@query("reclass_table", f"""WITH {O.CELLS_A}, c2 AS (SELECT px, py, CASE WHEN v = 255 THEN {O.D(0)} ELSE {O.D(1)} + (CAST(v * 400 AS BIGINT) % 250) END AS v FROM cells_a),
{tiles_text_sql('c2', 10, W, 'ta')}
SELECT rid, '8BUI' AS pixel_type, {O.D(0)} AS nodata, data_text FROM ta""")
def q_reclass_table(spark, sf):
    """Ten thousand range rules, each a four-hundredth of a unit wide."""
    t, _ = tiles_a(spark, sf)
    r = local.reclassify_table(t, [(k / 400, (k + 0.5) / 400, 1 + k % 250) for k in range(10_000)], "8BUI", 0)
    return r.select("rid", "pixel_type", "nodata", text().alias("data_text"))


@query("reclass_rids", f"""WITH {O.CELLS_A}
SELECT DISTINCT CAST((py // 10) * 10 + px // 10 + 1 AS BIGINT) AS rid FROM cells_a
WHERE (py // 10) * 10 + px // 10 + 1 BETWEEN 11 AND 100""")
def q_reclass_rids(spark, sf):
    t = _written(spark, sf)
    return local.reclass_rids(t, [(16, 1)], 11, 100)


@query("byte_clamp", f"""WITH {O.CELLS_B}
SELECT px, py, CAST(trunc(LEAST(GREATEST(v * {O.D(1.5)} - {O.D(20.3)}, {O.D(0)}), {O.D(255)})) AS DOUBLE) AS v FROM cells_b""")
def q_byte_clamp(spark, sf):
    c = fx.cells_b(spark, sf)
    return c.select("px", "py", clamp_to_type(F.col("v") * F.lit(1.5) - F.lit(20.3), "8BUI").alias("v"))


@query("value_counts", f"""WITH {O.CELLS_A}
SELECT CAST((py // 10) * 10 + px // 10 + 1 AS BIGINT) AS rid, v AS value, count(*) AS count
FROM cells_a WHERE v <> 255 GROUP BY 1, 2""")
def q_value_counts(spark, sf):
    t, _ = tiles_a(spark, sf)
    return local.value_counts(t)


@query("head_value_counts", f"""WITH {O.CELLS_A}
SELECT CAST((py // 10) * 10 + px // 10 + 1 AS BIGINT) AS rid, v AS value, count(*) AS count
FROM cells_a WHERE v <> 255 GROUP BY 1, 2 ORDER BY rid, value LIMIT 10""")
def q_head_value_counts(spark, sf):
    t, _ = tiles_a(spark, sf)
    return local.value_counts(t).orderBy("rid", "value").limit(10)


@query("pixel_count", f"""WITH {O.CELLS_A}
SELECT v AS value, count(*) AS count FROM cells_a WHERE v = 16 AND v <> 255 GROUP BY v""")
def q_pixel_count(spark, sf):
    t, _ = tiles_a(spark, sf)
    return local.pixel_count(t, 16)


@query("pixel_count_nodata", f"""WITH {O.CELLS_A}
SELECT v AS value, count(*) AS count FROM cells_a WHERE v = 255 AND v <> 255 GROUP BY v""")
def q_pixel_count_nodata(spark, sf):
    t, _ = tiles_a(spark, sf)
    return local.pixel_count(t, 255)


@query("pixel_count_b", f"""WITH {O.CELLS_B}
SELECT v AS value, count(*) AS count FROM cells_b WHERE v = 21 GROUP BY v""")
def q_pixel_count_b(spark, sf):
    t, _ = tiles_b(spark, sf)
    return local.pixel_count(t, 21)


@query("tile_summary", f"""WITH {O.CELLS_A}
SELECT CAST((py // 10) * 10 + px // 10 + 1 AS BIGINT) AS rid, count(v) FILTER (WHERE v <> 255) AS count,
  sum(v) FILTER (WHERE v <> 255) AS sum, ROUND(avg(v) FILTER (WHERE v <> 255), 6) AS mean,
  ROUND(stddev_pop(v) FILTER (WHERE v <> 255), 6) AS stddev,
  min(v) FILTER (WHERE v <> 255) AS min, max(v) FILTER (WHERE v <> 255) AS max FROM cells_a GROUP BY 1""")
def q_tile_summary(spark, sf):
    t, _ = tiles_a(spark, sf)
    return stats_out(zonal.tile_summary(t), ["rid"])


@query("validate_blocking", f"""WITH {O.CELLS_A}, {O.tiles_sql('cells_a', 10, W, 'tk')},
bad AS (SELECT px0, py0, width, height FROM tk WHERE rid % 13 <> 5 UNION ALL SELECT px0 + 3, py0, width, height FROM tk WHERE rid = 2
  UNION ALL SELECT px0, py0, width, height FROM tk WHERE rid = 7),
k AS (SELECT px0 // 10 AS c, py0 // 10 AS r, count(*) AS n, count(*) FILTER (px0 % 10 <> 0 OR py0 % 10 <> 0
  OR width < 10 AND px0 // 10 < (SELECT max(px0) // 10 FROM bad) OR height < 10 AND py0 // 10 < (SELECT max(py0) // 10 FROM bad)) AS odd FROM bad GROUP BY 1, 2),
s AS (SELECT sum(greatest(odd, n - 1))::BIGINT AS reg, ((max(c) - min(c) + 1) * (max(r) - min(r) + 1) - count(*))::BIGINT AS ext FROM k)
SELECT 'regular_blocking' AS "check", reg = 0 AS ok, reg AS n_bad FROM s UNION ALL SELECT 'extent', ext = 0, ext FROM s""")
def q_validate_blocking(spark, sf):
    """A table with holes, a tile that lies over two blocks and a tile that stands twice."""
    t, _ = tiles_a(spark, sf)
    moved = t.where("rid = 2").withColumn("px0", F.col("px0") + 3)
    return validate_blocking(t.where("rid % 13 <> 5").unionByName(moved).unionByName(t.where("rid = 7")))


@query("tiles_in_box", f"""WITH {O.CELLS_A}, {O.tiles_sql('cells_a', 10, W, 'tk')},
f AS (SELECT rid, {O.wx('px0')} AS x0, {O.wx('px0')} + width * {O.SX} AS x1, {O.wy('py0')} + height * {O.SY} AS y0, {O.wy('py0')} AS y1 FROM tk)
SELECT rid FROM f WHERE x0 <= -170.3 AND x1 >= -175.1 AND y0 <= 85.6 AND y1 >= 79.9""")
def q_tiles_in_box(spark, sf):
    """The tiles of a box, from the files along the curve that meet it."""
    path = f"{checkpoint_dir(spark)}/curve-{uuid.uuid4().hex}"
    io.write_tiles_curve(tiles_a(spark, sf)[0], path, partitions=16)
    return io.read_tiles_box(spark, path, -175.1, 79.9, -170.3, 85.6).select("rid")


# ------------------------------------------------------------ A/J: zonal and spatial joins


def _zonal_sql(edges: str, by: str = "gid, name") -> str:
    return f"""WITH {O.CELLS_A}, {O.EDGES[edges]}, {O.inside('cells_a', 'edges_' + edges)}
{stats_sql('inside', by)}"""


@query("zonal_stats", _zonal_sql("tracts"))
def q_zonal_stats(spark, sf):
    t, spec = tiles_a(spark, sf)
    return stats_out(zonal.zonal_stats(t, fx.zones_tracts(spark, sf), spec), ["gid", "name"])


@query("zonal_stats_sql", _zonal_sql("tracts"))
def q_zonal_stats_sql(spark, sf):
    t, spec = tiles_a(spark, sf)
    return stats_out(zonal.zonal_stats(t, fx.zones_tracts(spark, sf), spec, engine="sql"), ["gid", "name"])


@query("zonal_by_state_sql", _zonal_sql("states", "statefp, name"))
def q_zonal_by_state_sql(spark, sf):
    t, spec = tiles_a(spark, sf)
    return stats_out(zonal.zonal_stats(t, fx.zones_states(spark, sf), spec, by=["statefp", "name"], engine="sql"),
                     ["statefp", "name"])


@query("zonal_states", _zonal_sql("states"))
def q_zonal_states(spark, sf):
    t, spec = tiles_a(spark, sf)
    return stats_out(zonal.zonal_stats(t, fx.zones_states(spark, sf), spec), ["gid", "name"])


@query("zonal_regions", _zonal_sql("regions"))
def q_zonal_regions(spark, sf):
    t, spec = tiles_a(spark, sf)
    return stats_out(zonal.zonal_stats(t, fx.zones_regions(spark, sf), spec), ["gid", "name"])


@query("zonal_by_state", _zonal_sql("states", "statefp, name"))
def q_zonal_by_state(spark, sf):
    t, spec = tiles_a(spark, sf)
    return stats_out(zonal.zonal_stats(t, fx.zones_states(spark, sf), spec, by=["statefp", "name"]),
                     ["statefp", "name"])


_TWO_NAMES_SQL = f"""edges_two AS (SELECT gid // 2 AS gid, name, statefp, x1, y1, x2, y2 FROM edges_tracts)"""


def _two_names(spark, sf):
    """Two zones of different names under each gid."""
    return fx.zones_tracts(spark, sf).withColumn("gid", F.floor(F.col("gid") / 2).cast("long"))


@query("zonal_multi_name", f"""WITH {O.CELLS_A}, {O.EDGES_TRACTS}, {_TWO_NAMES_SQL}, {O.inside('cells_a', 'edges_two')}
{stats_sql('inside', 'gid, name')}""")
def q_zonal_multi_name(spark, sf):
    t, spec = tiles_a(spark, sf)
    return stats_out(zonal.zonal_stats(t, _two_names(spark, sf), spec), ["gid", "name"])


@query("zonal_text_id", f"""WITH {O.CELLS_A}, {O.EDGES_STATES},
edges_text AS (SELECT 'US' || gid AS gid, name, statefp, x1, y1, x2, y2 FROM edges_states), {O.inside('cells_a', 'edges_text')}
{stats_sql('inside', 'gid, name')}""")
def q_zonal_text_id(spark, sf):
    t, spec = tiles_a(spark, sf)
    z = fx.zones_states(spark, sf).withColumn("gid", F.concat(F.lit("US"), F.col("gid").cast("string")))
    return stats_out(zonal.zonal_stats(t, z, spec), ["gid", "name"])


@query("zonal_all_pixels", f"""WITH {O.CELLS_A}, {O.EDGES_TRACTS}, {O.inside('cells_a', 'edges_tracts')}
{stats_sql('inside', 'gid, name', 'TRUE')}""")
def q_zonal_all_pixels(spark, sf):
    t, spec = tiles_a(spark, sf)
    return stats_out(zonal.zonal_stats(t, fx.zones_tracts(spark, sf), spec, exclude_nodata=False),
                     ["gid", "name"])


@query("zonal_float", f"""WITH {O.CELLS_F}, {O.EDGES_TRACTS}, {O.inside('cells_f', 'edges_tracts')}
SELECT gid, name, count, ROUND(sum, 6) AS sum, mean, stddev, min, max FROM (
{stats_sql('inside', 'gid, name', 'TRUE')})""")
def q_zonal_float(spark, sf):
    t, spec = tiles_f(spark, sf, 16)
    z = zonal.zonal_stats(t, fx.zones_tracts(spark, sf), spec, keep_empty=False)
    return z.select("gid", "name", "count", r6(F.col("sum")).alias("sum"), r6(F.col("mean")).alias("mean"),
                    r6(F.col("stddev")).alias("stddev"), "min", "max")


@query("cells_in_zones", f"""WITH {O.CELLS_A}, {O.EDGES_STATES}, {O.inside('cells_a', 'edges_states')}
SELECT gid, px, py, v FROM inside""")
def q_cells_in_zones(spark, sf):
    t, spec = tiles_a(spark, sf)
    return Z.cells_in_zones(t, fx.zones_states(spark, sf), spec, keep=["gid"]).select("gid", "px", "py", "v")


@query("clip_cells", f"""WITH {O.CELLS_A}, {O.EDGES_TRACTS}, {O.inside('cells_a', 'edges_tracts')}
SELECT gid, CAST((py // 10) * 10 + px // 10 + 1 AS BIGINT) AS rid, px, py, v FROM inside""")
def q_clip_cells(spark, sf):
    t, spec = tiles_a(spark, sf)
    return clip.clip_cells(t, fx.zones_tracts(spark, sf), spec, keep=["gid"])


@query("clip_zones", f"""WITH {O.CELLS_A}, {O.EDGES_TRACTS}, {O.inside('cells_a', 'edges_tracts')},
box AS (SELECT gid, px // 10 AS tc, py // 10 AS tr, min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1
        FROM inside GROUP BY 1, 2, 3),
cc AS (SELECT b.gid, b.tc, b.tr, b.x0, b.y0, b.x1, b.y1, c.px, c.py,
         CASE WHEN i.gid IS NULL THEN {O.D(255)} ELSE c.v END AS v
       FROM box b JOIN cells_a c ON c.px BETWEEN b.x0 AND b.x1 AND c.py BETWEEN b.y0 AND b.y1
       LEFT JOIN inside i ON i.gid = b.gid AND i.px = c.px AND i.py = c.py)
SELECT gid, CAST(tr * 10 + tc + 1 AS BIGINT) AS rid, CAST(x0 AS INTEGER) AS px0, CAST(y0 AS INTEGER) AS py0,
  CAST(x1 - x0 + 1 AS INTEGER) AS width, CAST(y1 - y0 + 1 AS INTEGER) AS height, {TXT} AS data_text
FROM cc GROUP BY gid, tc, tr, x0, y0, x1, y1""")
def q_clip_zones(spark, sf):
    t, spec = tiles_a(spark, sf)
    c = clip.clip_to_zones(t, fx.zones_tracts(spark, sf), spec, keep=["gid"])
    return c.select("gid", "rid", "px0", "py0", "width", "height", text().alias("data_text"))


def _extent_sql(edges: str) -> str:
    return f"""{O.EDGES[edges]},
ext AS (SELECT min(LEAST(x1, x2)) AS xmin, max(GREATEST(x1, x2)) AS xmax,
               min(LEAST(y1, y2)) AS ymin, max(GREATEST(y1, y2)) AS ymax FROM edges_{edges})"""


@query("layer_extent", f"""WITH {_extent_sql('tracts')} SELECT xmin, xmax, ymin, ymax FROM ext""")
def q_layer_extent(spark, sf):
    return clip.layer_extent(fx.zones_tracts(spark, sf))


@query("clip_extent", f"""WITH {O.CELLS_A}, {_extent_sql('states')},
win AS (SELECT CAST(trunc((xmin - {O.ULX}) / {O.SX}) AS INTEGER) AS c0, CAST(trunc(({O.ULY} - ymax) / {O.D(0.25)}) AS INTEGER) AS r0,
               CAST(trunc((xmax - {O.ULX}) / {O.SX}) AS INTEGER) AS c1, CAST(trunc(({O.ULY} - ymin) / {O.D(0.25)}) AS INTEGER) AS r1 FROM ext),
w2 AS (SELECT GREATEST(c0, 0) AS cx0, GREATEST(r0, 0) AS ry0, LEAST(c0 + abs(c1 - c0), {W}) AS cx1,
              LEAST(r0 + abs(r1 - r0), (SELECT max(py) + 1 FROM cells_a)) AS ry1 FROM win),
sc AS (SELECT c.px - w2.cx0 AS px, c.py - w2.ry0 AS py, c.v FROM cells_a c, w2
       WHERE c.px >= w2.cx0 AND c.px < w2.cx1 AND c.py >= w2.ry0 AND c.py < w2.ry1),
tt AS (SELECT CAST(px // 10 AS INTEGER) AS tile_col, CAST(py // 10 AS INTEGER) AS tile_row, {TXT} AS data_text,
              max(px) - min(px) + 1 AS w, max(py) - min(py) + 1 AS h FROM sc GROUP BY 1, 2)
SELECT CAST(tile_row * (((SELECT cx1 - cx0 FROM w2) + 9) // 10) + tile_col + 1 AS BIGINT) AS rid,
  tile_col, tile_row, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height,
  ({O.ULX} + CAST((SELECT cx0 FROM w2) AS DOUBLE) * {O.SX}) + (tile_col * 10) * {O.SX} AS ulx,
  ({O.ULY} + CAST((SELECT ry0 FROM w2) AS DOUBLE) * {O.SY}) + (tile_row * 10) * {O.SY} AS uly,
  {O.D(-999)} AS nodata, data_text FROM tt""")
def q_clip_extent(spark, sf):
    t, spec = tiles_a(spark, sf)
    out, _ = clip.clip_to_extent(t, fx.zones_states(spark, sf), spec, nodata=-999.0)
    return out.select("rid", "tile_col", "tile_row", "width", "height", "ulx", "uly", "nodata",
                      text().alias("data_text"))


_PAIRS_SQL = f"""WITH {O.CELLS_A}, {O.EDGES_TRACTS}, {O.inside('cells_a', 'edges_tracts')},
{O.tiles_sql('cells_a', 10, W, 'tk')}, {O.edge_hits('tk', 'edges_tracts')},
pairs AS (SELECT gid, name, rid FROM edge_hits
          UNION SELECT DISTINCT gid, name, CAST((py // 10) * 10 + px // 10 + 1 AS BIGINT) AS rid FROM inside)"""


@query("tile_zone_pairs", _PAIRS_SQL + "\nSELECT gid, rid FROM pairs")
def q_tile_zone_pairs(spark, sf):
    t, spec = tiles_a(spark, sf)
    return Z.intersect_pairs(t, fx.zones_tracts(spark, sf), spec, keep=["gid"])


@query("feature_tiles", _PAIRS_SQL + """
SELECT gid, name, CAST((rid - 1) // 10 AS INTEGER) AS tile_row,
       string_agg(CAST(rid AS VARCHAR), ',' ORDER BY rid) AS raster_ids FROM pairs GROUP BY gid, name, 3""")
def q_feature_tiles(spark, sf):
    t, spec = tiles_a(spark, sf)
    p = Z.intersect_pairs(t, fx.zones_tracts(spark, sf), spec, keep=["gid", "name"])
    return Z.feature_tiles(p, t).select("gid", "name", "tile_row", C.ids_text(F.col("ids")).alias("raster_ids"))


#: Ids that follow each other without a gap are one range.
_RANGES_SQL = """SELECT gid, name, sum(z - a + 1)::BIGINT AS n_tiles,
  string_agg(CASE WHEN a = z THEN CAST(a AS VARCHAR) ELSE a || '-' || z END, ',' ORDER BY a) AS ranges
FROM (SELECT gid, name, min(rid) AS a, max(rid) AS z FROM
  (SELECT gid, name, rid, rid - row_number() OVER (PARTITION BY gid, name ORDER BY rid) AS island FROM {pairs}) GROUP BY gid, name, island)
GROUP BY gid, name"""


@query("feature_rid_ranges", _PAIRS_SQL + "\n" + _RANGES_SQL.format(pairs="pairs"))
def q_feature_rid_ranges(spark, sf):
    t, spec = tiles_a(spark, sf)
    r = intervals.feature_rid_ranges(t, fx.zones_tracts(spark, sf), spec)
    return r.select("gid", "name", "n_tiles", intervals.ranges_text(F.col("ranges")).alias("ranges"))


@query("feature_rid_ranges_sparse", _PAIRS_SQL + ", kept AS (SELECT * FROM pairs WHERE rid % 7 <> 3)\n" + _RANGES_SQL.format(pairs="kept"))
def q_feature_rid_ranges_sparse(spark, sf):
    """Over a tile table with holes."""
    t, spec = tiles_a(spark, sf)
    r = intervals.feature_rid_ranges(t.where("rid % 7 <> 3"), fx.zones_tracts(spark, sf), spec)
    return r.select("gid", "name", "n_tiles", intervals.ranges_text(F.col("ranges")).alias("ranges"))


def _zones_on_and_off(spark, sf) -> DataFrame:
    """The state zones, and the same moved a thousand degrees east, off the raster."""
    z = fx.zones_states(spark, sf)
    ring = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((p["x"] + 1000).alias("x"), p["y"].alias("y"))))
    moved = z.withColumns({"gid": F.col("gid") + 1000, "rings": ring})
    return fx.with_bbox(z.unionByName(moved))


_STAT_NAMES = ["count", "sum", "mean", "stddev", "min", "max"]


@query("zonal_left", f"""WITH {O.CELLS_A}, {O.EDGES_STATES}, {O.inside('cells_a', 'edges_states')},
s AS ({stats_sql('inside', 'gid, name')})
SELECT * FROM s UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 1000 AS gid, n_name AS name, {', '.join(f'NULL AS "{c}"' for c in _STAT_NAMES)} FROM nation""")
def q_zonal_left(spark, sf):
    """Zones off the raster stay in the result, without statistics."""
    t, spec = tiles_a(spark, sf)
    return stats_out(zonal.zonal_stats(t, _zones_on_and_off(spark, sf), spec, how="left"), ["gid", "name"])


@query("tile_zone_left", f"""WITH {O.CELLS_A}, {O.EDGES_STATES}, {O.inside('cells_a', 'edges_states')},
{O.tiles_sql('cells_a', 10, W, 'tk')}, {O.edge_hits('tk', 'edges_states')}
SELECT gid, rid FROM edge_hits UNION SELECT DISTINCT gid, CAST((py // 10) * 10 + px // 10 + 1 AS BIGINT) AS rid FROM inside
UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 1000 AS gid, NULL AS rid FROM nation""")
def q_tile_zone_left(spark, sf):
    t, spec = tiles_a(spark, sf)
    return Z.intersect_pairs(t, _zones_on_and_off(spark, sf), spec, keep=["gid"], how="left")


_SEMI_NAMES = ["Supplier#000000003", "Supplier#000000007", "Supplier#000000044"]


@query("tiles_semi", _PAIRS_SQL + f"""
SELECT DISTINCT rid FROM pairs WHERE name IN ('Supplier#000000003', 'Supplier#000000007', 'Supplier#000000044')""")
def q_tiles_semi(spark, sf):
    t, spec = tiles_a(spark, sf)
    z = local.in_lists(fx.zones_tracts(spark, sf), name=_SEMI_NAMES)
    p = Z.intersect_pairs(t, z, spec, keep=["gid"])
    return t.join(p.select("rid"), "rid", "left_semi").select("rid")


# ------------------------------------------------------------ J3/J4: map algebra


def _algebra_sql(a: str, b: str, expr: str, nd_a: str, nd_b: str | None, nodata: str, lo=0, hi=255) -> str:
    bad = f"a.v = {nd_a}" + (f" OR b.v = {nd_b}" if nd_b else "")
    return f"""SELECT a.px, a.py, CASE WHEN {bad} THEN {nodata}
  ELSE CAST(trunc(LEAST(GREATEST({expr}, {O.D(lo)}), {O.D(hi)})) AS DOUBLE) END AS v
FROM {a} a JOIN {b} b ON a.px = b.px AND a.py = b.py"""


@query("raster_multiply", f"WITH {O.CELLS_A}, {O.CELLS_B}\n"
       + _algebra_sql("cells_a", "cells_b", "a.v * b.v", "255", None, O.D(255)))
def q_raster_multiply(spark, sf):
    a, _ = tiles_a(spark, sf)
    b, _ = tiles_b(spark, sf)
    m = algebra.map_algebra(a, b, lambda x, y: x * y, "8BUI")
    return tiles_to_cells(m, keep=()).select("px", "py", "v")


@query("raster_square", f"WITH {O.CELLS_A}\n"
       + _algebra_sql("cells_a", "cells_a", "a.v * b.v", "255", "255", O.D(255)))
def q_raster_square(spark, sf):
    a, _ = tiles_a(spark, sf)
    m = algebra.map_algebra(a, a, "[rast1]*[rast2]", "8BUI")
    return tiles_to_cells(m, keep=()).select("px", "py", "v")


@query("raster_expr", f"WITH {O.CELLS_A}, {O.CELLS_B}\n"
       + _algebra_sql("cells_a", "cells_b", f"a.v * {O.D(3)} - b.v", "255", None, O.D(255), -32768, 32767))
def q_raster_expr(spark, sf):
    a, _ = tiles_a(spark, sf)
    b, _ = tiles_b(spark, sf)
    m = algebra.map_algebra(a, b, "rast1 * 3.0D - rast2", "16BSI")
    return tiles_to_cells(m, keep=()).select("px", "py", "v")


@query("raster_unlike", f"WITH {O.CELLS_A}, {O.CELLS_B}\n"
       + _algebra_sql("cells_a", "cells_b", "a.v + b.v", "255", None, O.D(255)))
def q_raster_unlike(spark, sf):
    a, spec = tiles_a(spark, sf, 10)
    b, spec_b = tiles_b(spark, sf, 25)
    m = algebra.map_algebra_cells(a, b, lambda x, y: x + y, spec, 255.0, None, "8BUI", spec_b=spec_b)
    return tiles_to_cells(m, keep=()).select("px", "py", "v")


@query("tile_pairs", f"""WITH {O.CELLS_A}, {O.CELLS_B}, {O.tiles_sql('cells_a', 10, W, 'ta')}, {O.tiles_sql('cells_b', 25, W, 'tb')}
SELECT ta.rid AS rid_a, tb.rid AS rid_b FROM ta JOIN tb
  ON ta.px0 < tb.px0 + tb.width AND tb.px0 < ta.px0 + ta.width
 AND ta.py0 < tb.py0 + tb.height AND tb.py0 < ta.py0 + ta.height""")
def q_tile_pairs(spark, sf):
    a, sa = tiles_a(spark, sf, 10)
    b, sb = tiles_b(spark, sf, 25)
    return algebra.tile_pairs(a, b, sa, sb)


# ------------------------------------------------------------ W4: focal


def _focal_sql(scope: str, edge: str) -> str:
    if scope == "tile":
        same = "n.px // 10 = c.px // 10 AND n.py // 10 = c.py // 10"
        r, cc = "c.py - (c.py // 10) * 10", "c.px - (c.px // 10) * 10"
        h = "LEAST(10, (SELECT max(py) + 1 FROM cells_a) - (c.py // 10) * 10)"
        w = f"LEAST(10, {W} - (c.px // 10) * 10)"
        full = f"({r}) >= 1 AND ({r}) < {h} - 1 AND ({cc}) >= 1 AND ({cc}) < {w} - 1"
    else:
        same = "TRUE"
        full = f"c.px >= 1 AND c.px < {W} - 1 AND c.py >= 1 AND c.py < (SELECT max(py) FROM cells_a)"
    mean = "avg(n.v) FILTER (WHERE n.v <> 255)"
    # a window without any counted cell is NoData
    val = (f"CASE WHEN {mean} IS NULL THEN {O.D(255)} "
           f"ELSE CAST(trunc(LEAST(GREATEST({mean}, {O.D(0)}), {O.D(255)})) AS DOUBLE) END")
    if edge == "nodata":
        val = f"CASE WHEN {full} THEN {val} ELSE {O.D(255)} END"
    return f"""WITH {O.CELLS_A}
SELECT c.px, c.py, {val} AS v
FROM cells_a c JOIN cells_a n ON n.px BETWEEN c.px - 1 AND c.px + 1 AND n.py BETWEEN c.py - 1 AND c.py + 1 AND {same}
GROUP BY c.px, c.py"""


@query("focal_mean", _focal_sql("tile", "nodata"))
def q_focal_mean(spark, sf):
    t, _ = tiles_a(spark, sf)
    return tiles_to_cells(focal_mod.focal(t, "mean", 1, 1, scope="tile", edge="nodata"), keep=())


@query("focal_mosaic", _focal_sql("mosaic", "nodata"))
def q_focal_mosaic(spark, sf):
    t, _ = tiles_a(spark, sf)
    return tiles_to_cells(focal_mod.focal(t, "mean", 1, 1, scope="mosaic", edge="nodata"), keep=())


@query("focal_mean_sql", _focal_sql("tile", "nodata"))
def q_focal_mean_sql(spark, sf):
    t, _ = tiles_a(spark, sf)
    return tiles_to_cells(focal_mod.focal(t, "mean", 1, 1, scope="tile", edge="nodata", engine="sql"), keep=())


@query("focal_mosaic_sql", _focal_sql("mosaic", "nodata"))
def q_focal_mosaic_sql(spark, sf):
    t, _ = tiles_a(spark, sf)
    return tiles_to_cells(focal_mod.focal(t, "mean", 1, 1, scope="mosaic", edge="nodata", engine="sql"), keep=())


@query("focal_shrink", _focal_sql("mosaic", "shrink"))
def q_focal_shrink(spark, sf):
    t, _ = tiles_a(spark, sf)
    return tiles_to_cells(focal_mod.focal(t, "mean", 1, 1, scope="mosaic", edge="shrink"), keep=())


@query("focal_wide", f"""WITH {O.CELLS_A}
SELECT c.px, c.py, {O.D(1)} * sum(n.v) FILTER (WHERE n.v <> 255) AS v
FROM cells_a c JOIN cells_a n ON n.px BETWEEN c.px - 7 AND c.px + 7 AND n.py BETWEEN c.py - 6 AND c.py + 6
GROUP BY c.px, c.py""")
def q_focal_wide(spark, sf):
    """A window wider than a tile."""
    t, _ = tiles_a(spark, sf, 5)
    return tiles_to_cells(focal_mod.focal(t, "sum", 7, 6, scope="mosaic", edge="shrink", pixel_type=None), keep=())


def _nanmean_trunc(wins):
    """A user neighbourhood function: mean of the counted cells of every
    window, truncated into a byte (NaN when a window has none)."""
    import numpy as np
    n = (~np.isnan(wins)).sum(axis=1)
    s = np.nansum(wins, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        m = np.where(n > 0, s / np.maximum(n, 1), np.nan)
    return np.trunc(np.clip(m, 0.0, 255.0))


def _focal_wide_sql(fn: str, nx: int, ny: int, t: int | None = None) -> str:
    """Windows by columns, then rows; over the part inside the raster, or inside a tile of ``t`` pixels."""
    tile = f", px // {t}, py // {t}" if t else ""
    over = lambda part, by, n: f"OVER (PARTITION BY {part}{tile} ORDER BY {by} RANGE BETWEEN {n} PRECEDING AND {n} FOLLOWING)"
    one = {"mean": "sum", "min": "min", "max": "max"}[fn]
    value = "CASE WHEN n > 0 THEN s / n END" if fn == "mean" else "s"
    return f"""WITH {O.CELLS_A}, {O.GRID_A},
r AS (SELECT px, py, {one}(v) {over('py', 'px', nx)} AS s, count(v) {over('py', 'px', nx)} AS n FROM grid_a),
w AS (SELECT px, py, {one}(s) {over('px', 'py', ny)} AS s, sum(n) {over('px', 'py', ny)} AS n FROM r)
SELECT px, py, COALESCE(trunc({value}), {O.D(255)}) AS v FROM w"""


@query("focal_window_101", _focal_wide_sql("mean", 50, 50))
def q_focal_window_101(spark, sf):
    """A window wider than the tiles, across tiles: the work does not grow with it."""
    t, _ = tiles_a(spark, sf, 25)
    return tiles_to_cells(focal_mod.focal(t, "mean", 50, 50, scope="mosaic", edge="shrink"), keep=())


@query("focal_window_min", _focal_wide_sql("min", 30, 20, 50))
def q_focal_window_min(spark, sf):
    t, _ = tiles_a(spark, sf, 50)
    return tiles_to_cells(focal_mod.focal(t, "min", 30, 20, scope="tile", edge="shrink"), keep=())


@query("focal_udf", _focal_sql("tile", "nodata"))
def q_focal_udf(spark, sf):
    t, _ = tiles_a(spark, sf)
    f = focal_mod.focal_udf(t, _nanmean_trunc, 1, 1, scope="tile", edge="nodata", vectorized=True)
    return tiles_to_cells(f, keep=())


@query("focal_udf_mosaic", _focal_sql("mosaic", "nodata"))
def q_focal_udf_mosaic(spark, sf):
    t, _ = tiles_a(spark, sf)
    f = focal_mod.focal_udf(t, _nanmean_trunc, 1, 1, scope="mosaic", edge="nodata", vectorized=True)
    return tiles_to_cells(f, keep=())


# ------------------------------------------------------------ partition planning


_BANDS_SQL = f"""{O.CELLS_A}, {O.tiles_sql('cells_a', 10, W, 'tk')},
bands AS (SELECT tile_row, min(rid) AS min_rid, max(rid) AS max_rid FROM tk GROUP BY tile_row)"""


@query("band_ranges", f"WITH {_BANDS_SQL} SELECT tile_row, min_rid, max_rid FROM bands")
def q_band_ranges(spark, sf):
    t, _ = tiles_a(spark, sf)
    return P.band_ranges(t)


@query("partition_raster", f"""WITH {_BANDS_SQL},
bp AS (SELECT *, CAST(ntile(4) OVER (ORDER BY min_rid) - 1 AS INTEGER) AS part FROM bands)
SELECT part, min(min_rid) AS min_rid, max(max_rid) AS max_rid FROM bp GROUP BY part""")
def q_partition_raster(spark, sf):
    t, _ = tiles_a(spark, sf)
    return P.partition_raster(t, 4)


@query("id_array", f"""WITH {_BANDS_SQL}
SELECT tile_row, string_agg(CAST(rid AS VARCHAR), ',' ORDER BY rid) AS ids FROM tk GROUP BY tile_row""")
def q_id_array(spark, sf):
    t, _ = tiles_a(spark, sf)
    return P.band_ids(t).select("tile_row", C.ids_text(F.col("ids")).alias("ids"))


@query("id_first_last", f"""WITH {_BANDS_SQL}
SELECT tile_row, min_rid AS first_id, max_rid AS last_id FROM bands""")
def q_id_first_last(spark, sf):
    t, _ = tiles_a(spark, sf)
    b = P.band_ids(t)
    return b.select("tile_row", C.first_id(F.col("ids")).alias("first_id"), C.last_id(F.col("ids")).alias("last_id"))


@query("id_slice", f"""WITH {_BANDS_SQL},
k AS (SELECT rid FROM tk ORDER BY rid LIMIT 8)
SELECT string_agg(CAST(rid AS VARCHAR), ',' ORDER BY rid) AS ids FROM (SELECT rid FROM k ORDER BY rid OFFSET 3)""")
def q_id_slice(spark, sf):
    t, _ = tiles_a(spark, sf)
    return P.first_ids(t, 4, 8).select(C.ids_text(F.col("ids")).alias("ids"))


@query("tile_footprint", f"""WITH {_BANDS_SQL},
fp AS (SELECT rid, {O.wx('px0')} AS x0, {O.wy('py0')} AS y0, {O.wx('px0')} + width * {O.SX} AS x1,
              {O.wy('py0')} + height * {O.SY} AS y1 FROM tk)
SELECT rid, 'POLYGON((' || x0 || ' ' || y0 || ',' || x1 || ' ' || y0 || ',' || x1 || ' ' || y1 || ','
  || x0 || ' ' || y1 || ',' || x0 || ' ' || y0 || '))' AS wkt FROM fp""")
def q_tile_footprint(spark, sf):
    t, _ = tiles_a(spark, sf)
    return t.select("rid", C.footprint_wkt(F.col("ulx"), F.col("uly"), F.col("width"), F.col("height"),
                                           F.col("scale_x"), F.col("scale_y")).alias("wkt"))


@query("band_y_text", f"""WITH {_BANDS_SQL}
SELECT rid, CAST({O.wy('py0')} AS VARCHAR) AS y FROM tk""")
def q_band_y_text(spark, sf):
    t, _ = tiles_a(spark, sf)
    w = C.footprint_wkt(F.col("ulx"), F.col("uly"), F.col("width"), F.col("height"), F.col("scale_x"), F.col("scale_y"))
    return t.select("rid", C.band_y_text(w).alias("y"))


_CHUNK_SQL = _PAIRS_SQL + """,
ft AS (SELECT gid, name FROM pairs GROUP BY gid, name),
ix AS (SELECT gid, name, row_number() OVER (ORDER BY gid) - 1 AS i, count(*) OVER () AS total FROM ft),
ch AS (SELECT gid, name, CAST(CASE WHEN total // 3 = 0 THEN i WHEN i < (total // 3) * 3 THEN i // (total // 3)
                              ELSE i - (total // 3) * 3 END AS INTEGER) AS part FROM ix)"""


def _chunks(spark, sf):
    t, spec = tiles_a(spark, sf)
    p = Z.intersect_pairs(t, fx.zones_tracts(spark, sf), spec, keep=["gid", "name"])
    ft = p.select("gid", "name").distinct()
    return P.chunk_assign(ft, 3, ["gid"])


@query("chunk_assign", _CHUNK_SQL + "\nSELECT gid, part FROM ch")
def q_chunk_assign(spark, sf):
    return _chunks(spark, sf).select("gid", "part")


@query("part_groups", _CHUNK_SQL + """
SELECT part, count(*) AS n_records, min(gid) AS first_key, max(gid) AS last_key FROM ch GROUP BY part""")
def q_part_groups(spark, sf):
    return P.part_groups(_chunks(spark, sf), "gid")


@query("parts_together", _CHUNK_SQL + """
SELECT gid, name, part, row_number() OVER (PARTITION BY part ORDER BY gid) - 1 AS place FROM ch""")
def q_parts_together(spark, sf):
    """The records of each part, written as sorted files of that part and read back."""
    t, spec = tiles_a(spark, sf)
    p = Z.intersect_pairs(t, fx.zones_tracts(spark, sf), spec, keep=["gid", "name"])
    path = f"{checkpoint_dir(spark)}/parts-{uuid.uuid4().hex}"
    P.write_parts(p.select("gid", "name").distinct(), 3, ["gid"], path, rows_per_file=7)
    return P.read_parts(spark, path, rows_per_file=7).select("gid", "name", "part", "place")


_PARTS_SQL = f"""{_BANDS_SQL},
bp AS (SELECT tile_row, CAST(ntile(3) OVER (ORDER BY min_rid) - 1 AS INTEGER) AS part FROM bands)"""


@query("union_parts", f"""WITH {_PARTS_SQL}
SELECT bp.part, c.v AS value, count(*) AS count FROM cells_a c JOIN bp ON c.py // 10 = bp.tile_row
WHERE c.v = 16 GROUP BY bp.part, c.v""")
def q_union_parts(spark, sf):
    t, _ = tiles_a(spark, sf)
    return P.per_part(t, 3, lambda x: local.pixel_count(x, 16, by=["part"]))


_PARTIALS_SQL = f"""WITH {_PARTS_SQL}, {O.EDGES_TRACTS}, {O.inside('cells_a', 'edges_tracts')},
ip AS (SELECT bp.part, i.* FROM inside i JOIN bp ON i.py // 10 = bp.tile_row)"""


@query("zonal_partials", _PARTIALS_SQL + """
SELECT part, gid, name, min(v) FILTER (WHERE v <> 255) AS min, max(v) FILTER (WHERE v <> 255) AS max,
  count(v) FILTER (WHERE v <> 255) AS count, sum(v) FILTER (WHERE v <> 255) AS sum,
  ROUND(var_pop(v) FILTER (WHERE v <> 255) * count(v) FILTER (WHERE v <> 255), 6) AS m2 FROM ip GROUP BY part, gid, name""")
def q_zonal_partials(spark, sf):
    t, spec = tiles_a(spark, sf)
    tp = P.assign_parts(t, 3)
    return zonal.zonal_partials(tp, fx.zones_tracts(spark, sf), spec).withColumn("m2", r6(F.col("m2")))


@query("merge_partials", _PARTIALS_SQL + "\n" + stats_sql("ip", "gid"))
def q_merge_partials(spark, sf):
    t, spec = tiles_a(spark, sf)
    parts = zonal.zonal_partials(P.assign_parts(t, 3), fx.zones_tracts(spark, sf), spec)
    return stats_out(zonal.merge_partials(parts, ["gid"]), ["gid"])


@query("merge_partials_offset", _PARTIALS_SQL + f""",
sh AS (SELECT gid, v + {O.D(1e9)} AS v FROM ip WHERE v <> 255)
SELECT gid, count(v) AS count, ROUND(stddev_pop(v), 3) AS stddev FROM sh GROUP BY gid""")
def q_merge_partials_offset(spark, sf):
    """Large offsets: merged standard deviations equal the single pass."""
    t, spec = tiles_a(spark, sf)
    far = t.withColumn("data", F.transform("data", lambda x: F.when(x == F.col("nodata"), x).otherwise(x + 1e9)))
    parts = zonal.zonal_partials(P.assign_parts(far, 3), fx.zones_tracts(spark, sf), spec)
    m = zonal.merge_partials(parts, ["gid"]).where("count > 0")
    return m.select("gid", "count", F.round("stddev", 3).alias("stddev"))


# ------------------------------------------------------------ F: coordinates and names


def _points(spark, sf) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    k = F.col("c_custkey")
    return c.select(k.alias("c_custkey"),
                    (F.lit(-181.0) + F.lit(0.25) * (k % 110).cast("double") + F.lit(0.0625)).alias("x"),
                    (F.lit(91.0) - F.lit(0.25) * F.floor(k / 110).cast("double") - F.lit(0.0625)).alias("y"))


_POINTS_SQL = f"""pts AS (SELECT c_custkey,
  {O.D(-181.0)} + {O.D(0.25)} * CAST(c_custkey % 110 AS DOUBLE) + {O.D(0.0625)} AS x,
  {O.D(91.0)} - {O.D(0.25)} * CAST(c_custkey // 110 AS DOUBLE) - {O.D(0.0625)} AS y FROM customer)"""


@query("world_to_pixel", f"""WITH {_POINTS_SQL}
SELECT c_custkey, CAST(trunc((x - {O.ULX}) / {O.SX}) AS INTEGER) AS col,
       CAST(trunc(({O.ULY} - y) / {O.SX}) AS INTEGER) AS line FROM pts""")
def q_world_to_pixel(spark, sf):
    p = _points(spark, sf)
    col, line = C.world_to_pixel(F.col("x"), F.col("y"), -180.0, 90.0, 0.25)
    return p.select("c_custkey", col.alias("col"), line.alias("line"))


@query("pixel_to_world", f"""WITH {_POINTS_SQL},
px AS (SELECT c_custkey, CAST(trunc((x - {O.ULX}) / {O.SX}) AS INTEGER) AS col,
       CAST(trunc(({O.ULY} - y) / {O.SX}) AS INTEGER) AS line FROM pts)
SELECT c_custkey, {O.ULX} + col * {O.SX} AS x, {O.ULY} - line * {O.SX} AS y FROM px""")
def q_pixel_to_world(spark, sf):
    p = _points(spark, sf)
    x, y = C.snap_to_pixel(F.col("x"), F.col("y"), -180.0, 90.0, 0.25)
    return p.select("c_custkey", x.alias("x"), y.alias("y"))


#: A rotated and skewed grid; its terms are binary fractions, so that both engines find the same doubles.
SKEWED = Affine(-180.0, 90.0, 0.25, -0.25, skew_x=0.5, skew_y=0.125)


def _skewed_sql(c: str, r: str) -> tuple[str, str]:
    a = {k: O.D(v) for k, v in SKEWED._asdict().items()}
    return (f"({a['ulx']} + ({c}) * {a['scale_x']} + ({r}) * {a['skew_x']})",
            f"({a['uly']} + ({c}) * {a['skew_y']} + ({r}) * {a['scale_y']})")


@query("affine_pixels", f"""WITH {_POINTS_SQL},
d AS (SELECT c_custkey, x - {O.D(SKEWED.ulx)} AS dx, y - {O.D(SKEWED.uly)} AS dy FROM pts),
px AS (SELECT c_custkey, CAST(trunc(({O.D(SKEWED.scale_y)} * dx - {O.D(SKEWED.skew_x)} * dy) / {O.D(-0.125)}) AS INTEGER) AS col,
              CAST(trunc(({O.D(SKEWED.scale_x)} * dy - {O.D(SKEWED.skew_y)} * dx) / {O.D(-0.125)}) AS INTEGER) AS line FROM d)
SELECT c_custkey, col, line, {_skewed_sql('col', 'line')[0]} AS x, {_skewed_sql('col', 'line')[1]} AS y FROM px""")
def q_affine_pixels(spark, sf):
    """F1 and F2 with skew: each point's pixel and that pixel's corner."""
    col, line = SKEWED.pixel(F.col("x"), F.col("y"))
    p = _points(spark, sf).select("c_custkey", col.alias("col"), line.alias("line"))
    x, y = SKEWED.world(F.col("col"), F.col("line"))
    return p.select("*", x.alias("x"), y.alias("y"))


def _footprint_sql() -> str:
    corners = [("px0", "py0"), ("px0 + width", "py0"), ("px0 + width", "py0 + height"), ("px0", "py0 + height"), ("px0", "py0")]
    return " || ',' || ".join("{} || ' ' || {}".format(*_skewed_sql(*c)) for c in corners)


@query("tile_footprint_skewed", f"""WITH {_BANDS_SQL}
SELECT rid, 'POLYGON((' || {_footprint_sql()} || '))' AS wkt FROM tk""")
def q_tile_footprint_skewed(spark, sf):
    t, _ = tiles_a(spark, sf)
    return t.select("rid", SKEWED.footprint_wkt(*map(F.col, ("px0", "py0", "width", "height"))).alias("wkt"))


_SMALL_PAIRS_SQL = f"""WITH {O.CELLS_A}, {O.EDGES_TRACTS}, {O.inside('cells_a', 'edges_tracts')},
{O.tiles_sql('cells_a', 4, W, 'tk')}, {O.edge_hits('tk', 'edges_tracts')},
pairs AS (SELECT gid, rid FROM edge_hits
          UNION SELECT DISTINCT gid, CAST((py // 4) * {W // 4} + px // 4 + 1 AS BIGINT) AS rid FROM inside)"""


@query("tile_zone_pairs_small", _SMALL_PAIRS_SQL + "\nSELECT gid, rid FROM pairs")
def q_tile_zone_pairs_small(spark, sf):
    """J1 where zones meet tiles by their edges alone, without a pixel centre."""
    t, spec = tiles_a(spark, sf, 4)
    return Z.intersect_pairs(t, fx.zones_tracts(spark, sf), spec, keep=["gid"])


@query("zone_tile_hull", _SMALL_PAIRS_SQL + f""",
own AS (SELECT gid, px0, py0, px0 + width AS px1, py0 + height AS py1 FROM pairs JOIN tk USING (rid)),
pt AS (SELECT gid, px0 AS x, py0 AS y FROM own UNION SELECT gid, px1, py0 FROM own
       UNION SELECT gid, px0, py1 FROM own UNION SELECT gid, px1, py1 FROM own),
side AS (SELECT a.gid, a.x, a.y, b.x AS bx, b.y AS by_,
                bool_and((b.x - a.x) * (c.y - a.y) > (b.y - a.y) * (c.x - a.x)
                         OR (b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x)
                            AND (b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y) > 0) AS outer_side
         FROM pt a JOIN pt b ON a.gid = b.gid AND (a.x <> b.x OR a.y <> b.y)
         JOIN pt c ON a.gid = c.gid AND (a.x <> c.x OR a.y <> c.y) GROUP BY ALL)
SELECT DISTINCT gid, {_skewed_sql('x', 'y')[0]} AS x, {_skewed_sql('x', 'y')[1]} AS y FROM side WHERE outer_side""")
def q_zone_tile_hull(spark, sf):
    """F6 over the tiles that each zone meets, on the skewed grid: one row per corner of the hull."""
    t, spec = tiles_a(spark, sf, 4)
    pairs = Z.intersect_pairs(t, fx.zones_tracts(spark, sf), spec, keep=["gid"])
    own = pairs.join(t.select("rid", "px0", "py0", "width", "height"), "rid")
    return hull.tile_hulls(own, ["gid"], SKEWED).select("gid", F.explode("hull").alias("p")).select("gid", "p.x", "p.y")


@query("zonal_skewed", _zonal_sql("tracts"))
def q_zonal_skewed(spark, sf):
    """Zones of the skewed raster's world over its tiles: the same pixels as without skew."""
    t, spec = tiles_a(spark, sf)
    far = zones_off_grid(fx.zones_tracts(spark, sf), SKEWED, spec)
    return stats_out(zonal.zonal_stats(t, zones_on_grid(far, SKEWED, spec), spec), ["gid", "name"])
