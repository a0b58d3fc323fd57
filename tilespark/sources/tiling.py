"""Cutting rasters into tiles (S1, S2, S12), serial tile ids (W1), and the
tile <-> cell conversion.

A tile is one row holding a row-major pixel block.  Cutting is one shuffle on
the tile key: every group is bounded by ``tile_w * tile_h`` pixels, so no
group grows with the raster.  Row-array input (one array per pixel row, as a
strip reader yields it) shuffles ``tile_h`` slices per tile instead of
single pixels, which is the form to use at scale.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions.arrays import let
from tilespark.functions.coords import table_name
from tilespark.model import TILE_COLUMNS, RasterSpec


def _ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - F.lit(1)) / b).cast("int")


def assign_rid(df: DataFrame, ntx: Column | int) -> DataFrame:
    """Serial tile id in row-major order, 1-based, from the tile key alone
    (``tile_row * ntx + tile_col + 1``), so no global sort is needed."""
    ntx_c = ntx if isinstance(ntx, Column) else F.lit(int(ntx))
    return df.withColumn("rid", (F.col("tile_row").cast("long") * ntx_c + F.col("tile_col") + 1).cast("long"))


def _finish_tiles(g: DataFrame, spec: RasterSpec, tw: Column, th: Column,
                  filename: str | Column | None) -> DataFrame:
    px0 = F.col("tile_col") * tw
    py0 = F.col("tile_row") * th
    fname = filename if isinstance(filename, Column) else F.lit(filename).cast("string")
    out = g.withColumns({
        "px0": px0.cast("int"),
        "py0": py0.cast("int"),
    }).withColumns({
        "width": F.least(tw, F.lit(spec.width) - F.col("px0")).cast("int"),
        "height": F.least(th, F.lit(spec.height) - F.col("py0")).cast("int"),
        "ulx": F.lit(spec.ulx) + F.col("px0") * F.lit(spec.scale_x),
        "uly": F.lit(spec.uly) + F.col("py0") * F.lit(spec.scale_y),
        "scale_x": F.lit(spec.scale_x),
        "scale_y": F.lit(spec.scale_y),
        "srid": F.lit(spec.srid),
        "pixel_type": F.lit(spec.pixel_type),
        "nodata": F.lit(spec.nodata).cast("double"),
        "filename": fname,
    })
    return assign_rid(out, _ceil_div(F.lit(spec.width), tw))


def assemble(pieces: Column, n: Column, nodata: Column) -> Column:
    """The row-major block of ``n`` pixels that ``pieces`` (array of ``(pos,
    v)``: first position and values of a stretch) make up.  Positions that no
    piece covers become ``nodata``; an overlap, a piece past the end, or a gap
    without a NoData value fails the query.  Linear in pieces and pixels."""
    def fail(text: str) -> Column:
        return F.raise_error(F.lit(text)).cast("array<double>")

    def fill(gap: Column) -> Column:
        return (F.when(gap == 0, F.array().cast("array<double>"))
                .when(gap < 0, fail("a tile has a pixel twice, or one outside its block"))
                .when(nodata.isNull(), fail("a tile lacks pixels and the raster declares no NoData"))
                .otherwise(F.array_repeat(nodata, gap.cast("int"))))

    def end(p: Column) -> Column:
        return p["pos"] + F.size(p["v"])

    def block(s: Column) -> Column:
        parts = F.transform(s, lambda p, i: F.concat(
            fill(p["pos"] - F.when(i == 0, F.lit(0)).otherwise(end(s[F.greatest(i - 1, F.lit(0))]))), p["v"]))
        return F.concat(F.flatten(parts), fill(n - end(F.element_at(s, -1))))

    return let(F.array_sort(pieces), block)


def _inside(ok: Column, outside: str, what: str) -> Column:
    """Row filter for pixels of the raster header; ``outside='error'`` fails on others."""
    if outside == "drop":
        return ok
    if outside != "error":
        raise ValueError(outside)
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(f"{what} outside the raster header")).cast("boolean"))


def _cells_to_tiles(c: DataFrame, spec: RasterSpec, tw: Column, th: Column,
                    filename, keys: Sequence[str]) -> DataFrame:
    named = filename is None and "filename" in c.columns
    # a null value is a missing pixel
    g = (c.where(F.col("v").isNotNull()).withColumns({
            "tile_col": F.floor(F.col("px") / tw).cast("int"),
            "tile_row": F.floor(F.col("py") / th).cast("int"),
        })
        .groupBy(*keys, "tile_col", "tile_row")
        .agg(F.collect_list(F.struct("py", "px", "v")).alias("_cells"),
             *([F.min("filename").alias("_filename")] if named else [])))
    out = _finish_tiles(g, spec, tw, th, F.col("_filename") if named else filename)
    n = F.col("width") * F.col("height")

    def pos(x):
        return (x["py"] - F.col("py0")) * F.col("width") + x["px"] - F.col("px0")

    def block(s):
        # dense tiles (the normal case) only need the sort; others are built from their pixels' positions
        dense = (F.size(s) == n) & ~F.exists(F.transform(s, lambda x, i: pos(x) != i), lambda bad: bad)
        return F.when(dense, F.transform(s, lambda x: x["v"])).otherwise(
            assemble(F.transform(s, lambda x: F.struct(pos(x).alias("pos"), F.array(x["v"]).alias("v"))), n, F.col("nodata")))

    out = out.withColumn("data", let(F.array_sort("_cells"), block).cast("array<double>"))
    return out.select(*keys, *TILE_COLUMNS)


def tile_raster(cells: DataFrame, spec: RasterSpec, filename: str | None = None, outside: str = "error") -> DataFrame:
    """Cut a cell raster ``(px, py, v)`` into ``tile_w x tile_h`` tiles.

    Right and bottom tiles are ragged (not padded), ids are row-major serials.
    Missing cells of a tile (or null values) become NoData; without a declared
    NoData they fail the query, as does a cell given twice.  Cells outside the
    raster header fail too, or are left out with ``outside='drop'``.  A
    ``filename`` column of the cells (S5) names each tile's first source file.
    """
    c = cells.select("px", "py", F.col("v").cast("double").alias("v"),
                     *(["filename"] if "filename" in cells.columns else [])).where(_inside(
        (F.col("px") >= 0) & (F.col("px") < spec.width) & (F.col("py") >= 0) & (F.col("py") < spec.height), outside, "a cell lies"))
    return _cells_to_tiles(c, spec, F.lit(spec.tile_w), F.lit(spec.tile_h), filename, [])


def size_families(sizes: Sequence[int]) -> list[tuple[int, list[int]]]:
    """Sizes dealt to families of a divisor lattice: the largest size left heads
    a family, with all sizes left that divide it."""
    left, out = sorted(set(sizes), reverse=True), []
    while left:
        own = [s for s in left if left[0] % s == 0]
        out.append((left[0], own))
        left = [s for s in left if s not in own]
    return out


def tile_raster_multi(cells: DataFrame, spec: RasterSpec, sizes: Sequence[int],
                      name: str = "raster") -> DataFrame:
    """Tile one raster at several square sizes in one job.

    Adds ``tile_size`` and ``table_name`` (``<name>_<size>``).  Pixels are
    shuffled once, into tiles of the smallest size.  Their row slices are
    shuffled once for each family of nested sizes (``size_families``), on the tile key of the
    family's largest size: a tile of any other size of the family lies within one
    such tile, so it is put together where its slices are.  All sizes of a family read the same
    shuffle (a reused exchange); nothing runs or is stored while the query is defined.
    Output is len(sizes) copies of the raster, as the reference's per-size tables are.
    """
    sizes = [int(x) for x in sizes]
    base = tile_raster(cells, spec.with_tiles(min(sizes)))
    found = {}
    for head, own in size_families(sizes):
        if len(set(sizes)) == 1:
            found[head] = base
            continue
        big = _row_slices(base, spec.with_tiles(head)).withColumnsRenamed({"tile_col": "_bc", "tile_row": "_br"}).repartition("_bc", "_br")
        for s in own:
            found[s] = _from_slices(_split_slices(big, spec.with_tiles(s)), spec.with_tiles(s), keys=["_bc", "_br"])
    out = reduce(lambda a, b: a.unionByName(b), (found[s].select(F.lit(s).alias("tile_size"), *TILE_COLUMNS) for s in sizes))
    return out.withColumn("table_name", table_name(F.lit(name), F.col("tile_size")))


def tiles_from_rows(rows: DataFrame, spec: RasterSpec, filename: str | None = None, outside: str = "error") -> DataFrame:
    """Build tiles from pixel-row arrays ``(py, values)``.

    Each row is cut into tile-width slices before the shuffle, so a tile
    gathers ``tile_h`` slices rather than ``tile_w * tile_h`` single cells.
    Missing rows and short rows become NoData (or fail without one), a row
    given twice fails; rows or values outside the header as in ``tile_raster``.
    """
    tw, th = spec.tile_w, spec.tile_h
    ok = (F.col("py") >= 0) & (F.col("py") < spec.height)
    if outside == "error":
        ok = ok & (F.size("values") <= spec.width)
    r = rows.where(_inside(ok, outside, "a row or its end lies")).select(
        "py", F.explode(F.sequence(F.lit(0), F.lit(spec.ntx - 1))).alias("tile_col"), "values")
    r = r.select(
        "tile_col", F.floor(F.col("py") / th).cast("int").alias("tile_row"), "py",
        F.slice("values", F.col("tile_col") * tw + 1, F.least(F.lit(tw), F.lit(spec.width) - F.col("tile_col") * tw)).alias("chunk"))
    g = r.groupBy("tile_col", "tile_row").agg(F.collect_list(F.struct("py", "chunk")).alias("_rows"))
    out = _finish_tiles(g, spec, F.lit(tw), F.lit(th), filename)
    pieces = F.transform("_rows", lambda x: F.struct(((x["py"] - F.col("py0")) * F.col("width")).alias("pos"),
                                                     x["chunk"].cast("array<double>").alias("v")))
    out = out.withColumn("data", assemble(pieces, F.col("width") * F.col("height"), F.col("nodata")))
    return out.select(*TILE_COLUMNS)


def tiles_to_cells(tiles: DataFrame, keep: Sequence[str] = ("rid",)) -> DataFrame:
    """Tile -> cells ``(px, py, v)`` with global pixel indexes."""
    t = tiles.select(*keep, "px0", "py0", "width", F.posexplode("data").alias("pos", "v"))
    return t.select(*keep,
                    (F.col("px0") + F.col("pos") % F.col("width")).cast("int").alias("px"),
                    (F.col("py0") + F.floor(F.col("pos") / F.col("width"))).cast("int").alias("py"),
                    "v")


def retile(tiles: DataFrame, dst: RasterSpec, dx: int = 0, dy: int = 0,
           filename: str | None = None) -> DataFrame:
    """Cut tiles onto another tiling: source pixel ``(px, py)`` becomes
    destination pixel ``(px - dx, py - dy)``; pixels outside ``dst`` are
    dropped.  Every source row is cut at the destination tile borders and the
    row slices are shuffled on the destination tile key (``tile_h`` slices per
    tile from each source tile), never single pixels.  Pixels that no source
    tile covers become the NoData of ``dst``, or fail the query without one."""
    return _from_slices(_row_slices(tiles, dst, dx, dy), dst, filename)


def _row_slices(tiles: DataFrame, dst: RasterSpec, dx: int = 0, dy: int = 0, carry: Sequence[str] = ()) -> DataFrame:
    """Rows of source tiles cut at the destination's tile borders: ``(carry..., tile_col,
    tile_row, y, a, v)``, the values from pixel ``(a, y)`` on; pixels outside ``dst`` go."""
    tw, th = dst.tile_w, dst.tile_h
    t = tiles.select(*carry, "px0", "py0", "width", "height", "data")
    r_lo = F.greatest(F.lit(0), F.lit(dy) - F.col("py0"))
    r_hi = F.least(F.col("height"), F.lit(dst.height + dy) - F.col("py0"))
    c_lo = F.greatest(F.lit(0), F.lit(dx) - F.col("px0"))
    c_hi = F.least(F.col("width"), F.lit(dst.width + dx) - F.col("px0"))
    t = t.withColumns({"_r0": r_lo, "_r1": r_hi, "_c0": c_lo, "_c1": c_hi}).where(
        (F.col("_r0") < F.col("_r1")) & (F.col("_c0") < F.col("_c1")))
    t = t.withColumn("r", F.explode(F.sequence("_r0", F.col("_r1") - 1)))
    t = t.withColumns({"y": F.col("py0") + F.col("r") - dy,
                       "x0": F.col("px0") + F.col("_c0") - dx, "x1": F.col("px0") + F.col("_c1") - dx})
    t = t.withColumn("tile_col", F.explode(F.sequence(F.floor(F.col("x0") / tw).cast("int"),
                                                      F.floor((F.col("x1") - 1) / tw).cast("int"))))
    a = F.greatest(F.col("x0"), F.col("tile_col") * tw)
    b = F.least(F.col("x1"), (F.col("tile_col") + 1) * tw)
    return t.select(*carry, "tile_col", F.floor(F.col("y") / th).cast("int").alias("tile_row"), "y", a.alias("a"),
                    F.slice("data", F.col("r") * F.col("width") + (a + dx - F.col("px0")) + 1, b - a).alias("v"))


def _split_slices(big: DataFrame, dst: RasterSpec) -> DataFrame:
    """Slices cut again at the borders of smaller tiles, where they are."""
    tw, th = dst.tile_w, dst.tile_h
    t = big.withColumn("tile_col", F.explode(F.sequence(F.floor(F.col("a") / tw).cast("int"),
                                                        F.floor((F.col("a") + F.size("v") - 1) / tw).cast("int"))))
    lo = F.greatest(F.col("a"), F.col("tile_col") * tw)
    hi = F.least(F.col("a") + F.size("v"), (F.col("tile_col") + 1) * tw)
    return t.select("_bc", "_br", "tile_col", F.floor(F.col("y") / th).cast("int").alias("tile_row"), "y", lo.alias("a"),
                    F.slice("v", lo - F.col("a") + 1, hi - lo).alias("v"))


def _from_slices(slices: DataFrame, dst: RasterSpec, filename: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Tiles from row slices; ``keys`` that a tile key determines keep the grouping on their partitioning."""
    g = slices.groupBy(*keys, "tile_col", "tile_row").agg(F.collect_list(F.struct("y", "a", "v")).alias("_p"))
    out = _finish_tiles(g, dst, F.lit(dst.tile_w), F.lit(dst.tile_h), filename)
    pieces = F.transform("_p", lambda q: F.struct(((q["y"] - F.col("py0")) * F.col("width") + q["a"] - F.col("px0")).alias("pos"),
                                                  q["v"].cast("array<double>").alias("v")))
    out = out.withColumn("data", assemble(pieces, F.col("width") * F.col("height"), F.col("nodata")))
    return out.select(*TILE_COLUMNS)


def mosaic(tiles: DataFrame, dst: RasterSpec, priority: str = "priority") -> DataFrame:
    """S1 + S5: one raster from the tiles of several files, which may overlap.

    ``tiles`` is a tile table with the column ``priority``; every tile is
    placed by its own georeference, which must lie on the pixels of ``dst``.  A pixel comes
    from the file with the smallest priority (then file name) that has a value
    there: neither null nor that file's NoData.  Pixels without any become the
    NoData of ``dst``, or fail the query without one; pixels outside ``dst`` go.
    ``filename`` is the first file, in that order, that a tile has a pixel of.

    Row slices are shuffled on the destination tile key, never single pixels; a
    task paints a tile's slices over each other, so a group is as many
    slices as files overlap in one tile.
    """
    from tilespark.session import bound_arrow_batches, ship_by_value

    def place(ul: str, scale: str, origin: float, step: float) -> Column:
        at = (F.col(ul) - F.lit(origin)) / F.lit(step)
        off = (F.abs(at - F.round(at)) > 1e-6) | (F.abs(F.col(scale) - F.lit(step)) > abs(step) * 1e-9)
        return F.when(off, F.raise_error(F.lit("a tile does not lie on the pixels of the mosaic")).cast("int")).otherwise(F.round(at).cast("int"))

    placed = tiles.withColumns({"px0": place("ulx", "scale_x", dst.ulx, dst.scale_x), "py0": place("uly", "scale_y", dst.uly, dst.scale_y),
                                "_rank": F.col(priority).cast("double"), "_file": F.coalesce("filename", F.lit(""))})
    slices = _row_slices(placed.withColumnRenamed("nodata", "_void"), dst, carry=["_rank", "_file", "_void"])
    g = slices.groupBy("tile_col", "tile_row").agg(F.collect_list(F.struct("_rank", "_file", "_void", "y", "a", "v")).alias("_p"))
    out = _finish_tiles(g, dst, F.lit(dst.tile_w), F.lit(dst.tile_h), None)
    bound_arrow_batches(tiles.sparkSession)
    ship_by_value(__name__)
    meta = [c for c in TILE_COLUMNS if c not in ("data", "filename")]
    schema = tiles.select(*TILE_COLUMNS).schema
    out = out.select(*[F.col(c).cast(schema[c].dataType) for c in meta], "_p")

    def run(batches):
        for b in batches:
            yield _painted(b, meta)

    return out.mapInArrow(run, schema)


def _painted(b, meta):
    """Tiles of one Arrow batch, their slices painted from the last file to the first."""
    import numpy as np
    import pyarrow as pa
    width, height, px0, py0 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("width", "height", "px0", "py0"))
    void = b.column("nodata").to_pylist()
    lists = b.column("_p")
    at, pieces = lists.offsets.to_numpy(), lists.values
    rank, y, a = (pieces.field(c).to_numpy(zero_copy_only=False) for c in ("_rank", "y", "a"))
    files, own_void = pieces.field("_file").to_pylist(), pieces.field("_void").to_pylist()
    blocks = pieces.field("v")
    off = blocks.offsets.to_numpy()
    values = blocks.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    missing = blocks.values.is_null().to_numpy(zero_copy_only=False)
    data, names = [], []
    for i in range(b.num_rows):
        order = sorted(range(at[i], at[i + 1]), key=lambda k: (np.isnan(rank[k]), rank[k], files[k]))
        source = np.full((height[i], width[i]), -1, np.int64)
        out = np.zeros((height[i], width[i]))
        for place, k in reversed(list(enumerate(order))):
            v, gone = values[off[k]:off[k + 1]], missing[off[k]:off[k + 1]]
            ok = ~gone
            if own_void[k] is not None:
                ok &= ~((v == own_void[k]) | np.isnan(v) & np.isnan(own_void[k]))
            row, col = y[k] - py0[i], a[k] - px0[i]
            out[row, col:col + len(v)][ok] = v[ok]
            source[row, col:col + len(v)][ok] = place
        empty = source < 0
        if empty.any():
            if void[i] is None:
                raise ValueError("a mosaic lacks pixels and declares no NoData")
            out[empty] = void[i]
        data.append(out.ravel())
        names.append(None if empty.all() else files[order[int(source[~empty].min())]] or None)
    columns = {c: b.column(c) for c in meta} | {"filename": pa.array(names, pa.string()),
                                               "data": pa.array(data, pa.list_(pa.float64()))}
    return pa.RecordBatch.from_arrays([columns[c] for c in TILE_COLUMNS], TILE_COLUMNS)
