"""Focal (moving-window) operators: W4 and the user-function form X1.

``scope='tile'`` reproduces the reference: every tile is its own raster, so
windows stop at tile borders (one select, no shuffle).  ``scope='mosaic'``
uses neighbours across tiles through a halo exchange: each tile sends only
the border strips its neighbours need (``nx``/``ny`` pixels wide; a window
wider than a tile reaches as many rings of tiles as it covers), so the shuffle
moves one copy of each tile plus its perimeter, not 9 copies of every pixel.
Each group is one tile plus strips: bounded.

Window cells that are NoData are ignored; a window with no counted cell
gives NoData.  ``edge='nodata'``: pixels whose full window is not available
(raster or tile border) are NoData; ``edge='shrink'`` uses the part inside.

Two engines compute the same result.  ``engine='numpy'`` (default) hands
whole tiles to ``mapInArrow``: Arrow list columns are read without copies
and a window's result is put together from running results (``running``), so the
work does not grow with the window.
``engine='sql'`` stays in Catalyst with higher-order functions; those are
interpreted per element and measured 20-60x slower, so it is kept for
checking and for sessions without Python workers.  Spark does the
partitioning and the halo shuffle in both.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions.arrays import let
from tilespark.functions.pixels import clamp_to_type, clamp_to_type_col
from tilespark.model import PIXEL_RANGES, TILE_COLUMNS

NO_NODATA = "a pixel has no focal result and the raster declares no NoData: pass nodata="
BUILTIN = ("mean", "sum", "min", "max", "count")


def _reduce(win: Column, fn: str, nod: Column) -> Column:
    """Reduce one window (an array; nulls are cells outside the raster) to
    ``struct(v, full)``: ``v`` over the counted cells, ``full`` when no cell
    of the window is missing.  One pass over the window."""
    acc0 = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(0).alias("miss"),
                    F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))

    def step(a, x):
        ok = x.isNotNull() & (nod.isNull() | (x != nod))
        return F.struct(
            (a["s"] + F.when(ok, x).otherwise(0.0)).alias("s"),
            (a["n"] + F.when(ok, 1).otherwise(0)).alias("n"),
            (a["miss"] + F.when(x.isNull(), 1).otherwise(0)).alias("miss"),
            F.when(ok & (a["lo"].isNull() | (x < a["lo"])), x).otherwise(a["lo"]).alias("lo"),
            F.when(ok & (a["hi"].isNull() | (x > a["hi"])), x).otherwise(a["hi"]).alias("hi"))

    def finish(a):
        n = a["n"]
        v = {"mean": F.when(n > 0, a["s"] / n), "sum": F.when(n > 0, a["s"]),
             "count": n.cast("double"), "min": a["lo"], "max": a["hi"]}[fn]
        return F.struct(v.alias("v"), (a["miss"] == 0).alias("full"))

    return F.aggregate(win, acc0, step, finish)


def _padded(nx: int, ny: int, neighbours: bool) -> Column:
    """The tile with a halo of ``nx`` columns / ``ny`` rows, row-major, built
    row by row from array slices.  Halo cells come from the neighbour pieces
    (``_p``, 9 entries, own tile at 4) or are null where there is none."""
    w, h = F.col("width"), F.col("height")

    def part(k: int, row: Column, width: Column, d: Column) -> Column:
        nulls = F.array_repeat(F.lit(None).cast("double"), width)
        if k == 4:
            return F.slice(d, row * w + 1, w)
        if not neighbours:
            return nulls
        p = F.col("_p")[k]
        return F.when(p.isNull(), nulls).otherwise(F.slice(p["block"], row * p["bw"] + 1, p["bw"]))

    def prow(pr: Column, d: Column) -> Column:
        top = F.concat(part(0, pr + ny, F.lit(nx), d), part(1, pr + ny, w, d), part(2, pr + ny, F.lit(nx), d))
        mid = F.concat(part(3, pr, F.lit(nx), d), part(4, pr, w, d), part(5, pr, F.lit(nx), d))
        bot = F.concat(part(6, pr - h, F.lit(nx), d), part(7, pr - h, w, d), part(8, pr - h, F.lit(nx), d))
        return F.when(pr < 0, top).when(pr >= h, bot).otherwise(mid)

    return let(F.col("data"), lambda d: F.flatten(
        F.transform(F.sequence(F.lit(-ny), h + ny - 1), lambda pr: prow(pr, d))))


def _focal_from_padded(df: DataFrame, fn: str, nx: int, ny: int, edge: str,
                       pixel_type: str | None) -> DataFrame:
    w, h, nod = F.col("width"), F.col("height"), F.col("nodata")
    pw = w + 2 * nx

    def window(i, pad):
        r = F.floor(i / w).cast("int")
        c = (i % w).cast("int")
        return F.array(*[pad[(r + dy + ny) * pw + (c + dx + nx)]
                         for dy in range(-ny, ny + 1) for dx in range(-nx, nx + 1)])

    # Staged: every array is built once per tile, so no window is evaluated twice.
    df = df.withColumn("_win", let(F.col("_pad"), lambda pad: F.transform(
        F.sequence(F.lit(0), w * h - 1), lambda i: window(i, pad))))
    df = df.withColumn("_red", F.transform("_win", lambda wv: _reduce(wv, fn, nod)))

    def final(x):
        v = x["v"]
        if pixel_type == "input":
            v = clamp_to_type_col(v, F.col("pixel_type"))
        elif pixel_type is not None:
            v = clamp_to_type(v, pixel_type)
        none = F.when(nod.isNull(), F.raise_error(F.lit(NO_NODATA)).cast("double")).otherwise(nod)
        if edge == "nodata":
            v = F.when(x["full"], v)
        return F.when(v.isNull(), none).otherwise(v)

    df = df.withColumn("data", F.transform("_red", final))
    return df.select(*TILE_COLUMNS)


def _declared(tiles: DataFrame, nodata: float | None) -> DataFrame:
    return tiles if nodata is None else tiles.withColumn("nodata", F.coalesce("nodata", F.lit(float(nodata))))


def focal(tiles: DataFrame, fn: str = "mean", nx: int = 1, ny: int = 1, scope: str = "tile",
          edge: str = "nodata", pixel_type: str | None = "input", engine: str = "numpy",
          nodata: float | None = None) -> DataFrame:
    """Focal ``fn`` over a ``(2nx+1) x (2ny+1)`` window.

    Pixels without a result become the tile's NoData, or ``nodata`` where the
    raster declares none; with neither such a pixel fails the query.

    ``pixel_type='input'`` forces results back into each tile's own pixel
    type (the reference passes a NULL type); ``None`` keeps doubles; any
    other name forces that type.
    """
    if fn not in BUILTIN:
        raise ValueError(f"use focal_udf for {fn!r}")
    if scope not in ("tile", "mosaic"):
        raise ValueError(scope)
    tiles = _declared(tiles, nodata)
    if engine == "numpy":
        return _focal_arrow(tiles, ("builtin", fn), nx, ny, scope, edge, pixel_type)
    if scope == "tile":
        t = tiles.select(*TILE_COLUMNS).withColumn("_pad", _padded(nx, ny, neighbours=False))
    else:
        if max(_rings(tiles, nx, ny)) > 1:
            raise ValueError("a window wider than a tile needs engine='numpy'")
        t = halo_groups(tiles, nx, ny)
        # own tile and the 8 neighbour pieces in a fixed order (null: no neighbour)
        t = t.withColumn("_p", F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.try_element_at(
            F.filter("pieces", lambda p: p["k"] == k), F.lit(1))))
        t = t.withColumn("data", F.col("_p")[4]["block"])
        t = t.withColumn("_pad", _padded(nx, ny, neighbours=True))
    return _focal_from_padded(t, fn, nx, ny, edge, pixel_type)


def _block_size(tiles: DataFrame) -> tuple[int, int]:
    """Pixels of a full tile: one aggregate row over the key columns."""
    r = tiles.agg(F.max("width"), F.max("height")).first()
    return r[0] or 1, r[1] or 1


def _rings(tiles: DataFrame, nx: int, ny: int) -> tuple[int, int]:
    """How many tiles a window reaches to each side."""
    tw, th = _block_size(tiles)
    return -(-nx // tw), -(-ny // th)


def halo_groups(tiles: DataFrame, nx: int, ny: int) -> DataFrame:
    """Each tile plus the strips that its neighbours give, on the tile key:
    ``(tile columns but data..., pieces)``; a piece is ``(k, x0, y0, bw, bh,
    block)`` with the raster position of its first pixel, and ``k = (dy+1)*3 +
    (dx+1)`` the sender's place next to the target tile (4 = the tile itself,
    -1 = farther away).

    Only the strips move: they are grouped per target tile (a bounded group,
    as many strips as the window reaches tiles) and joined to the tile table on
    its key, so a table bucketed on the key is not shuffled at all."""
    strips = _halo_strips(tiles, nx, ny)
    meta = [c for c in TILE_COLUMNS if c != "data"]
    t = tiles.select(*meta, _own_piece().alias("_own"))
    j = t.join(strips, ["tile_col", "tile_row"], "left")
    none = F.array().cast(strips.schema["pieces"].dataType)
    return j.select(*meta, F.concat(F.array("_own"), F.coalesce("pieces", none)).alias("pieces"))


def _own_piece() -> Column:
    return F.struct(F.lit(4).alias("k"), F.col("px0").alias("x0"), F.col("py0").alias("y0"), F.col("width").alias("bw"),
                    F.col("height").alias("bh"), F.col("data").alias("block"))


def _halo_strips(tiles: DataFrame, nx: int, ny: int) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    tw, th = _block_size(tiles)
    kx, ky = -(-nx // tw), -(-ny // th)
    offs = [(dx, dy) for dy in range(-ky, ky + 1) for dx in range(-kx, kx + 1) if (dx, dy) != (0, 0)]

    def strip(d, dx, dy):
        # the part of this tile that the tile at (dx, dy) from it needs
        cs, ce = F.greatest(F.lit(dx * tw - nx), F.lit(0)), F.least(F.lit((dx + 1) * tw + nx), w)
        rs, re = F.greatest(F.lit(dy * th - ny), F.lit(0)), F.least(F.lit((dy + 1) * th + ny), h)
        some = (ce > cs) & (re > rs)
        block = F.when(some, F.flatten(F.transform(F.sequence(rs, re - 1), lambda r: F.slice(d, r * w + cs + 1, ce - cs))))
        k = (1 - dy) * 3 + (1 - dx) if max(abs(dx), abs(dy)) == 1 else -1
        return F.struct((F.col("tile_col") + dx).alias("tile_col"), (F.col("tile_row") + dy).alias("tile_row"),
                        F.struct(F.lit(k).alias("k"), (F.col("px0") + cs).alias("x0"), (F.col("py0") + rs).alias("y0"),
                                 (ce - cs).alias("bw"), (re - rs).alias("bh"), block.alias("block")).alias("piece"))

    # all strips are cut before the explode, so its rows carry a strip each and no tile
    strips = let(F.col("data"), lambda d: F.array(*[strip(d, dx, dy) for dx, dy in offs]))
    p = tiles.select(F.explode(strips).alias("s")).select("s.*").where(F.col("piece.block").isNotNull())
    return p.groupBy("tile_col", "tile_row").agg(F.collect_list("piece").alias("pieces"))


# ---------------------------------------------------------------- numpy engine, X1

def focal_udf(tiles: DataFrame, func: Callable[[np.ndarray], np.ndarray | float], nx: int = 1, ny: int = 1,
              scope: str = "tile", edge: str = "nodata", vectorized: bool = True,
              pixel_type: str | None = None, nodata: float | None = None) -> DataFrame:
    """A user neighbourhood function.  It gets many windows at once (some rows
    of a tile, ``WINDOW_CELLS`` values at most or one row of windows), an
    ``(n, (2ny+1)*(2nx+1))`` float array, and returns ``n`` values.  With
    ``vectorized=False`` it is called for every window alone, with a
    ``(2ny+1, 2nx+1)`` array, which is far slower.  NoData and missing cells are NaN; a NaN or
    None result becomes NoData.  Runs in ``mapInArrow`` on whole tiles;
    ``scope='mosaic'`` first adds the halo from neighbours."""
    _ship_by_value(func)
    return _focal_arrow(_declared(tiles, nodata), ("vectorized" if vectorized else "python", func), nx, ny, scope, edge, pixel_type)


def _bound_arrow_batches(spark) -> None:
    from tilespark.session import bound_arrow_batches
    bound_arrow_batches(spark)


def _focal_arrow(tiles: DataFrame, how, nx: int, ny: int, scope: str, edge: str,
                 pixel_type: str | None) -> DataFrame:
    meta = [c for c in TILE_COLUMNS if c != "data"]
    if scope == "mosaic":
        t = halo_groups(tiles, nx, ny)
    elif scope == "tile":
        t = tiles.select(*TILE_COLUMNS).withColumn("pieces", F.array(_own_piece())).drop("data")
    else:
        raise ValueError(scope)
    _bound_arrow_batches(tiles.sparkSession)
    schema = tiles.select(*TILE_COLUMNS).schema
    kind, f = how
    _ship_by_value(f if callable(f) else None)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            yield _focal_batch(b, kind, f, nx, ny, edge, pixel_type, meta, pa)

    return t.select(*meta, "pieces").mapInArrow(run, schema)


#: Values of the windows that a user function gets at once, or of one row of windows if that is more.
WINDOW_CELLS = 1 << 22


def _called(func, kind: str, view: np.ndarray) -> np.ndarray:
    """A user function's results for some rows of windows."""
    h, w, wy, wx = view.shape
    if kind == "vectorized":
        return np.asarray(func(view.reshape(h * w, wy * wx)), dtype=np.float64).reshape(h, w)
    return np.array([[np.nan if (v := func(np.array(x))) is None else v for x in row] for row in view], dtype=np.float64).reshape(h, w)


def _ship_by_value(func) -> None:
    from tilespark.session import ship_by_value
    ship_by_value(__name__, *([func] if func is not None else []))


def _clamp_np(v: np.ndarray, pixel_type: str | None) -> np.ndarray:
    if pixel_type == "32BF":
        return v.astype(np.float32).astype(np.float64)
    rng = PIXEL_RANGES.get(pixel_type) if pixel_type else None
    if rng is None:
        return v
    return np.trunc(np.clip(v, rng[0], rng[1]))


def _focal_batch(b, kind, func, nx, ny, edge, pixel_type, meta, pa):
    """One Arrow batch of tiles (with their halo pieces) -> output tiles."""
    from numpy.lib.stride_tricks import sliding_window_view
    n = b.num_rows
    widths = b.column("width").to_numpy(zero_copy_only=False)
    heights = b.column("height").to_numpy(zero_copy_only=False)
    nod_col = b.column("nodata")
    nods = nod_col.to_numpy(zero_copy_only=False) if nod_col.null_count < n else np.full(n, np.nan)
    nod_valid = ~np.asarray(nod_col.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    ptypes = b.column("pixel_type").to_pylist()
    pieces = b.column("pieces")
    p_off = pieces.offsets.to_numpy()
    st = pieces.values
    xs, ys = (st.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0"))
    px, py = (b.column(c).to_numpy(zero_copy_only=False) for c in ("px0", "py0"))
    bws = st.field("bw").to_numpy(zero_copy_only=False)
    bhs = st.field("bh").to_numpy(zero_copy_only=False)
    blocks = st.field("block")
    b_off = blocks.offsets.to_numpy()
    b_val = blocks.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    wy, wx = 2 * ny + 1, 2 * nx + 1
    outs, offsets = [], [0]
    for i in range(n):
        w, h = int(widths[i]), int(heights[i])
        pad = np.full((h + 2 * ny, w + 2 * nx), np.nan)
        for j in range(p_off[i], p_off[i + 1]):
            bw, bh = int(bws[j]), int(bhs[j])
            r0, c0 = int(ys[j] - py[i]) + ny, int(xs[j] - px[i]) + nx
            block = b_val[b_off[j]:b_off[j + 1]].reshape(bh, bw)
            part = pad[max(r0, 0):r0 + bh, max(c0, 0):c0 + bw]
            part[...] = block[max(-r0, 0):, max(-c0, 0):][:part.shape[0], :part.shape[1]]
        avail = ~np.isnan(pad)
        nod = nods[i] if nod_valid[i] else None
        if nod is not None:
            pad[pad == nod] = np.nan
        if kind == "builtin":
            out = _reduce_np(pad, func, nx, ny)
        else:
            view = sliding_window_view(pad, (wy, wx))
            rows = max(1, WINDOW_CELLS // (w * wy * wx))
            parts = [_called(func, kind, view[r:r + rows]) for r in range(0, h, rows)]
            out = np.concatenate(parts) if parts else np.empty((0, w))
        if edge == "nodata":
            out = np.where(windows(avail.astype(np.float64), nx, ny, np.add) == wx * wy, out, np.nan)
        pt = ptypes[i] if pixel_type == "input" else pixel_type
        out = _clamp_np(out.ravel(), pt)
        missing = np.isnan(out)
        if missing.any():
            if nod is None:
                raise ValueError(NO_NODATA)
            out = np.where(missing, nod, out)
        outs.append(out)
        offsets.append(offsets[-1] + out.size)
    values = pa.array(np.concatenate(outs) if outs else np.empty(0), type=pa.float64())
    data = pa.ListArray.from_arrays(pa.array(np.asarray(offsets, dtype=np.int32)), values)
    cols = [b.column(c) for c in meta] + [data]
    return pa.RecordBatch.from_arrays(cols, names=meta + ["data"]).select(TILE_COLUMNS)


def running(x: np.ndarray, size: int, op: np.ufunc, axis: int) -> np.ndarray:
    """``op`` over every stretch of ``size`` neighbours along an axis (van Herk, Gil and
    Werman): running results from both ends of blocks of ``size`` values, two of which make up
    any stretch.  Three operations a value whatever the size, and no
    subtraction, so sums lose nothing by cancellation."""
    x = np.moveaxis(x, axis, -1)
    n = x.shape[-1]
    if size == 1:
        return np.moveaxis(x, -1, axis)
    none = {np.add: 0.0, np.fmin: np.inf, np.fmax: -np.inf}[op]
    blocks = -(-n // size)
    full = np.full((*x.shape[:-1], blocks * size), none)
    full[..., :n] = x
    parts = full.reshape(*x.shape[:-1], blocks, size)
    ahead = op.accumulate(parts, axis=-1).reshape(full.shape)
    behind = op.accumulate(parts[..., ::-1], axis=-1)[..., ::-1].reshape(full.shape)
    i = np.arange(n - size + 1)
    both = op(behind[..., i], ahead[..., i + size - 1])
    whole = i % size == 0  # the stretch is a block: not to be counted twice
    both[..., whole] = behind[..., i[whole]]
    return np.moveaxis(both, -1, axis)


def windows(x: np.ndarray, nx: int, ny: int, op: np.ufunc) -> np.ndarray:
    """``op`` over every ``(2ny+1) x (2nx+1)`` window that lies in the array, rows after columns."""
    return running(running(x, 2 * nx + 1, op, 1), 2 * ny + 1, op, 0)


def _reduce_np(pad: np.ndarray, fn: str, nx: int, ny: int) -> np.ndarray:
    """Built-in window reductions; the work does not grow with the window."""
    ok = ~np.isnan(pad)
    count = windows(ok.astype(np.float64), nx, ny, np.add)
    if fn == "count":
        return count
    op, none = {"mean": (np.add, 0.0), "sum": (np.add, 0.0), "min": (np.fmin, np.inf), "max": (np.fmax, -np.inf)}[fn]
    out = windows(np.where(ok, pad, none), nx, ny, op)
    if fn == "mean":
        out = out / np.maximum(count, 1)
    return np.where(count > 0, out, np.nan)
