"""Exact k-means on integer vectors, with zone maps over a Hilbert order.

Vectors are sorted along a Hilbert curve (a distributed range sort), cut into
blocks of neighbours, and every block keeps the least and greatest value of each
component, its box.  In a round a block compares the distances from its box to
all centroids: a centroid whose least distance to the box is above the smallest
greatest distance cannot be nearest to any vector inside.  The others are the
block's candidates and are compared exactly, in integers.

The blocks are stored once; a round reads them, adds up one sum per centroid and
task, and only these sums meet on the driver (k times the components, whatever
the number of vectors).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilespark.llm.common import partitions, stored
from tilespark.session import bound_arrow_batches, ship_by_value

#: Integer components must be smaller than this, so that squared distances fit a long.
MOST = 1 << 27
#: Below this, sums of products are exact in doubles too.
EXACT_IN_DOUBLES = 1 << 21
CURVE_BITS = 8


class Clusters(NamedTuple):
    vectors: DataFrame  # id, cluster, distance
    centroids: list[list[int]]


def integers(batch: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the valid vectors in a list column, and their components as floor(scale * x)."""
    sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(sizes == dims)
    if not len(right):
        return right, np.zeros((0, dims), np.int64)
    flat = pc.list_flatten(batch.take(pa.array(right))).cast(pa.float64())
    x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
    ok = np.isfinite(x).all(axis=1)
    x = np.floor(scale * x[ok])
    if x.size and np.abs(x).max() >= MOST:
        raise ValueError(f"a component times {scale} is beyond {MOST}: squared distances would not fit a long")
    return right[ok], x.astype(np.int64)


def to_bytes(v: np.ndarray) -> np.ndarray:
    """Rows of integers as bytes whose order is the order of the components."""
    return np.ascontiguousarray((v + (1 << 31)).astype(">u4")).view(np.uint8).reshape(len(v), 4 * v.shape[1])


def from_bytes(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, ">u4").astype(np.int64).reshape(-1, dims) - (1 << 31)


def hilbert_keys(v: np.ndarray, lo: int, hi: int, bits: int = CURVE_BITS) -> list[bytes]:
    """Position of each row on a Hilbert curve through the cube [lo, hi]^dims, as bytes in curve order."""
    x = ((v - lo) * ((1 << bits) - 1) // max(1, hi - lo)).astype(np.int64)
    n, dims = x.shape
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the curve, from the coarsest level on
        for i in range(dims):
            up = (x[:, i] & q) != 0
            swap = np.where(up, 0, (x[:, 0] ^ x[:, i]) & (q - 1))
            x[:, 0] ^= np.where(up, q - 1, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code over the components
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[:, -1] & q, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    return [r.tobytes() for r in np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)]


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector of the box."""
    gap = np.maximum(np.maximum(lo - centroids, centroids - hi), 0)
    far = np.maximum(np.abs(centroids - lo), np.abs(hi - centroids))
    return np.flatnonzero((gap * gap).sum(axis=1) <= (far * far).sum(axis=1).min())


def nearest(v: np.ndarray, centroids: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the centroids ``which`` (ascending, so ties go to the smaller number) and its squared distance."""
    c = centroids[which]
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < EXACT_IN_DOUBLES:
        a, b = v.astype(np.float64), c.astype(np.float64)
        d = ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    else:
        d = np.stack([((v - x) ** 2).sum(axis=1) for x in c], axis=1)
    best = d.argmin(axis=1)
    return which[best], d[np.arange(len(v)), best]


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64,
                    k: int = 40, rounds: int = 5, scale: int = 256, seed: str = "2", block_rows: int = 512) -> Clusters:
    """``id``, ``cluster`` (int) and squared ``distance`` (long) of every valid vector, and the centroids.

    Valid are vectors of exactly ``dims`` components, none null or not finite;
    others give no row.  The first centroids are the ``k`` vectors with the
    smallest sha256 of ``seed:id`` (a null id counts as the empty text; equal
    hashes are ordered by their components), fewer if there are fewer.  Rows
    that repeat an id or a vector each get a row; further columns are ignored;
    an empty table gives no rows and no centroids.  A component of 2^27 or
    more after scaling fails, as its distances would not fit a long.
    """
    spark = vectors.sparkSession
    ship_by_value("tilespark.llm.centroids")
    bound_arrow_batches(spark)
    n = partitions(spark)
    id_type = vectors.schema[id_col].dataType
    own = T.StructType([T.StructField("id", id_type), T.StructField("v", T.BinaryType()),
                        T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, v = integers(b.column(1), dims, scale)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array([r.tobytes() for r in to_bytes(v)], pa.binary()),
                 pa.array(v.min(axis=1) if len(v) else [], pa.int64()), pa.array(v.max(axis=1) if len(v) else [], pa.int64())],
                ["id", "v", "lo", "hi"])

    kept = stored(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(read, own), "vectors")
    lo, hi = kept.agg(F.min("lo"), F.max("hi")).first()
    order = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = kept.select("v", order.alias("h")).orderBy("h", "v").limit(k).collect()
    centroids = np.concatenate([from_bytes(r["v"], dims) for r in first]) if first else np.zeros((0, dims), np.int64)

    keyed_type = T.StructType([own["id"], own["v"], T.StructField("salt", T.LongType()), T.StructField("key", T.BinaryType())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = from_bytes(b"".join(b.column(1).to_pylist()), dims)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hilbert_keys(v, lo, hi) if len(v) else [], pa.binary())],
                                             ["id", "v", "salt", "key"])

    block_type = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("data", T.BinaryType()),
                               T.StructField("box", T.BinaryType())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        data: list[bytes] = []

        def block() -> pa.RecordBatch:
            rows = b"".join(data)
            v = from_bytes(rows, dims)
            box = to_bytes(np.stack([v.min(axis=0), v.max(axis=0)])).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(id_arrow)), pa.array([rows]), pa.array([box])],
                                              ["ids", "data", "box"])

        for b in batches:
            id_arrow = b.schema.field(0).type
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i), data.append(v)
                if len(ids) == block_rows:
                    yield block()
                    ids, data = [], []
        if ids:
            yield block()

    # the salt is the row's place in a stored table: equal vectors are dealt over several ranges, the same on every run
    salted = kept.select("id", "v", F.monotonically_increasing_id().alias("salt")).mapInArrow(keyed, keyed_type)
    ranged = salted.repartitionByRange(n, "key", "salt").sortWithinPartitions("key", "salt").select("id", "v")
    zones = stored(ranged.mapInArrow(blocks, block_type), "vector-blocks")

    def told(b: pa.RecordBatch, now: np.ndarray) -> Iterator[tuple]:
        for ids, data, box in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
            v = from_bytes(data, dims)
            edges = from_bytes(box, dims)
            yield (ids, v, *nearest(v, now, candidates(edges[0], edges[1], now)))

    def totals(now: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(len(now), np.int64), np.zeros((len(now), dims), np.int64)
            for b in batches:
                for _, v, cluster, _ in told(b, now):
                    count += np.bincount(cluster, minlength=len(now))
                    np.add.at(total, cluster, v)
            here = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(here, pa.int32()), pa.array(count[here], pa.int64()),
                                              pa.array(total[here].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])
        return run

    for _ in range(rounds if len(centroids) else 0):
        parts = zones.mapInArrow(totals(centroids), "cluster int, n long, total array<long>")
        wide = "decimal(38,0)"  # sums of any number of vectors stay exact
        sums = (parts.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i")
                .agg(F.sum("n").alias("n"), F.sum(F.col("x").cast(wide)).alias("x")).collect())  # k * dims rows at most
        centroids = centroids.copy()
        for r in sums:
            centroids[r["cluster"], r["i"]] = int(r["x"]) // r["n"]

    last = centroids
    result = T.StructType([T.StructField("id", id_type), T.StructField("cluster", T.IntegerType()),
                           T.StructField("distance", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, _, cluster, distance in told(b, last):
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                                                 ["id", "cluster", "distance"])

    return Clusters(zones.mapInArrow(assign, result), centroids.tolist())
