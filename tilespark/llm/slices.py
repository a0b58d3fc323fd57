"""Documents packed into slices: one row holds the bytes of many documents.

The table is bucketed by slice number, so small per-slice answers can be joined
to it again and again without shuffling texts, and a slice keeps its number and
its documents whatever is computed again after a lost executor.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import fresh_dir
from tilespark.session import ship_by_value

LAST = (1 << 63) - 1  # order number of a null id
SLICE = "slice long, ids array<long>, marks array<boolean>, ends array<long>, data binary"


def pack_slices(docs: DataFrame, id_col: str, text_col: str, n: int, mark: Column | None = None,
                slice_bytes: int = 2 << 20, slice_docs: int = 8192) -> DataFrame:
    """Slices of about ``slice_bytes`` in a table of ``n`` buckets, stored in the shared
    folder; ``marks`` holds ``mark`` of each document."""
    ship_by_value("tilespark.llm.slices")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"),
                       (F.lit(False) if mark is None else F.coalesce(mark, F.lit(False))).alias("mark"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        marks: list[bool] = []
        texts: list[bytes] = []
        size = 0

        def packed() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts])
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([marks], pa.list_(pa.bool_())), pa.array([ends], pa.list_(pa.int64())),
                 pa.array([b"".join(texts)], pa.binary())], ["slice", "ids", "marks", "ends", "data"])

        for b in batches:
            for i, m, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                t = t.as_py()
                ids.append(i), marks.append(m), texts.append(t)
                size += len(t)
                if size >= slice_bytes or len(ids) >= slice_docs:
                    yield packed()
                    ids, marks, texts, size = [], [], [], 0
        if ids:
            yield packed()

    name = f"llm_slices_{uuid.uuid4().hex}"
    path = fresh_dir(docs.sparkSession, "slices")
    (rows.mapInArrow(run, SLICE).write.option("compression", "zstd").option("path", path)
     .bucketBy(n, "slice").sortBy("slice").format("parquet").saveAsTable(name))
    return docs.sparkSession.table(name)


def loaded(ids, ends, data) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array(ids, np.int64), np.array(ends, np.int64), np.frombuffer(data, np.uint8)


def low_bytes(x: np.ndarray, n: int) -> bytes:
    """The low ``n`` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def from_low_bytes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on in 1, 2, 4 or 8 bytes each, after a byte that says which."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or x.max() < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def packed_ascending(x: np.ndarray) -> bytes:
    """Ascending numbers as their first and packed steps."""
    return int(x[0]).to_bytes(8, "little", signed=True) + packed(np.diff(x))


def unpacked_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(np.r_[int.from_bytes(data[:8], "little", signed=True), unpacked(data[8:])])
