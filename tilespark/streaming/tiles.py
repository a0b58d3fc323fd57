"""Stateless per-tile operators on a stream of tiles.

The reference is batch only; its per-tile operators (NoData remap,
reclassify, pixel-type clamp, per-tile summaries) need no state, so they run
unchanged on a Structured Streaming source of tile files: new tiles are
processed as they land, with exactly-once output through the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tilespark.model import TILE_COLUMNS


def read_tile_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """A streaming DataFrame of the tile files arriving under ``path``."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def run_tile_stream(spark: SparkSession, src: str, dst: str, checkpoint: str,
                    op: Callable[[DataFrame], DataFrame], schema, available_now: bool = True) -> StreamingQuery:
    """Apply a per-tile operator to every new tile file and append the
    result to ``dst`` (Parquet).  ``checkpoint`` must be on shared storage."""
    out = op(read_tile_stream(spark, src, schema)).select(*TILE_COLUMNS)
    w = out.writeStream.format("parquet").option("path", dst).option("checkpointLocation", checkpoint)
    w = w.outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
