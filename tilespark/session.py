"""Session helpers: a SparkSession tuned for tile workloads, and the shared
checkpoint folder used to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for tile tables: AQE re-plans joins from runtime sizes
# (a zone-span side that turns out small becomes a broadcast), coalesces the
# many small shuffle partitions of per-zone results, and splits skewed joins.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A broadcast is only ever decided on a measured (runtime) size.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tilespark") -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("TILESPARK_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Scratch folders of local sessions, and checkpoint folders that were set, by application.
_SCRATCH: dict[str, str] = {}
_SET: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set to a shared file system; unset, this raises.
    Only a session whose executors are threads of the driver (``local[..]``,
    tests) gets a scratch folder of its own, one for the whole application.
    """
    app = spark.sparkContext.applicationId
    d = spark.conf.get("spark.checkpoint.dir", None) or _SCRATCH.get(app)
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = _SCRATCH[app] = tempfile.mkdtemp(prefix="tilespark-ckpt-")
    if _SET.get(app) != d:
        spark.sparkContext.setCheckpointDir(d)
        _SET[app] = d
    return d


def ship_by_value(*objs) -> None:
    """Make Python workers receive this package's functions (and a user's
    function module) by value, so nothing has to be installed on them.  On a
    cluster, shipping the package with ``--py-files`` does the same."""
    import sys
    from pyspark import cloudpickle
    names = set()
    for o in objs:
        name = o if isinstance(o, str) else getattr(o, "__module__", None)
        if name:
            names.add(name)
    for name in names:
        mod = sys.modules.get(name)
        if mod is not None and name not in ("__main__", "builtins"):
            try:
                cloudpickle.register_pickle_by_value(mod)
            except (ValueError, TypeError):
                pass


def bound_arrow_batches(spark) -> None:
    """Tile rows are large: keep Arrow batches to tens of MB, not 10k rows.
    Operators that hand whole tiles to Python call this; it sets the session's
    Arrow batch limits (both only bound memory, no result depends on them)."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "", str(2 ** 31 - 1)):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 * 1024 * 1024))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 1024:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
