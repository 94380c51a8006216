"""Session construction and lineage cutting.

Cluster settings win: nothing here overrides a value the cluster already
set. ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the session and
only falls back to a fresh local folder when the setting is absent (tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Defaults for a session we create ourselves; a running cluster session keeps its own.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "quantloom", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # The oracle comparison and every date rule assume UTC wall-clock values.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster; a scratch folder only when unset (tests)."""
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        try:
            cur = spark.sparkContext.getCheckpointDir()
        except Exception:  # noqa: BLE001 - no SparkContext on a remote session
            cur = None
    if not cur:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        cur = _LOCAL_FALLBACK.setdefault("dir", tempfile.mkdtemp(prefix="quantloom-ckpt-"))
        try:
            spark.conf.set("spark.checkpoint.dir", cur)
        except Exception:  # noqa: BLE001 - a core setting may be read-only at runtime
            pass
    return cur


_LOCAL_FALLBACK: dict = {}


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, name: str = "stage", drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared checkpoint folder and read it back.

    The plan is computed exactly once (an RDD checkpoint would compute it twice
    unless cached), the result survives executor loss, and later branches of
    the plan scan the table instead of re-running its lineage.  With ``drop_shuffles`` Spark
    deletes the shuffle files of the write when the table is there, not at the next driver GC.
    """
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"stages/{name}_{uuid.uuid4().hex[:12]}")
    before = spark.conf.get(_CLEANUP, None)
    try:
        if drop_shuffles:
            spark.conf.set(_CLEANUP, "true")
        df.write.mode("overwrite").parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A table location under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name)
