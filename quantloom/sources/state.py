"""Atomic agent state (A16, A17): snapshots that are either whole or absent.

A snapshot is a folder of its own under ``snapshots/`` with one table per part of the state.  Its manifest, one row
under ``manifests/``, is written last, by a job whose commit makes the row appear at once; a snapshot without
a manifest does not exist for readers.  Saving again never touches an earlier snapshot, so a state that is
being read stays readable; the folder's retention policy removes old ones.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("params", "memory", "removed_ids", "portfolio")
_KEYS = {"memory": ["symbol", "layer"], "portfolio": ["symbol"]}
_MANIFEST = "version long, folder string, tables array<string>, rows array<long>"


def _manifests(spark: SparkSession, path: str) -> list:
    try:
        rows = spark.read.schema(_MANIFEST).json(os.path.join(path, "manifests", "*")).collect()   # one per snapshot
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(rows, key=lambda r: (r.version, r.folder))


def is_snapshot_store(spark: SparkSession, path: str) -> bool:
    return bool(_manifests(spark, path))


def write_table(df: DataFrame, path: str, keys: list[str] | None) -> None:
    """A table partitioned by the keys, its rows brought together by key first (large keys stay several tasks)."""
    if keys:
        df.hint("rebalance", *keys).write.partitionBy(*keys).parquet(path)
    else:
        df.write.parquet(path)


def save_snapshot(path: str, tables: dict[str, DataFrame], force: bool = False) -> str:
    """Write a snapshot of the given tables; refuses a path that holds one already unless ``force``.

    Returns the snapshot's folder.
    """
    spark = next(iter(tables.values())).sparkSession
    before = _manifests(spark, path)
    if before and not force:
        raise FileExistsError(f"{path} already exists: it holds a complete state")
    version = before[-1].version + 1 if before else 1
    folder = os.path.join("snapshots", f"{version:08d}-{uuid.uuid4().hex[:8]}")
    names, counts = [], []
    for name, df in tables.items():
        where = os.path.join(path, folder, name)
        write_table(df, where, _KEYS.get(name))
        names.append(name)
        counts.append(spark.read.parquet(where).count())
    manifest = spark.createDataFrame([(version, folder, names, counts)], _MANIFEST)
    manifest.coalesce(1).write.json(os.path.join(path, "manifests", os.path.basename(folder)))
    return folder


def load_snapshot(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the newest (or the given) complete snapshot."""
    found = [m for m in _manifests(spark, path) if version is None or m.version == version]
    if not found:
        raise FileNotFoundError(f"{path} holds no complete state" + ("" if version is None else f" {version}"))
    return {name: spark.read.parquet(os.path.join(path, found[-1].folder, name)) for name in found[-1].tables}


def versions(spark: SparkSession, path: str) -> DataFrame:
    """version, folder, tables, rows of the complete snapshots."""
    return spark.createDataFrame([tuple(m) for m in _manifests(spark, path)], _MANIFEST).orderBy(F.desc("version"))
