"""A streaming source whose offset is the replay step.

A landing folder holds one sub-folder of Parquet files per step (``land_by_step``).  The source offers whole steps in
rising order, at most ``steps_per_trigger`` new ones at a time, so a micro-batch never holds part of a step
and never a step before its predecessors, whatever the files' names and times are.  The driver
lists folders only; an executor reads about ``PARTITION_BYTES`` of files in Arrow batches.

Steps that land while a query runs, or between two runs on one checkpoint, follow as long as they come
after the last step taken; a step that lands behind it is never read (the file source with a watermark is
for input without an order: ``streaming.stateful``).

Paths are read through ``pyarrow.fs`` (local folders, HDFS, S3, GCS), which has to reach the landing folder
from the driver and the executors.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME = "quantloom_steps"
BEFORE_ALL = -(1 << 53)
READ_ROWS = 10_000
PARTITION_BYTES = 64 << 20      # of files read by one task
OPEN_BYTES = 1 << 20            # what opening a file counts for


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    # Hadoop writes local URIs with one slash
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _names(path: str, pattern: str) -> dict[int, str]:
    """Number -> path of the entries of a folder whose names match the pattern."""
    fs, base = _open(path)
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return {int(m[1]): f.path for f in found if (m := re.fullmatch(pattern, f.base_name))}


def last_logged_step(checkpoint: str) -> int:
    """The step that the query's offset log ends with; ``BEFORE_ALL`` for a new query."""
    logs = _names(checkpoint.rstrip("/") + "/offsets", r"(\d+)")
    if not logs:
        return BEFORE_ALL
    fs, _ = _open(checkpoint)
    with fs.open_input_stream(logs[max(logs)]) as f:
        return json.loads(f.read().decode().strip().split("\n")[-1])["step"]


@dataclass
class StepFiles(InputPartition):
    files: list[tuple[int, str]]        # (step, path), small files together


class StepReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.most = int(options.get("steps_per_trigger") or 0)
        self.checkpoint = options.get("checkpoint") or ""
        self.at = None          # the last step handed to the engine

    def initialOffset(self) -> dict:
        return {"step": BEFORE_ALL}

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = last_logged_step(self.checkpoint) if self.checkpoint else BEFORE_ALL
        new = sorted(s for s in _names(self.path, r"step=(-?\d+)") if s > self.at)
        new = new[:self.most] if self.most else new
        return {"step": new[-1] if new else self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(end["step"], end["step"] if self.at is None else self.at)
        fs, _ = _open(self.path)
        folders = _names(self.path, r"step=(-?\d+)")
        packed, room = [], 0
        for step in sorted(s for s in folders if start["step"] < s <= end["step"]):
            for f in fs.get_file_info(pafs.FileSelector(folders[step])):
                if f.is_file and f.size and f.base_name[0] not in "._":
                    if room < f.size:
                        packed.append(StepFiles([]))
                        room = PARTITION_BYTES
                    room -= f.size + OPEN_BYTES
                    packed[-1].files.append((step, f.path))
        return packed

    def read(self, partition: StepFiles):
        fs, _ = _open(self.path)
        target = to_arrow_schema(self.schema)
        for step, path in partition.files:
            with fs.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(READ_ROWS):
                    cols = [pa.array([step] * batch.num_rows, field.type) if field.name == "step"
                            else batch.column(field.name).cast(field.type) for field in target]
                    yield pa.RecordBatch.from_arrays(cols, schema=target)


class StepSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return self.options["row_schema"]

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StepReader(dict(self.options), schema)


def read_steps(spark: SparkSession, path: str, schema: str, checkpoint: str,
               steps_per_trigger: int | None = None) -> DataFrame:
    """The stream of the landed steps; ``schema`` (DDL) holds the rows' columns and may hold ``step``.

    ``checkpoint`` is the checkpoint folder of the query that will run: a restarted query goes on from its log.
    """
    spark.dataSource.register(StepSource)
    return (spark.readStream.format(NAME).option("path", path).option("row_schema", schema)
            .option("checkpoint", checkpoint).option("steps_per_trigger", steps_per_trigger or 0).load())
