"""Run-log report (P13: A18, D19, D20) over text log lines.

Input rows: (file_name, line_no, value) from ``sources.io.read_text_logs``.
Progress bars are carriage-return separated segments on one physical line;
the visible state is the last segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MARKER = ">>>"                                # fixed value: progress marker written by the replay
JOB_FILE = r"^sim_(\d+)_(\d+)\.(out|err)$"    # fixed value: '<prefix>_<job>_<task>.<ext>' log names
NO_PROGRESS = "no progress yet"


def last_segment(value) -> F.Column:
    """The text after the last carriage return of a physical line."""
    return F.element_at(F.split(value, "\r"), -1)


def latest_progress(lines: DataFrame) -> DataFrame:
    """Per task, the newest job's latest progress marker line (default text when none)."""
    d = lines.select("file_name", "line_no", last_segment(F.col("value")).alias("line"),
                     F.regexp_extract("file_name", JOB_FILE, 1).cast("long").alias("job_id"),
                     F.regexp_extract("file_name", JOB_FILE, 2).cast("int").alias("task_id"))
    d = d.where(F.col("job_id").isNotNull())
    newest = d.groupBy("task_id").agg(F.max("job_id").alias("job_id"))
    marks = d.where(F.col("line").contains(MARKER)).groupBy("task_id", "job_id").agg(
        F.max_by("line", "line_no").alias("progress"))
    return (newest.join(marks, ["task_id", "job_id"], "left")
            .select("task_id", "job_id", F.coalesce("progress", F.lit(NO_PROGRESS)).alias("progress")))


def error_tails(lines: DataFrame, n: int = 3) -> DataFrame:
    """Non-empty error files with their size in characters and their last ``n`` lines."""
    e = lines.where(F.col("file_name").endswith(".err"))
    w = Window.partitionBy("file_name").orderBy(F.col("line_no").desc())
    tail = (e.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
             .groupBy("file_name").agg(F.array_join(F.transform(
                 F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), "\n").alias("tail")))
    size = e.groupBy("file_name").agg((F.sum(F.length("value") + 1)).alias("size"))
    return size.where(F.col("size") > 0).join(tail, "file_name")
