"""Scans, sinks and checkpoints.

Every reader takes an explicit schema (no inference on the hot path); every
writer partitions by the key readers filter on, so partition pruning applies.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantloom.functions.text import file_safe
from quantloom.sources.state import is_snapshot_store, load_snapshot, save_snapshot

NEWS_CSV_SCHEMA = "item_id long, symbol string, dates timestamp_ntz, headline string, body string, item_language string"


# A local folder only: without Hadoop's native code every file created costs a chmod process and its checksum
# file another one, which is most of the time of a table of many small folders; parquet pages stay as they are.
PLAIN_LOCAL_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A1: header CSV whose text fields may hold newlines and quotes."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
            .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path))


def write_csv(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    """A11."""
    w = (df.write.mode(mode).option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)


def read_parquet(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """A2 / A3: one scan over a folder or glob; partition columns come from the folder names."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def read_with_source(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A3: multi-file scan keeping the source file of every row."""
    return spark.read.format(fmt).load(path).withColumn("source_file", F.col("_metadata.file_path"))


def write_parquet(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    """Parquet sink partitioned by symbol (or any key readers filter on)."""
    if not partition_by:
        df.write.mode(mode).parquet(path)
        return
    keys = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    # a key's rows come together first, large keys in several tasks: few files instead of one per task and key
    rows = df.hint("rebalance", *keys)
    rows.write.mode(mode).options(**PLAIN_LOCAL_FILES).partitionBy(*keys).parquet(path)


def write_env(env: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested environment records, one folder per file-safe ticker name."""
    write_parquet(env.withColumn("ticker_file", file_safe(F.col("symbol"))), path, "ticker_file", mode)


def write_env_parts(days: DataFrame, chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A13 for days of any size: the days and their news chunks as two tables, one folder per file-safe ticker each."""
    for df, name in ((days, "days"), (chunks, "news")):
        write_env(df, os.path.join(path, name), mode)


def price_ingest(raw: DataFrame, time_col: str, symbol_col: str, close_col: str) -> DataFrame:
    """A5: drop rows without time or close, strip the zone, emit (est_time, equity, close)."""
    r = raw.where(F.col(time_col).isNotNull() & F.col(close_col).isNotNull())
    return r.select(F.col(time_col).cast("timestamp_ntz").alias("est_time"), F.col(symbol_col).alias("equity"),
                    F.col(close_col).cast("double").alias("close"))


def adjusted_close(raw: DataFrame, time_col: str, close_col: str, symbol: str | None = None,
                   symbol_col: str | None = None) -> DataFrame:
    """(date, close) per symbol; the close column is renamed to the ticker in the wide view."""
    cols = [F.to_date(time_col).alias("date"), F.col(close_col).alias("price")]
    if symbol_col:
        cols.insert(0, F.col(symbol_col).alias("symbol"))
    elif symbol:
        cols.insert(0, F.lit(symbol).alias("symbol"))
    return raw.select(*cols)


def price_wide(prices: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """M2: wide (date, <ticker>...) view through ``pivot``; pass ``symbols`` to skip the distinct scan."""
    g = prices.groupBy("date")
    p = g.pivot("symbol", symbols) if symbols else g.pivot("symbol")
    return p.agg(F.max("price"))


def save_state(df: DataFrame, path: str, partition_by=("symbol", "layer"), force: bool = False) -> None:
    """Checkpoint table; refuses to overwrite unless ``force``."""
    write_parquet(df, path, list(partition_by), "overwrite" if force else "errorifexists")


def load_state(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """Restore a checkpoint table (order is a query property, not storage)."""
    return read_parquet(spark, path, schema)


def read_text_logs(spark: SparkSession, path: str) -> DataFrame:
    """(value, file_name, line_no): log lines with their number in their file, from 1.

    A file of any size is read in splits.  Lines are numbered inside their split (by byte offset); the
    line counts of a file's splits become prefix sums (a window over a file's splits, not over its lines).
    """
    from quantloom.session import cut_lineage
    # a progress bar's carriage returns do not end a line
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    rows = cut_lineage(raw, "log_lines")
    w = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    splits = (rows.groupBy(F.col("_file").alias("_f"), F.col("_block").alias("_b"))
              .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))))
    placed = rows.join(splits, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return placed.select("value", "file_name", (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("line_no"))


def save_agent_state(path: str, memories: DataFrame, params: DataFrame, removed_ids: DataFrame | None = None,
                     portfolio: DataFrame | None = None, force: bool = False) -> None:
    """The whole agent state as one snapshot (``sources.state``): layer parameters, memory records with their
    vectors, removed ids and portfolio rows.  Refuses a path that holds a complete state unless ``force``, which adds a
    newer snapshot and overwrites nothing."""
    tables = {"params": params, "memory": memories, "removed_ids": removed_ids, "portfolio": portfolio}
    save_snapshot(path, {name: df for name, df in tables.items() if df is not None}, force)


def load_agent_state(spark: SparkSession, path: str) -> dict:
    """The tables of the newest complete snapshot (removed ids are restored too, unlike the reference - Q6).

    A folder of plain tables, as written before there were snapshots, is read as it is.
    """
    if is_snapshot_store(spark, path):
        return load_snapshot(spark, path)
    out = {}
    for name in ("params", "memory", "removed_ids", "portfolio"):
        try:
            out[name] = spark.read.parquet(os.path.join(path, name))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":      # only a table that was not saved may be missing
                raise
    return out
