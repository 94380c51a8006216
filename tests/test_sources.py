"""Scans and sinks: quoted multi-line CSV bodies, multi-file scans with their source, partition pruning."""
import datetime as dt

from pyspark.sql import functions as F

from quantloom.sources import io as IO


def test_csv_round_trip_keeps_quotes_newlines_and_spaces(spark, tmp_path):
    rows = [(1, "S", dt.datetime(2024, 1, 1, 9, 30), ' "quoted" head ', 'line one\nline "two"\n', "en")]
    df = spark.createDataFrame(rows, IO.NEWS_CSV_SCHEMA)
    path = str(tmp_path / "news")
    IO.write_csv(df, path)
    back = IO.read_csv(spark, path, IO.NEWS_CSV_SCHEMA).collect()
    assert [tuple(r) for r in back] == rows


def test_multi_file_scan_keeps_source_and_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 3.0)], "symbol string, price double")
    path = str(tmp_path / "prices")
    IO.write_parquet(df, path, "symbol")
    scan = IO.read_with_source(spark, path).where(F.col("symbol") == "B")
    rows = scan.collect()
    assert len(rows) == 1 and "symbol=B" in rows[0].source_file
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "symbol" in plan
