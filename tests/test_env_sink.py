"""The sink of many small ticker folders."""
import glob
import os

from quantloom.sources import io as IO


def test_a_folder_holds_one_data_file_and_no_side_files(spark, tmp_path):
    """Creating a local checksum file costs a process of its own, per folder."""
    path = str(tmp_path / "env")
    rows = [(f"U.{k % 40}", k, [f"n{k}", None]) for k in range(200)] + [("A/B", 200, []), (None, 201, None)]
    df = spark.createDataFrame(rows, "symbol string, k long, news array<string>")
    IO.write_env(df, path)
    folders = glob.glob(os.path.join(path, "ticker_file=*"))
    assert len(folders) == 42 and os.path.exists(os.path.join(path, "_SUCCESS"))
    assert all(len(os.listdir(f)) == 1 and os.listdir(f)[0].endswith(".parquet") for f in folders)
    back = IO.read_parquet(spark, path)
    assert sorted((r.k, r.symbol, r.news) for r in back.collect()) == sorted((k, s, n) for s, k, n in rows)
    assert {r.ticker_file for r in back.where("symbol = 'A/B'").collect()} == {"A_B"}
    IO.write_env(df.limit(3), path)                     # overwriting leaves nothing of the first table
    assert IO.read_parquet(spark, path).count() == 3
