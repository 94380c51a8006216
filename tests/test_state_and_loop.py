"""Snapshots (A16, A17), line numbers (A18), chunked day lists (D1), validation (A20), the step audit (I12) and the
closed loop (P12, I13) against a plain sequential model."""
import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import agent_loop as AL
from quantloom.operators import environment as V
from quantloom.operators import logs as L
from quantloom.operators import memory as MM
from quantloom.sources import io as IO
from quantloom.sources import state as ST


# ---- A16, A17
def memory(spark, n=6, tag=1.0):
    return spark.createDataFrame([("AB"[k % 2], "short", k, tag, [float(k), tag]) for k in range(n)],
                                 "symbol string, layer string, id long, importance double, embedding array<double>")


def test_a_state_is_whole_or_absent(spark, tmp_path):
    path = str(tmp_path / "state")
    params = MM.params_df(spark)
    broken = memory(spark).withColumn("importance", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("importance")))
    with pytest.raises(Exception, match="lost"):
        IO.save_agent_state(path, broken, params)           # params are written, the memory is not
    with pytest.raises(FileNotFoundError):
        ST.load_snapshot(spark, path)
    IO.save_agent_state(path, memory(spark), params)        # what is half-written is in nobody's way
    with pytest.raises(FileExistsError):
        IO.save_agent_state(path, memory(spark), params)
    reading = IO.load_agent_state(spark, path)["memory"]
    with pytest.raises(Exception, match="lost"):
        IO.save_agent_state(path, broken, params, force=True)
    assert {r.importance for r in IO.load_agent_state(spark, path)["memory"].collect()} == {1.0}
    IO.save_agent_state(path, memory(spark, tag=2.0), params, memory(spark).select("symbol", "id"), force=True)
    back = IO.load_agent_state(spark, path)
    assert set(back) == {"params", "memory", "removed_ids"}
    assert sorted((r.id, r.embedding) for r in back["memory"].collect()) == [(k, [float(k), 2.0]) for k in range(6)]
    assert {r.importance for r in reading.collect()} == {1.0}      # the earlier snapshot is still there to read
    assert [r.rows for r in ST.versions(spark, path).collect()] == [[4, 6, 6], [4, 6]]
    assert {r.importance for r in ST.load_snapshot(spark, path, 1)["memory"].collect()} == {1.0}


def test_few_files_per_key(spark, tmp_path):
    df = spark.range(4000, numPartitions=16).select((F.col("id") % 5).alias("symbol"), "id")
    IO.write_parquet(df, str(tmp_path / "t"), "symbol")
    assert len(list((tmp_path / "t").glob("symbol=*/*.parquet"))) <= 10
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4000


# ---- A18, D19, D20
def test_line_numbers_of_files_read_in_splits(spark, tmp_path):
    big = [f"line {k} " + "x" * (k % 50) for k in range(4000)]
    (tmp_path / "sim_7_1.err").write_text("\n".join(big) + "\n")
    (tmp_path / "sim_7_2.err").write_text("a\n\nc >>> day 1\rc >>> day 2\nd\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        lines = IO.read_text_logs(spark, str(tmp_path))
        got = sorted((r.file_name, r.line_no, r.value) for r in lines.collect())
        assert got[:4000] == [("sim_7_1.err", k + 1, v) for k, v in enumerate(big)]
        assert got[4000:] == [("sim_7_2.err", k + 1, v) for k, v in enumerate(["a", "", "c >>> day 1\rc >>> day 2", "d"])]
        tails = {r.file_name: r.tail for r in L.error_tails(lines).collect()}
        assert tails["sim_7_1.err"] == "\n".join(big[-3:])
        assert {r.task_id: r.progress for r in L.latest_progress(lines).collect()} == {1: L.NO_PROGRESS, 2: "c >>> day 2"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


# ---- D1, A13
def test_a_day_of_any_size_is_written_in_chunks(spark, tmp_path):
    day = F.to_date(F.lit("2024-01-02"))
    items = spark.range(20_000).select(
        F.when(F.col("id") % 10 > 0, "HOT").otherwise("B.C").alias("symbol"), day.alias("date"), "id"
    ).withColumnRenamed("id", "seq").withColumn("text", F.concat(F.lit("t"), "seq"))
    prices = spark.createDataFrame([("HOT", datetime.date(2024, 1, 2), 5.0)], "symbol string, date date, price double")
    filings = spark.createDataFrame([], "symbol string, date date, form string, content string, seq long")
    days, chunks = V.env_parts(prices, items, filings, 500)
    IO.write_env_parts(days, chunks, str(tmp_path / "env"))
    news = spark.read.parquet(str(tmp_path / "env" / "news"))
    assert news.agg(F.max(F.size("news"))).first()[0] == 500
    whole = news.where("symbol = 'HOT'").orderBy("chunk_no").collect()
    assert [x for r in whole for x in r.news] == [f"t{k}" for k in range(20_000) if k % 10]
    assert {(r.symbol, r.price, r.n_news) for r in spark.read.parquet(str(tmp_path / "env" / "days")).collect()} == {
        ("HOT", 5.0, 18_000), ("B.C", None, 2_000)}


# ---- A20
def test_every_reason_to_reject_a_record(spark):
    rows = [("A", "2024-01-02", "1.5"), ("A", "2024-01-03", None), (None, "2024-01-02", "1"), (" ", "2024-01-02", "1"),
            ("B", "2nd of May", "1"), ("B", None, "1"), ("C", "2024-01-02", "dear"), ("C", "2024-01-03", "0"),
            ("C", "2024-01-04", "-1"), ("C", "2024-01-05", "NaN"), ("D", "2024-01-02", "1"), ("D", "2024-01-02", "2")]
    ok, bad = V.validate_env(spark.createDataFrame(rows, "symbol string, date string, price string"))
    assert sorted((r.symbol, r.date) for r in ok.collect()) == [("A", "2024-01-02"), ("A", "2024-01-03")]
    reasons = sorted(r.reason for r in bad.collect())
    assert reasons == sorted(["no symbol"] * 2 + ["no date"] * 2 + ["price is no number"] + ["price not above 0"] * 3 + ["date repeats"] * 2)


# ---- I12, P12, I13
RULES = {"short": (3.0, 0.92), "mid": (90.0, 0.967), "long": (365.0, 0.988), "reflection": (365.0, 0.988)}


def plain_step(r):
    """One memory step of a live record, as written down in the rules."""
    recency, importance = RULES[r["layer"]]
    r["delta"] += 1
    r["recency"], r["importance"] = math.exp(-r["delta"] / recency), r["importance"] * importance
    r["compound"] = r["recency"] + min(r["importance"], 100.0) / 100.0
    moves = ""
    if r["recency"] < 0.05 or r["importance"] < 5.0:
        return None, moves
    for _ in range(2):
        for layer, down, up in (("short", None, 60.0), ("mid", 60.0, 80.0), ("long", 80.0, None)):
            if r["layer"] != layer:
                continue
            chain = ["short", "mid", "long"]
            to = layer
            if up is not None and r["importance"] >= up:
                to = chain[chain.index(layer) + 1]
                r["recency"], r["delta"] = 1.0, 0
            elif down is not None and r["importance"] < down:
                to = chain[chain.index(layer) - 1]
            if to != layer:
                moves += f"{layer}>{to};"
                r["layer"], r["jumped"] = to, True
    return r, moves


def plain_feedback(r, value):
    if value and not r["jumped"]:
        r["access_counter"] += value
        r["importance"] += 5.0 * r["access_counter"]
        r["compound"] = r["recency"] + min(r["importance"], 100.0) / 100.0


def plain_replay(records, prices, days, k, back):
    live, got, cited, held = {}, [], {}, {}
    for day in range(days):
        for r in records:
            if r["created"] == day:
                live[r["symbol"], r["id"]] = dict(r, jumped=False, compound=r["recency"] + min(r["importance"], 100.0) / 100.0)
        groups = {}
        for r in live.values():
            groups.setdefault((r["symbol"], r["layer"]), []).append(r)
        for (symbol, layer), rows in groups.items():
            bag = [(r["sim"] + r["compound"], r["id"], s) for s, part in enumerate((
                sorted(rows, key=lambda r: (-r["sim"], r["id"]))[:k], sorted(rows, key=lambda r: (r["compound"], r["seq"]))[:k]))
                for r in part]
            top = sorted(bag, key=lambda x: (-x[0], x[1], x[2]))[:min(k, len(rows))]
            best = {}
            for score, i, _ in top:
                best[i] = max(score, best.get(i, score))
            for pos, i in enumerate(sorted(best), 1):
                got.append((day, symbol, layer, i, round(best[i], 6), pos))
                cited.setdefault((symbol, day), set()).add(i)
        for symbol, series in prices.items():
            p, there = series[day], (symbol, day) in cited
            move = (p > series[day - 1]) - (p < series[day - 1]) if day and there else 0
            shares = held.setdefault(symbol, [])
            shares.append((shares[-1] if shares else 0) + move)
            if day >= back:
                gain = sum((series[j] - series[j - 1]) * shares[j - 1] for j in range(day - back + 1, day + 1))
                for i in cited.get((symbol, day - back + 1), ()):
                    if (symbol, i) in live:
                        plain_feedback(live[symbol, i], (gain > 0) - (gain < 0))
        live = {key: r for key, r in ((key, plain_step(r)[0]) for key, r in live.items()) if r is not None}
    return sorted(got), live


RECORD = ("symbol string, id long, seq long, created int, sim double, layer string, importance double, recency double, "
          "delta int, access_counter int")


def some_records(n, seed):
    rng = random.Random(seed)
    return [{"symbol": "AB"[k % 2], "id": k, "seq": n - k, "created": rng.randrange(4), "sim": round(rng.random(), 3),
             "layer": rng.choice(list(RULES)), "importance": float(rng.randrange(4, 100)), "recency": 1.0,
             "delta": rng.randrange(7), "access_counter": 0} for k in range(n)]


def test_closed_loop_against_a_plain_model(spark):
    records = some_records(40, 5)
    prices = {"A": [10.0, 11, 12, 9, 14], "B": [5.0, 4, 4, 6, 7]}
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in RECORD.split(", ")) for r in records], RECORD)
    series = spark.createDataFrame([(s, d, float(p)) for s, ps in prices.items() for d, p in enumerate(ps)],
                                   "symbol string, day int, price double")
    out = AL.replay(df, series, 5, 3, 2)
    expected, live = plain_replay(records, prices, 5, 3, 2)
    assert sorted((r.day, r.symbol, r.layer, r.id, round(r.score, 6), r.pos) for r in out.retrieved.collect()) == expected
    assert sorted((r.symbol, r.id, r.layer, round(r.importance, 6), r.access_counter, r.jumped) for r in out.state.collect()) == sorted(
        (r["symbol"], r["id"], r["layer"], round(r["importance"], 6), r["access_counter"], r["jumped"]) for r in live.values())
    assert out.events.where("feedback <> 0").count() > 0
    # without the feedback other records would be retrieved
    deaf = AL.replay(df, series, 5, 3, 2, lambda p, r: AL.momentum_rule()(p, r).withColumn("direction", F.lit(0)))
    assert sorted((r.day, r.symbol, r.layer, r.id, round(r.score, 6), r.pos) for r in deaf.retrieved.collect()) != expected


def test_step_audit_against_a_plain_model(spark):
    records = some_records(24, 8)
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in RECORD.split(", ")) for r in records], RECORD)
    events = [("AB"[k % 2], k, step, value) for k in range(24) for step, value in ((2, 1), (2, -1), (4, 1)) if (k + step) % 3]
    ev = spark.createDataFrame(events, "symbol string, id long, step int, feedback int")
    expected = []
    for r in records:
        r = dict(r, jumped=False)
        for step in range(1, 6):
            for value in sorted(v for s, i, k, v in events if (s, i, k) == (r["symbol"], r["id"], step)):
                plain_feedback(r, value)
            after, moves = plain_step(r)
            way = 0 if not moves else 1 if moves.split(">")[0] == "short" or moves == "mid>long;" else -1
            expected.append((r["symbol"], r["id"], step, r["layer"], round(r["importance"], 6), after is not None, moves, way))
            if after is None:
                break
    got = sorted((r.symbol, r.id, r.step, r.layer, round(r.importance, 6), r.alive, r.transition, r.direction)
                 for r in AL.audit_steps(df, 5, ev).collect())
    assert got == sorted(expected) and {x[-1] for x in got} == {0, 1, -1}
