"""Ordered steps (S1), records stepped inside the stream (S2), portfolio series behind a watermark."""
import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from quantloom.operators import portfolio as P
from quantloom.plans import q_memory, q_stream
from quantloom.session import scratch_path
from quantloom.sources.steps import BEFORE_ALL, last_logged_step, read_steps
from quantloom.streaming import replay as S
from quantloom.streaming import stateful as SF
from small_data import SF_SMALL

KEYS = ["symbol", "id"]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Every micro-batch starts its stateful tasks anew; two are enough here."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows_of(df, cols):
    return sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))


def some_events(spark, n_ids=40, days=8):
    return q_stream.memory_events(spark, SF_SMALL).where(F.col("id") < n_ids).where(F.col("step") <= days)


def batch_audit(spark, ev, n_steps, n_ids=40):
    """Snapshots of the batch rule, up to the step in which a record dies."""
    mem = q_memory._mem(spark, SF_SMALL).where(F.col("id") < n_ids)
    fb = ev.where("kind = 'feedback'").select(*KEYS, "step", "feedback")
    traced = q_memory.MM.memory_lifecycle(mem, n_steps, fb, trace=True)
    rows = q_memory.MM.audit_rows(traced)
    dead = rows.where("NOT alive").groupBy(*KEYS).agg(F.min("step").alias("death"))
    return rows.join(dead, KEYS, "left").where("death IS NULL OR step <= death").drop("death")


@pytest.mark.parametrize("per_trigger,tasks", [(1, 6), (2, 1), (3, 6), (None, 6)])
def test_every_step_of_the_stream_equals_the_batch_audit(spark, per_trigger, tasks):
    ev = some_events(spark)
    rows, progress = q_stream.run_memory_steps(spark, ev.repartition(tasks), 8, per_trigger)
    applied, late = SF.late_rows(rows)
    cols = [*KEYS, "step", "layer", F.round("importance", 6), F.round("recency", 6), F.round("compound", 6), "alive"]
    assert late.count() == 0
    assert rows_of(applied, cols) == rows_of(batch_audit(spark, ev, 8), cols)
    if per_trigger == 1:
        assert len([p for p in progress if p.numInputRows]) == 9        # eight steps and the clock


def test_dead_records_leave_the_state(spark):
    """Records that fade at once, and feedback for a record that is gone."""
    fade = [("A", k, 1, "add", None, "short", 90.0, 1.0, 60, 0) for k in range(20)]      # recency falls below its limit
    stay = [("A", 100, 1, "add", None, "long", 90.0, 1.0, 0, 0)]
    fed = [("A", 3, 4, "feedback", 1, None, None, None, None, None), ("A", 100, 2, "feedback", 1, None, None, None, None, None)]
    tick = [("A", 100, s, "tick", None, None, None, None, None, None) for s in (3, 5)]
    ev = spark.createDataFrame(fade + stay + fed + tick, SF.EVENT_IN)
    rows, progress = q_stream.run_memory_steps(spark, ev, 6, 1)
    left = [p.stateOperators[0].numRowsTotal for p in progress]
    assert left[0] >= 21 and left[-1] == 0 and left[2] < left[0]
    deaths = rows.where("NOT alive")
    assert deaths.count() == 20 and deaths.agg(F.max("step")).first()[0] == 1
    assert rows.where("id = 100").count() == 6


def test_late_events_come_out_beside(spark):
    run = uuid.uuid4().hex[:10]
    land, out, ckpt = (scratch_path(spark, f"{k}/late_{run}") for k in ("landing", "sinks", "streams"))
    ev = some_events(spark)
    name = f"streams/late_{run}"
    ev.write.mode("overwrite").partitionBy("step").parquet(land)

    def go():
        stream = S.replay_stream(spark, land, SF.EVENT_IN)
        S.run_to_table(SF.memory_steps_stream(stream, 8), out, name)
    go()
    behind = ev.where("kind = 'feedback' AND step = 3")
    behind.write.mode("append").parquet(f"{land}/step=3/more")
    go()
    late = SF.late_rows(spark.read.parquet(out))[1]
    assert rows_of(late, [*KEYS, "step"]) == rows_of(behind, [*KEYS, "step"]) and behind.count() > 0


SERIES = [("A", "m", datetime.date(2024, 1, 1) + datetime.timedelta(days=k), float(10 + k * 7 % 11), (k % 3) - 1)
          for k in range(14)] + [("B", "m", datetime.date(2024, 1, 3) + datetime.timedelta(days=k), 5.0 + k, 1) for k in range(9)]
OUT = ["symbol", "model", "date", "shares", "momentum", "momentum_date", "feedback", "feedback_date"]


def batch_series(df):
    fb = P.feedback(df)
    mom = P.momentum(df.select("symbol", "model", "date", "price"), keys=("symbol", "model"))
    return fb.join(mom.select("symbol", "model", "date", "momentum", "momentum_date"), ["symbol", "model", "date"])


@pytest.mark.parametrize("steps,files,tasks", [(1, None, 6), (2, None, 1), (3, None, 6), (None, None, 6), (None, 1, 3), (None, 4, 6)])
def test_portfolio_stream_is_the_same_for_every_trigger(spark, steps, files, tasks):
    """Whole steps in order, or single files in any order behind a watermark."""
    df = spark.createDataFrame(SERIES, SF.PORTFOLIO_IN)
    got = q_stream.run_portfolio_stream(spark, df.repartition(tasks), files, steps, "yyyyMMdd" if files is None else "yyyyMM")
    assert got.where("late").count() == 0
    assert rows_of(got, OUT) == rows_of(batch_series(df), OUT)


def test_only_rows_behind_the_watermark_are_late(spark):
    """Files of one day each in a shuffled order; the delay decides which rows are late, and all of them come out."""
    run = uuid.uuid4().hex[:10]
    land, out = scratch_path(spark, f"landing/wm_{run}"), scratch_path(spark, f"sinks/wm_{run}")
    df = spark.createDataFrame([r for r in SERIES if r[0] == "B"], SF.PORTFOLIO_IN)
    order = [0, 2, 1, 5, 4, 3, 8, 2]           # days after the first; day 2 lands again
    days = [datetime.date(2024, 1, 3) + datetime.timedelta(days=k) for k in order]
    for day in [*days, datetime.date(2024, 3, 1)]:
        rows = df.where(F.col("date") == F.lit(day)) if day.month == 1 else spark.createDataFrame(
            [("Z", "m", day, 1.0, 0)], SF.PORTFOLIO_IN)
        rows.coalesce(1).write.mode("append").parquet(land)
        S.run_to_table(SF.portfolio_stream(spark.readStream.schema(SF.PORTFOLIO_IN).parquet(land), delay="2 days"), out,
                       f"streams/wm_{run}")
    got = spark.read.parquet(out).where("symbol = 'B'")
    late = sorted(r.date.day - 3 for r in got.where("late").collect())
    # the watermark before each file: two days behind the largest day so far
    expected, top = [], -99
    for k in order:
        if k <= top - 2:
            expected.append(k)
        top = max(top, k)
    assert late == sorted(expected) and late
    taken = [datetime.date(2024, 1, 3) + datetime.timedelta(days=k) for k in set(order) - (set(expected) - {2})]
    kept = df.where(F.col("date").isin(taken))
    assert rows_of(got.where("NOT late"), OUT) == rows_of(batch_series(kept), OUT)


def test_step_source_resumes_and_follows_new_steps(spark):
    run = uuid.uuid4().hex[:10]
    land, out, name = scratch_path(spark, f"landing/src_{run}"), scratch_path(spark, f"sinks/src_{run}"), f"streams/src_{run}"
    schema = "id long, at timestamp, step int"
    df = spark.range(60).select("id", F.timestamp_seconds("id").alias("at"), (F.col("id") % 6 + 10).cast("int").alias("step"))
    ckpt = S.checkpoint_path(spark, name)
    assert last_logged_step(ckpt) == BEFORE_ALL

    def go():
        return S.run_to_table(read_steps(spark, land, schema, ckpt, 2), out, name, by_steps=True)
    S.land_by_step(df.where("step < 13").repartition(4), land)
    assert [p.numInputRows for p in go() if p.numInputRows] == [20, 10] and last_logged_step(ckpt) == 12
    S.land_by_step(df.where("step >= 13").repartition(3), land, "append")
    S.land_by_step(df.where("id = 0").withColumn("step", F.lit(9)), land, "append")      # behind the log: never read
    assert [p.numInputRows for p in go() if p.numInputRows] == [20, 10]
    got = spark.read.parquet(out)
    assert rows_of(got, ["id", "at", "step"]) == rows_of(df, ["id", "at", "step"])
    by_batch = got.groupBy("batch_id").agg(F.min("step").alias("a"), F.max("step").alias("b")).orderBy("batch_id").collect()
    assert [(r.a, r.b) for r in by_batch] == [(10, 11), (12, 12), (13, 14), (15, 15)]
