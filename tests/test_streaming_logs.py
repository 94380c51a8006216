"""Streaming equals batch (S2, S3), late rows (S5), resume (S4) and the run-log report."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from small_data import SF_SMALL
from quantloom.operators import logs as L
from quantloom.operators import portfolio as P
from quantloom.plans import q_memory, q_stream
from quantloom.sources import io as IO
from quantloom.sources.tables import Tables


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_memory_stream_equals_batch_lifecycle(spark):
    s = q_stream.q_memory_stream(spark, SF_SMALL)
    b = q_memory.q_memory_lifecycle(spark, SF_SMALL)
    cols = sorted(s.columns)
    assert _rows(s, cols) == _rows(b, cols)


@pytest.mark.parametrize("files,tasks", [(1, 6), (2, 1), (3, 6), (None, 6)])
def test_memory_stream_equals_batch_for_every_trigger_size(spark, files, tasks):
    """The events of one step spread over several files and micro-batches."""
    ev = q_stream.memory_events(spark, SF_SMALL).where("step <= 8")
    out = q_stream.run_memory_stream(spark, ev.repartition(tasks), 8, max_files_per_trigger=files)
    keys = ["symbol", "id"]
    fb = ev.where("kind = 'feedback'").select(*keys, "step", "feedback")
    b = q_memory.MM.memory_lifecycle(q_memory._mem(spark, SF_SMALL), 8, fb)
    cols = ["symbol", "id", "layer", "alive", "jumped", "transition", "delta", "access_counter"]
    assert _rows(out, cols) == _rows(b, cols)
    assert out.agg(F.sum("late_events")).first()[0] == 0


def test_portfolio_stream_equals_batch_windows(spark):
    t = Tables(spark, SF_SMALL)
    steps = t.actions.join(t.prices, ["symbol", "date"])
    s = q_stream.run_portfolio_stream(spark, steps.select("symbol", "model", "date", "price", "direction"))
    fb = P.feedback(steps).select("symbol", "model", "date", "shares", "feedback", "feedback_date")
    mom = P.momentum(steps.select("symbol", "model", "date", "price"), keys=("symbol", "model"))
    b = fb.join(mom.select("symbol", "model", "date", "momentum", "momentum_date"), ["symbol", "model", "date"])
    cols = ["symbol", "model", "date", "shares", "momentum", "momentum_date", "feedback", "feedback_date"]
    assert _rows(s, cols) == _rows(b, cols)


def test_run_log_report(spark):
    d = tempfile.mkdtemp(prefix="quantloom-logs-")
    with open(os.path.join(d, "sim_100_1.err"), "w") as f:
        f.write("start\n10%|#\r20%|## >>> day 3\nother\n")
    with open(os.path.join(d, "sim_101_1.err"), "w") as f:
        f.write("a\rb >>> day 9\nc\nd\ne\n")
    with open(os.path.join(d, "sim_101_2.err"), "w") as f:
        f.write("no marker here\n")
    lines = IO.read_text_logs(spark, d)
    prog = {r.task_id: (r.job_id, r.progress) for r in L.latest_progress(lines).collect()}
    assert prog[1] == (101, "b >>> day 9")
    assert prog[2] == (101, L.NO_PROGRESS)
    tails = {r.file_name: r.tail for r in L.error_tails(lines).collect()}
    assert tails["sim_101_1.err"] == "c\nd\ne"


def test_memory_stream_resumes_from_its_checkpoint(spark):
    """A second run on the same checkpoint reads only the new steps; the result equals batch."""
    import uuid
    from quantloom.session import scratch_path
    from quantloom.streaming import replay as S
    run = uuid.uuid4().hex[:10]
    land, out = scratch_path(spark, f"landing/resume_{run}"), scratch_path(spark, f"sinks/resume_{run}")
    ev = q_stream.memory_events(spark, SF_SMALL)
    ev.where("step <= 15").write.mode("overwrite").partitionBy("step").parquet(land)
    S.run_to_table(S.memory_state_stream(S.replay_stream(spark, land, S.EVENT_SCHEMA)), out, f"streams/resume_{run}")
    first_batches = spark.read.parquet(out).select("batch_id").distinct().count()
    ev.where("step > 15").write.mode("append").partitionBy("step").parquet(land)
    S.run_to_table(S.memory_state_stream(S.replay_stream(spark, land, S.EVENT_SCHEMA)), out, f"streams/resume_{run}")
    snaps = spark.read.parquet(out)
    assert snaps.select("batch_id").distinct().count() > first_batches
    done = S.finish_memory_state(snaps.drop("batch_id"), q_memory.LIFECYCLE_STEPS)
    b = q_memory.q_memory_lifecycle(spark, SF_SMALL)
    cols = ["symbol", "id", "layer", "alive", "jumped", "transition", "delta"]
    assert _rows(done, cols) == _rows(b, cols)
    assert done.agg(F.sum("late_events")).first()[0] == 0


def test_late_events_are_flagged_not_applied(spark):
    """An event for a step the record already passed is counted as late and ignored."""
    import uuid
    from quantloom.session import scratch_path
    from quantloom.streaming import replay as S
    run = uuid.uuid4().hex[:10]
    land, out = scratch_path(spark, f"landing/late_{run}"), scratch_path(spark, f"sinks/late_{run}")
    ev = q_stream.memory_events(spark, SF_SMALL)
    ev.where("step <= 10").write.mode("overwrite").partitionBy("step").parquet(land)
    S.run_to_table(S.memory_state_stream(S.replay_stream(spark, land, S.EVENT_SCHEMA), 0), out, f"streams/late_{run}")
    late = ev.where("kind = 'feedback' and step = 3").withColumn("step", F.lit(3))
    late.write.mode("append").parquet(f"{land}/step=3/late")
    ev.where("step > 10").write.mode("append").partitionBy("step").parquet(land)
    S.run_to_table(S.memory_state_stream(S.replay_stream(spark, land, S.EVENT_SCHEMA), 0), out, f"streams/late_{run}")
    snaps = spark.read.parquet(out)
    n_late = snaps.agg(F.sum("late_events")).first()[0]
    assert n_late == late.count() and n_late > 0
    done = S.finish_memory_state(snaps.drop("batch_id"), q_memory.LIFECYCLE_STEPS)
    b = q_memory.q_memory_lifecycle(spark, SF_SMALL)
    cols = ["symbol", "id", "layer", "alive", "jumped", "transition", "delta"]
    assert _rows(done, cols) == _rows(b, cols)


def test_portfolio_stream_flags_late_rows(spark):
    """S5 for S3: a price row older than the series' last step is returned with late = true."""
    import uuid
    from quantloom.session import scratch_path
    from quantloom.streaming import replay as S
    run = uuid.uuid4().hex[:10]
    land, out = scratch_path(spark, f"landing/pl_{run}"), scratch_path(spark, f"sinks/pl_{run}")
    rows = [("A", "m", dt, float(10 + i), 1) for i, dt in enumerate(
        [__import__("datetime").date(2024, 1, d) for d in (2, 3, 4, 5, 8, 9, 10, 11, 12)])]
    df = spark.createDataFrame(rows, S.PORTFOLIO_IN)
    df.where("date > '2024-01-03'").withColumn("step", F.lit(2)).write.mode("overwrite").partitionBy("step").parquet(land)
    schema = S.PORTFOLIO_IN + ", step int"
    S.run_to_table(S.portfolio_stream(S.replay_stream(spark, land, schema).drop("step")), out, f"streams/pl_{run}")
    df.where("date <= '2024-01-03'").withColumn("step", F.lit(1)).write.mode("append").partitionBy("step").parquet(land)
    S.run_to_table(S.portfolio_stream(S.replay_stream(spark, land, schema).drop("step")), out, f"streams/pl_{run}")
    res = spark.read.parquet(out)
    late = sorted(r.date.day for r in res.where("late").collect())
    assert late == [2, 3]
    assert res.where("not late").count() == 7
