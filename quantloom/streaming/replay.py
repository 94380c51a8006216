"""Structured Streaming replay of the daily loop.

S1  ``land_by_step`` writes a step-ordered table (one folder per step) into a
    landing zone; ``replay_stream`` reads it with ``readStream`` and
    ``trigger(availableNow=True)``: the query ends when every step is consumed.
S2  ``memory_state_stream``: one state per memory record ``(symbol, id)``, its
    creation and the feedback it got so far, in any order.  A record only wakes
    when an event arrives.  The step is a pure function of the record and its events,
    so ``finish_memory_state`` folds all steps with the batch rule (I11): the result is
    the batch lifecycle for every trigger size and order of files.
S4  every stream has a ``checkpointLocation`` in the shared checkpoint folder;
    the sinks are written per micro-batch with ``foreachBatch`` by batch id
    (idempotent: a replayed batch overwrites its own folder).

Whole steps in order come from ``sources.steps`` (S1); records stepped inside the stream (S2), the portfolio
series (S3) and the guard against late rows (S5) are in ``streaming.stateful``.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quantloom.operators import memory as MM
from quantloom.session import checkpoint_dir
from quantloom.streaming.stateful import PORTFOLIO_IN, ROCKSDB, portfolio_stream  # noqa: F401

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"

# ------------------------------------------------------------------ S1 landing + replay


def land_by_step(df: DataFrame, path: str, mode: str = "overwrite", step_col: str = "step") -> None:
    """Write ``df`` partitioned by step (the replay order) into a landing folder."""
    df.write.mode(mode).partitionBy(step_col).parquet(path)


def replay_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("basePath", path)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def checkpoint_path(spark: SparkSession, ckpt_name: str) -> str:
    return os.path.join(checkpoint_dir(spark), ckpt_name)


def run_to_table(stream: DataFrame, out_path: str, ckpt_name: str, output_mode: str = "append",
                 by_steps: bool = False) -> list[dict]:
    """Run until the input is consumed; each micro-batch lands in its own batch folder.

    ``by_steps``: the source (``sources.steps``) limits its own micro-batches. Returns the progress of every micro-batch.
    """
    spark = stream.sparkSession
    ckpt = checkpoint_path(spark, ckpt_name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out_path, f"batch_id={batch_id}"))

    # keyed state with timers needs this store; a query keeps the one it started with
    provider = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        writer = (stream.writeStream.outputMode(output_mode).option("checkpointLocation", ckpt).foreachBatch(write))
        if not by_steps:
            q = writer.trigger(availableNow=True).start()
            q.awaitTermination()
        else:
            q = writer.trigger(processingTime="0 seconds").start()
            try:
                q.processAllAvailable()
            finally:
                q.stop()
    finally:
        if provider is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, provider)
    return q.recentProgress


# ------------------------------------------------------------------ S2 memory state per record

EVENT_SCHEMA = ("symbol string, id long, step int, kind string, feedback int, layer string, "
                "importance double, recency double, delta int, access_counter int")
_RECORD = "layer string, importance double, recency double, delta int, access_counter int"
STATE_SCHEMA = _RECORD + ", added int, last int, seen long, steps array<int>, feedbacks array<int>"
OUT_SCHEMA = ("symbol string, id long, " + _RECORD + ", added int, seen long, steps array<int>, "
              "feedbacks array<int>, late_events int")


def _memory_handler(max_lateness: int | None = None):
    record = [c.split()[0] for c in _RECORD.split(", ")]

    def handle(key, pdfs, state):
        symbol, rid = key
        if state.exists:
            *values, added, last, seen, steps, feedbacks = state.get
            steps, feedbacks = list(steps), list(feedbacks)
        else:
            values, added, last, seen, steps, feedbacks = [None] * len(record), None, None, 0, [], []
        ev = pd.concat(list(pdfs), ignore_index=True)
        late, newest = 0, last
        for r in ev.itertuples(index=False):
            step = int(r.step)
            if max_lateness is not None and last is not None and step <= last - max_lateness:
                late += 1
                continue
            seen += 1
            newest = step if newest is None else max(newest, step)
            if r.kind == "add" and (added is None or step < added):
                added = step
                values = [r.layer, float(r.importance), float(r.recency), int(r.delta), int(r.access_counter)]
            elif r.kind == "feedback":
                steps.append(step)
                feedbacks.append(int(r.feedback))
        state.update((*values, added, newest, seen, steps, feedbacks))
        row = (symbol, int(rid), *values, added, seen, steps, feedbacks, late)
        yield pd.DataFrame([row], columns=[c.split()[0] for c in OUT_SCHEMA.split(", ")])
    return handle


def memory_state_stream(events: DataFrame, max_lateness: int | None = None) -> DataFrame:
    """S2 over an event stream of EVENT_SCHEMA rows (kind = 'add' | 'feedback').

    S5: with ``max_lateness`` an event that is at least one step and that many older than the record's
    newest step of an earlier micro-batch is late: counted, not applied. Without it no event is late.
    """
    return events.groupBy("symbol", "id").applyInPandasWithState(
        _memory_handler(max_lateness), OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def finish_memory_state(snapshots: DataFrame, n_steps: int, params=MM.DEFAULT_PARAMS,
                        feedback_after_jump: bool = False) -> DataFrame:
    """Newest snapshot per record, its ``n_steps`` steps folded with the batch rule.

    ``late_events`` adds up over all snapshots; feedback of steps before the record's creation counts as late.
    """
    keys = ["symbol", "id"]
    newest = F.max_by(F.struct(*[c for c in snapshots.columns if c not in (*keys, "late_events")]), F.col("seen"))
    last = (snapshots.groupBy(*keys).agg(newest.alias("_s"), F.sum("late_events").alias("_late"))
            .select(*keys, "_s.*", "_late").where(F.col("added").isNotNull()))
    fed = F.arrays_zip(F.col("steps").alias("step"), F.col("feedbacks").alias("feedback"))
    early = F.filter("steps", lambda k: k < F.col("added"))
    last = last.withColumn("late_events", (F.col("_late") + F.size(early)).cast("int"))
    events = last.select(*keys, "added", F.explode(fed).alias("_e")).where("_e.step >= added").select(
        *keys, (F.col("_e.step") - F.col("added") + 1).alias("step"), F.col("_e.feedback").alias("feedback"))
    mem = MM.with_compound(last.select(*keys, "added", "late_events", "layer", "importance", "recency", "delta",
                                       "access_counter"))
    # a record lives through the steps from its creation on
    out = MM.memory_lifecycle(mem, F.lit(n_steps) - F.col("added") + 1, events, params, feedback_after_jump)
    return out.drop("added")
