"""Registered queries: the streaming replay (S1-S5).  Each call lands the step-ordered input
in the shared checkpoint folder, runs the stream to completion and returns its result table."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from quantloom.operators import memory as MM
from quantloom.plans.fixtures_sql import ACTIONS, PRICES, with_
from quantloom.plans.q_memory import EPOCH, LIFECYCLE_STEPS, _lifecycle_sql
from quantloom.plans.registry import register
from quantloom.session import scratch_path
from quantloom.sources.tables import Tables, derive_citations, derive_memories
from quantloom.sources.steps import read_steps
from quantloom.streaming import replay as S
from quantloom.streaming import stateful as SF


def memory_events(spark, sf_dir):
    """Creation of every memory at step 1 and the citation feedback at its day's step."""
    t = Tables(spark, sf_dir)
    mem = derive_memories(t)
    adds = mem.select("symbol", "id", F.lit(1).alias("step"), F.lit("add").alias("kind"),
                      F.lit(None).cast("int").alias("feedback"), "layer", "importance", "recency", "delta",
                      "access_counter")
    cit = derive_citations(t).select(F.col("cited_id").alias("id"),
                                     (F.datediff("date", F.lit(EPOCH).cast("date")) + 1).alias("step"), "feedback")
    fb = cit.join(mem.select("symbol", "id"), "id").select(
        "symbol", "id", "step", F.lit("feedback").alias("kind"), "feedback", F.lit(None).cast("string").alias("layer"),
        F.lit(None).cast("double").alias("importance"), F.lit(None).cast("double").alias("recency"),
        F.lit(None).cast("int").alias("delta"), F.lit(None).cast("int").alias("access_counter"))
    return adds.unionByName(fb)


def run_memory_stream(spark, events, n_steps: int, max_files_per_trigger: int | None = None):
    run = uuid.uuid4().hex[:12]
    land = scratch_path(spark, f"landing/memory_{run}")
    out = scratch_path(spark, f"sinks/memory_{run}")
    S.land_by_step(events, land)
    stream = S.replay_stream(spark, land, S.EVENT_SCHEMA, max_files_per_trigger)
    S.run_to_table(S.memory_state_stream(stream), out, f"streams/memory_{run}")
    snaps = spark.read.parquet(out).drop("batch_id")
    return S.finish_memory_state(snaps, n_steps)


def run_memory_steps(spark, events, n_steps: int, steps_per_trigger: int | None = None):
    """(a row per record and step it lived through, progress of the micro-batches)."""
    run = uuid.uuid4().hex[:12]
    land = scratch_path(spark, f"landing/steps_{run}")
    out = scratch_path(spark, f"sinks/steps_{run}")
    names = [c.split()[0] for c in SF.EVENT_IN.split(", ")]
    # the row of a step after the last one ends the last step
    clock = spark.range(1).select(*[F.lit({"step": n_steps + 1, "kind": "clock"}.get(c)).cast(t).alias(c)
                                    for c, t in (x.split() for x in SF.EVENT_IN.split(", "))])
    S.land_by_step(events.select(*names).unionByName(clock), land)
    ckpt = f"streams/steps_{run}"
    stream = read_steps(spark, land, SF.EVENT_IN, S.checkpoint_path(spark, ckpt), steps_per_trigger)
    progress = S.run_to_table(SF.memory_steps_stream(stream, n_steps), out, ckpt, by_steps=True)
    return spark.read.parquet(out).drop("batch_id"), progress


@register("memory_stream", _lifecycle_sql(LIFECYCLE_STEPS))
def q_memory_stream(spark, sf_dir):
    """Records stepped inside the stream; their last states equal the batch lifecycle."""
    rows, _ = run_memory_steps(spark, memory_events(spark, sf_dir), LIFECYCLE_STEPS)
    applied, _ = SF.late_rows(rows)
    last = F.max_by(F.struct(*[c for c in applied.columns if c not in ("symbol", "id", "step")]), "step")
    out = applied.groupBy("symbol", "id").agg(last.alias("s")).select("symbol", "id", "s.*")
    return out.select("symbol", "id", "layer", F.round("importance", 6).alias("importance"),
                      F.round("recency", 6).alias("recency"), "delta", F.round("compound", 6).alias("compound"),
                      "access_counter", "alive", "jumped", "transition")


def run_portfolio_stream(spark, steps, max_files_per_trigger: int | None = None, steps_per_trigger: int | None = None,
                         step: str = "yyyyMM"):
    """S3 to completion; a step holds the rows of one month (or of a day: ``step`` = yyyyMMdd).

    With ``max_files_per_trigger`` the plain file source reads the landed files, in any order: rows then
    wait as long as the span of the input, so none is late.
    """
    run = uuid.uuid4().hex[:12]
    land = scratch_path(spark, f"landing/portfolio_{run}")
    out = scratch_path(spark, f"sinks/portfolio_{run}")
    ckpt = f"streams/portfolio_{run}"
    first, last = steps.agg(F.min("date"), F.max("date")).first()
    if first is None:
        return spark.createDataFrame([], SF.PORTFOLIO_OUT)
    delay = 0 if max_files_per_trigger is None else (last - first).days + 1
    rows = steps.withColumns({"step": F.date_format("date", step).cast("int"), "_close": F.lit(None).cast("timestamp")})
    # the row after the last one ends the stream: it brings the watermark past every date
    close = spark.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in SF.PORTFOLIO_IN.split(", "))],
                                  F.lit(99999999).alias("step"),
                                  F.lit(last + datetime.timedelta(days=delay + 1)).cast("timestamp").alias("_close"))
    schema = SF.PORTFOLIO_IN + ", step int, _close timestamp"
    if max_files_per_trigger is None:
        S.land_by_step(rows.unionByName(close), land)
        stream = read_steps(spark, land, schema, S.checkpoint_path(spark, ckpt), steps_per_trigger)
    else:
        S.land_by_step(rows, land)
        stream = S.replay_stream(spark, land, schema, max_files_per_trigger)
    S.run_to_table(SF.portfolio_stream(stream, delay=f"{delay} days"), out, ckpt, by_steps=max_files_per_trigger is None)
    if max_files_per_trigger is not None:
        S.land_by_step(close, land, "append")
        stream = S.replay_stream(spark, land, schema, max_files_per_trigger)
        S.run_to_table(SF.portfolio_stream(stream, delay=f"{delay} days"), out, ckpt)
    return spark.read.parquet(out).drop("batch_id")


def _series(n: int, name: str, x: str, fix: str) -> str:
    """Sign of the sum of the last ``n`` values of ``x``, and the date ``n - 1`` rows back, once more rows exist."""
    total = " + ".join(f"lag({x}, {k}) over w" if k else x for k in range(n - 1, -1, -1))
    return (f"case when n > {n} then cast(sign({total}) as int) end as {name}, "
            f"case when n > {n} then lag(date, {n - 1}) over w end as {fix}")


@register("portfolio_stream", with_(PRICES, ACTIONS) + f"""
, held AS (select a.model, a.symbol, a.date, p.price,
                  cast(sum(a.direction) over (partition by a.symbol, a.model order by a.date
                       rows between unbounded preceding and current row) as bigint) as shares
           from actions a join prices p on a.symbol = p.symbol and a.date = p.date)
, moved AS (select *, price - lag(price) over w as d, (price - lag(price) over w) * lag(shares) over w as x,
                   row_number() over w as n
            from held window w as (partition by symbol, model order by date))
select symbol, model, date, shares, {_series(3, "momentum", "d", "momentum_date")},
       {_series(7, "feedback", "x", "feedback_date")}, false as late
from moved window w as (partition by symbol, model order by date)""")
def q_portfolio_stream(spark, sf_dir):
    """S3: momentum and feedback from keyed portfolio state; equals the batch windows."""
    t = Tables(spark, sf_dir)
    steps = t.actions.join(t.prices, ["symbol", "date"]).select("symbol", "model", "date", "price", "direction")
    return run_portfolio_stream(spark, steps)
