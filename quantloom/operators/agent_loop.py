"""The closed daily loop (P12 with I13) and the step-wise audit (I12), day by day over written tables.

A day's decision and feedback change the records that the next day retrieves, so days are a driver loop (bounded by
the calendar); inside a day everything is joins and projections over all symbols.  Each day's state, retrieval and
decisions are tables of their own in the shared folder: a day reads the day before and never its lineage.

``replay`` runs a day as the reference does: records created that day join the live ones; the best records per
layer are retrieved and cited; a decision is taken and added to the portfolio; the portfolio's feedback, once there are
enough steps, goes to the records cited on the day it is for; then the memory ages, cleans up and moves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import memory as MM
from quantloom.operators import portfolio as P
from quantloom.operators import retrieval as R
from quantloom.session import cut_lineage

_STATE = ("layer", "importance", "recency", "delta", "compound", "access_counter", "jumped")


def apply_day_feedback(state: DataFrame, events: DataFrame, feedback_after_jump: bool = False) -> DataFrame:
    """I4 for the events (symbol, id, feedback) of one day on live records; several of a record in rising order."""
    fed = events.where("feedback <> 0").groupBy("symbol", "id").agg(F.array_sort(F.collect_list("feedback")).alias("_fed"))
    joined = state.join(fed, ["symbol", "id"], "left")
    ok = F.col("_fed").isNotNull() if feedback_after_jump else F.col("_fed").isNotNull() & ~F.col("jumped")
    counter = F.col("access_counter").cast("int")
    start = F.struct(counter.alias("c"), F.col("importance").cast("double").alias("i"))
    done = F.aggregate("_fed", start, lambda s, f: F.struct(
        (s["c"] + f).cast("int").alias("c"), (s["i"] + (s["c"] + f).cast("double") * MM.ACCESS_STEP).alias("i")))
    out = joined.withColumn("_ok", ok).withColumn("_done", F.when(F.col("_ok"), done))
    out = out.withColumns({"access_counter": F.when(F.col("_ok"), F.col("_done.c")).otherwise(counter),
                           "importance": F.when(F.col("_ok"), F.col("_done.i")).otherwise(F.col("importance"))})
    compound = F.when(F.col("_ok"), MM.compound_score(F.col("recency"), F.col("importance"))).otherwise(F.col("compound"))
    return out.withColumn("compound", compound).drop("_fed", "_ok", "_done")


def step_day(state: DataFrame, events: DataFrame, params=MM.DEFAULT_PARAMS, feedback_after_jump: bool = False) -> DataFrame:
    """Feedback, then one memory step: the records with ``alive``, ``transition`` of this step, ``jumped`` ever."""
    before = apply_day_feedback(state, events, feedback_after_jump).withColumnRenamed("jumped", "_jumped")
    out = MM.memory_step(before, params)
    return out.withColumn("jumped", F.col("_jumped") | F.col("jumped")).drop("_jumped")


def audit_steps(memories: DataFrame, n_steps: int, events: DataFrame | None = None, params=MM.DEFAULT_PARAMS,
                feedback_after_jump: bool = False) -> DataFrame:
    """One row per record and step up to its death: state, ``transition`` and its direction in that step.

    ``events`` = (symbol, id, step, feedback).  Rows are long and written step by step; no value grows with the steps.
    """
    state = MM.with_compound(memories).withColumn("jumped", F.lit(False))
    if events is None:
        events = state.limit(0).select("symbol", "id", F.lit(0).alias("step"), F.lit(0).alias("feedback"))
    parts = []
    for k in range(1, n_steps + 1):
        rows = step_day(state, events.where(F.col("step") == k).select("symbol", "id", "feedback"), params,
                        feedback_after_jump)
        parts.append(cut_lineage(rows.withColumn("step", F.lit(k)), "audit_step"))
        state = parts[-1].where("alive").drop("alive", "transition", "step")
    order = {layer: i for i, layer in enumerate(MM.JUMP_CHAIN)}
    place = lambda layer: F.coalesce(*[F.when(layer == name, F.lit(i)) for name, i in order.items()])
    first = F.substring_index("transition", ">", 1)
    moved = F.when(F.col("transition") != "", F.signum(place(F.col("layer")) - place(first)).cast("int")).otherwise(F.lit(0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("direction", moved)


@dataclass
class Replay:
    retrieved: DataFrame      # day, symbol, layer, id, score, pos
    decisions: DataFrame      # day, symbol, price, direction
    events: DataFrame         # day, symbol, id, feedback: what was applied on that day
    state: DataFrame          # the live records after the last day


def momentum_rule(window: int = 1) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """K4 default: the sign of the last price changes; hold without one, or when nothing was retrieved."""
    def decide(prices: DataFrame, retrieved: DataFrame) -> DataFrame:
        mom = P.momentum(prices.withColumnRenamed("day", "date"), ("symbol",), window).select(
            "symbol", F.col("date").alias("day"), F.coalesce("momentum", F.lit(0)).alias("_m"))
        there = retrieved.select("symbol").distinct().withColumn("_there", F.lit(True))
        return mom.join(there, "symbol", "left").select(
            "symbol", "day", F.when(F.col("_there"), F.col("_m")).otherwise(F.lit(0)).cast("int").alias("direction"))
    return decide


def replay(memories: DataFrame, prices: DataFrame, days: int, top_k: int, lookback: int = 7,
           decide: Callable[[DataFrame, DataFrame], DataFrame] | None = None, params=MM.DEFAULT_PARAMS,
           feedback_after_jump: bool = False) -> Replay:
    """The loop over days 0 .. ``days`` - 1.

    ``memories``: records with ``created`` (day) and ``sim`` (similarity to the symbol's profile query), symbol, id, seq
    and the state's columns.  ``prices``: symbol, day, price.  ``decide`` gets the prices up to the day and the day's
    retrieved rows and returns (symbol, day, direction); its rows of the day are taken.
    """
    decide = decide or momentum_rule()
    records = cut_lineage(MM.with_compound(memories).withColumn("jumped", F.lit(False)).select(
        "symbol", "id", "seq", "created", "sim", *_STATE), "loop_records")
    live = records.where("created < 0").drop("created")
    got, steps, applied = [], [], []

    def union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out
    for day in range(days):
        state = cut_lineage(live.unionByName(records.where(F.col("created") == day).drop("created")), "loop_state")
        retrieved = cut_lineage(R.hybrid_of(state, ["symbol", "layer"], top_k).withColumn("day", F.lit(day)), "loop_retrieved")
        got.append(retrieved)
        known = prices.where(F.col("day") <= day)
        said = decide(known, retrieved).where(F.col("day") == day).select("symbol", "direction")
        steps.append(cut_lineage(known.where(F.col("day") == day).join(said, "symbol").select(
            "day", "symbol", "price", "direction"), "loop_steps"))
        # the last steps decide the feedback; it is for the day that the look-back starts after
        fed = P.feedback(union(steps).withColumnRenamed("day", "date"), ("symbol",), lookback).where(
            F.col("date") == day).where("feedback IS NOT NULL").select("symbol", "feedback", F.col("feedback_date").alias("day"))
        cited = union(got).select("symbol", "day", "id").distinct()
        events = cut_lineage(cited.join(fed, ["symbol", "day"]).select("symbol", "id", "feedback"), "loop_events")
        applied.append(events.withColumn("day", F.lit(day)))
        after = step_day(state, events, params, feedback_after_jump)
        live = cut_lineage(after.where("alive").select("symbol", "id", "seq", "sim", *_STATE), "loop_live")
    return Replay(union(got), union(steps), union(applied), live)
