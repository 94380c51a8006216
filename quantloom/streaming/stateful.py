"""Keyed state with event-time timers (S2, S3, S5): rows wait until the watermark has passed them.

Every key holds its waiting rows sorted by event time; a timer per time releases them in order once the
watermark is there, so the order of files and rows inside the allowed delay does not matter.  A row at or behind the
watermark is late: it is not applied and comes out with ``late = true`` (``late_rows`` splits the two outputs).
Spark's own filter would drop such rows unseen; it goes by the watermark's column, so only a plain copy of the
time (milliseconds) reaches the state.

``MemorySteps`` (S2) steps a record inside the stream: at the end of every step it applies the step's feedback, ages,
cleans up and moves the record, emits the new state and sets the timer of the next step; the
state of a dead record is deleted.  ``PortfolioSeries`` (S3) keeps the last look-back + 1 rows of a series.
"""

from __future__ import annotations

import math
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quantloom.operators import memory as MM

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _stateful(rows: DataFrame, keys: list[str], at, values: list[str], delay: str, processor, out: str) -> DataFrame:
    """``processor`` over ``rows`` grouped by ``keys``; ``at`` is the timestamp column of the event time."""
    marked = rows.withColumn("_event_time", at).withWatermark("_event_time", delay)
    plain = marked.select(*keys, F.unix_millis("_event_time").alias("at"), *values)
    return plain.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", "EventTime")


def late_rows(out: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applied rows, late rows) of a stateful result."""
    return out.where("NOT late").drop("late"), out.where("late").drop("late")


# ------------------------------------------------------------------ S3 portfolio series

PORTFOLIO_IN = "symbol string, model string, date date, price double, direction int"
PORTFOLIO_OUT = ("symbol string, model string, date date, shares long, momentum int, momentum_date date, "
                 "feedback int, feedback_date date, late boolean")
_SERIES = "n long, shares long, prices array<double>, held array<long>, days array<long>"     # days: ordinals
_WAITING = "at array<long>, days array<long>, prices array<double>, directions array<long>"


def _sign_of_sum(terms) -> int:
    total = 0.0
    for x in terms:         # oldest first, as the window version adds
        total += x
    return (total > 0) - (total < 0)


class PortfolioSeries(StatefulProcessor):
    def __init__(self, lookback: int, moment_window: int):
        self.lookback, self.window = lookback, moment_window

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", _WAITING)
        self.series = handle.getValueState("series", _SERIES)

    def _read(self) -> list[tuple]:
        return list(zip(*self.waiting.get())) if self.waiting.exists() else []

    def _write(self, rows: list[tuple]) -> None:
        """Keep the waiting rows, sorted; the first one's timer wakes the series."""
        if rows:
            self.waiting.update(tuple(map(list, zip(*rows))))
            self.handle.registerTimer(rows[0][0])
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues):
        mark, late, waiting = timerValues.getCurrentWatermarkInMs(), [], self._read()
        times = {r[0] for r in waiting}
        for pdf in rows:
            for r in pdf[pdf["date"].notna()].itertuples(index=False):
                if r.at <= mark or r.at in times:       # a second row of a time that waits already is late, too
                    late.append((*key, r.date, None, None, None, None, None, True))
                else:
                    times.add(r.at)
                    waiting.append((int(r.at), r.date.toordinal(), float(r.price), int(r.direction)))
        self._write(sorted(waiting))
        yield pd.DataFrame(late, columns=_columns(PORTFOLIO_OUT))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark, waiting = timerValues.getCurrentWatermarkInMs(), self._read()
        due = [r for r in waiting if r[0] <= mark]
        n, shares, prices, held, days = self.series.get() if self.series.exists() else (0, 0, [], [], [])
        prices, held, days, out = list(prices), list(held), list(days), []
        keep, back, win = max(self.lookback, self.window) + 1, self.lookback, self.window
        for _, day, price, direction in due:
            n, shares = n + 1, shares + direction
            prices, held, days = [*prices, price][-keep:], [*held, shares][-keep:], [*days, day][-keep:]
            moves = [b - a for a, b in zip(prices, prices[1:])]
            mom = (_sign_of_sum(moves[-win:]), date.fromordinal(days[-win])) if n > win else (None, None)
            gains = [m * h for m, h in zip(moves, held)]
            fed = (_sign_of_sum(gains[-back:]), date.fromordinal(days[-back])) if n > back else (None, None)
            out.append((*key, date.fromordinal(day), shares, *mom, *fed, False))
        if due:
            self.series.update((n, shares, prices, held, days))
            self._write(waiting[len(due):])
        yield pd.DataFrame(out, columns=_columns(PORTFOLIO_OUT))

    def close(self) -> None:
        pass


def portfolio_stream(steps: DataFrame, lookback: int = 7, moment_window: int = 3, delay: str = "0 days") -> DataFrame:
    """S3 over a stream of PORTFOLIO_IN rows; ``delay`` is how far rows may be out of order.

    Rows whose date is null only carry the stream on (a closing row may have any later step).
    """
    at = F.coalesce(F.col("date").cast("timestamp"), F.col("_close") if "_close" in steps.columns else F.lit(None))
    return _stateful(steps, ["symbol", "model"], at, ["date", "price", "direction"], delay,
                     PortfolioSeries(lookback, moment_window), PORTFOLIO_OUT)


# ------------------------------------------------------------------ S2 memory records

EVENT_IN = ("symbol string, id long, step int, kind string, feedback int, layer string, "
            "importance double, recency double, delta int, access_counter int")
STEP_OUT = ("symbol string, id long, step int, layer string, importance double, recency double, delta int, "
            "compound double, access_counter int, alive boolean, jumped boolean, transition string, late boolean")
_RECORD = "layer string, importance double, recency double, delta int, compound double, access_counter int, " \
          "jumped boolean, transition string, step int"


def step_record(record: dict, fed: list[int], params: dict, jumps: dict, feedback_after_jump: bool) -> dict:
    """One replay step of a live record: the step's feedback, then ageing, clean-up and moves."""
    r = dict(record)
    for fb in fed:
        if fb and (feedback_after_jump or not r["jumped"]):
            r["access_counter"] += fb
            r["importance"] += MM.ACCESS_STEP * r["access_counter"]
            r["compound"] = r["recency"] + min(r["importance"], MM.IMPORTANCE_CAP) / 100.0
    p = params[r["layer"]]
    r["delta"] += 1
    r["recency"] = math.exp(-(r["delta"] / p.recency_factor))
    r["importance"] *= p.importance_factor
    r["compound"] = r["recency"] + min(r["importance"], MM.IMPORTANCE_CAP) / 100.0
    r["alive"] = not (r["recency"] < p.recency_threshold or r["importance"] < p.importance_threshold)
    if r["alive"]:
        for low, high, layer, up, path in jumps.get(r["layer"], ()):
            if (low is None or r["importance"] >= low) and (high is None or r["importance"] < high) and path:
                r["layer"], r["jumped"], r["transition"] = layer, True, r["transition"] + path
                if up:
                    r["recency"], r["delta"] = MM.RECENCY_INIT, 0
                break
    return r


class MemorySteps(StatefulProcessor):
    def __init__(self, n_steps: int, params, feedback_after_jump: bool):
        self.n_steps, self.after_jump = n_steps, feedback_after_jump
        self.params, self.jumps = {p.layer: p for p in params}, {}
        for layer, low, high, final, up, _, path in MM._jump_table(params):
            self.jumps.setdefault(layer, []).append((low, high, final, up, path))

    def init(self, handle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", _RECORD)
        self.fed = handle.getMapState("fed", "step int", "feedback array<int>")

    def _await(self, step: int) -> None:
        self.handle.registerTimer(step * DAY_MS)

    def handleInputRows(self, key, rows, timerValues):
        mark, late = timerValues.getCurrentWatermarkInMs(), []
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                step = int(r.step)
                if r.kind not in ("add", "feedback"):
                    continue            # a clock row
                if r.at <= mark:
                    late.append((*key, step, *[None] * 9, True))
                elif r.kind == "add":
                    imp, rec = float(r.importance), float(r.recency)
                    self.record.update((r.layer, imp, rec, int(r.delta), rec + min(imp, MM.IMPORTANCE_CAP) / 100.0,
                                        int(r.access_counter), False, "", step))
                    self._await(step)
                else:
                    had = list(self.fed.getValue((step,))[0]) if self.fed.containsKey((step,)) else []
                    self.fed.updateValue((step,), (sorted([*had, int(r.feedback)]),))
                    self._await(step)
        yield pd.DataFrame(late, columns=_columns(STEP_OUT))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        reached = timerValues.getCurrentWatermarkInMs() // DAY_MS
        names, out = _columns(_RECORD), []
        r = dict(zip(names, self.record.get())) if self.record.exists() else None
        while r and r["step"] <= min(reached, self.n_steps):
            k = r["step"]
            fed = list(self.fed.getValue((k,))[0]) if self.fed.containsKey((k,)) else []
            r = step_record(r, fed, self.params, self.jumps, self.after_jump)
            out.append((*key, k, *[r[c] for c in _columns(STEP_OUT)[3:-1]], False))
            r["step"] = k + 1
            if not r["alive"]:
                r = None
        # feedback of steps gone by: applied, or for a record that is not there
        for k in [k[0] for k in self.fed.keys() if k[0] <= reached]:
            self.fed.removeKey((k,))
        if r is not None and r["step"] <= self.n_steps:
            if out:
                self.record.update(tuple(r[c] for c in names))
                self._await(r["step"])
        else:
            self.record.clear()
        yield pd.DataFrame(out, columns=_columns(STEP_OUT))

    def close(self) -> None:
        pass


def memory_steps_stream(events: DataFrame, n_steps: int, params=MM.DEFAULT_PARAMS, feedback_after_jump: bool = False,
                        delay: str = "0 days") -> DataFrame:
    """S2 over a stream of EVENT_IN rows (kind 'add', 'feedback', or any other for a clock row): one row per record
    and step it lives through, the one in which it dies included, and a row per late event.

    Event time is the step's number in days.  A step ends when the watermark reaches it, so input has to end with a row of a
    step after the last one; a record's state goes when it dies or has done its ``n_steps``-th step.  A row without an
    id belongs to no record and counts as a clock row.
    """
    # a null among the ids of a batch would turn them into floats, keys included
    events = events.withColumns({"kind": F.when(F.col("id").isNull(), "clock").otherwise(F.col("kind")),
                                 "id": F.coalesce("id", F.lit(-1).cast("long"))})
    at = F.timestamp_millis(F.col("step").cast("long") * DAY_MS)
    return _stateful(events, ["symbol", "id"], at, _columns(EVENT_IN)[2:], delay,
                     MemorySteps(n_steps, params, feedback_after_jump), STEP_OUT)
