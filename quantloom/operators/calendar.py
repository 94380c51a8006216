"""Trading-calendar alignment (C5, C6) and week blocks.

The forward as-of join is an equi-join on the day: the calendar is expanded
once into a "day -> next trading day" table (bounded by the calendar span,
not by the data) and joined to the input rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


MAX_FORWARD_DAYS = 10  # fixed value: the capped search gives up after 10 days


def trading_calendar(prices: DataFrame, weekdays_only: bool = True, key: str | None = None) -> DataFrame:
    """Distinct priced dates (Mon-Fri by default), shared or per ``key``."""
    cols = ([key] if key else []) + ["date"]
    cal = prices.select(*cols).distinct()
    if weekdays_only:
        cal = cal.where(~F.dayofweek("date").isin(1, 7))
    return cal


def next_trading_day(df: DataFrame, calendar: DataFrame, date_col: str = "date",
                     key: str | None = None, out_col: str = "trading_day") -> DataFrame:
    """First calendar date >= ``date_col``; NULL plus ``beyond_calendar`` when none exists.

    The mapping is built from the calendar alone: each trading day ``td``
    covers the days after the previous trading day up to itself (a table the
    size of the calendar span), the first trading day also covers every earlier
    day.  The input is read once and joined on (key, day), so an expensive
    upstream plan is never evaluated twice.
    """
    keys = [key] if key else []
    cal = calendar.select(*keys, F.col("date").alias("_td")).distinct()
    w = (Window.partitionBy(*keys) if keys else Window).orderBy("_td")
    spans = cal.withColumn("_prev", F.lag("_td").over(w)).where(F.col("_prev").isNotNull())
    cover = spans.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                         F.explode(F.sequence(F.date_add("_prev", 1), F.col("_td"))).alias("_day"),
                         F.col("_td").alias("_next"))
    cond = [F.col(date_col) == F.col("_day")] + [F.col(k) == F.col(f"_k_{k}") for k in keys]
    j = df.join(cover, cond, "left").drop("_day", *[f"_k_{k}" for k in keys])
    if keys:
        first = cal.groupBy(*keys).agg(F.min("_td").alias("_first"))
        j = j.join(first, keys, "left")
        first_col = F.col("_first")
    else:
        first_col = F.lit(cal.agg(F.min("_td")).first()[0]).cast("date")   # one scalar
    td = F.when(F.col(date_col) <= first_col, first_col).otherwise(F.col("_next"))
    out = j.withColumn(out_col, td).withColumn("beyond_calendar", F.col(out_col).isNull())
    return out.drop("_next", "_first") if keys else out.drop("_next")


def next_trading_day_capped(df: DataFrame, calendar: DataFrame, date_col: str = "date",
                            key: str | None = None, out_col: str = "trading_day",
                            max_days: int = MAX_FORWARD_DAYS) -> DataFrame:
    """Like C5 but gives up after ``max_days`` and keeps date + max_days.

    An empty calendar leaves the dates as they are: with ``key``, those of every
    key that the calendar does not hold; without, all of them (a one-row probe).
    """
    if key is None and calendar.isEmpty():
        return df.withColumn(out_col, F.col(date_col))
    j = next_trading_day(df, calendar, date_col, key, "_td2")
    gap = F.datediff(F.col("_td2"), F.col(date_col))
    out = F.when(F.col("_td2").isNotNull() & (gap <= max_days), F.col("_td2")).otherwise(
        F.date_add(F.col(date_col), max_days))
    if key is not None:
        held = calendar.select(key).distinct().withColumn("_held", F.lit(True))
        j = j.join(held, key, "left")
        out = F.when(F.col("_held"), out).otherwise(F.col(date_col))
    return j.withColumn(out_col, out).drop("_td2", "beyond_calendar", "_held")


def week_blocks(df: DataFrame, start_col: str, end_col: str) -> DataFrame:
    """H28 as rows: one (week_start, week_end) row per 7-day block of [start, end]."""
    from quantloom.functions.timefns import week_ranges
    return df.select("*", F.explode(week_ranges(start_col, end_col)).alias("_w")).select(
        "*", "_w.week_start", "_w.week_end").drop("_w")
