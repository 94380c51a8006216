"""Date / time scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"  # fixed value: exchange time zone
CLOSE_HOUR = 16               # fixed value: market close hour


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def after_close_date(ts) -> Column:
    """H7: news at or after 16:00 belongs to the next calendar date."""
    t = _c(ts)
    return F.when(F.hour(t) >= CLOSE_HOUR, F.date_add(F.to_date(t), 1)).otherwise(F.to_date(t))


def round_next_day(ts) -> Column:
    """H8: after 16:00 with a non-zero minute or second -> next day 09:00; else same day 09:00.

    16:00:00 exactly stays on its day (Q14); month ends roll correctly (Q15).
    """
    t = _c(ts)
    late = (F.hour(t) >= CLOSE_HOUR) & ((F.minute(t) > 0) | (F.second(t) > 0))
    d = F.when(late, F.date_add(F.to_date(t), 1)).otherwise(F.to_date(t))
    return F.make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d), F.lit(9), F.lit(0), F.lit(0))


def utc_to_eastern(ts) -> Column:
    """H9: a naive UTC wall-clock time to naive US/Eastern wall-clock time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(EASTERN), _c(ts).cast("timestamp_ntz"))


def iso_date(d) -> Column:
    """H33."""
    return F.date_format(_c(d), "yyyy-MM-dd")


def week_ranges(start, end) -> Column:
    """Array of (week_start, week_end) 7-day blocks over [start, end], last one clipped."""
    s, e = _c(start), _c(end)
    starts = F.sequence(s, e, F.expr("interval 7 days"))
    return F.transform(starts, lambda x: F.struct(x.alias("week_start"),
                                                  F.least(F.date_add(x, 6), e).alias("week_end")))
