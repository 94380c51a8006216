"""Order-dependent building blocks that stay balanced under key skew.

* ``keep_first``: "sort, then drop duplicates keeping the first" as
  ``row_number() = 1``.  Catalyst turns it into a WindowGroupLimit that runs
  partially *before* the shuffle, so a hot key sends at most one row per map
  task.
* ``previous_in_order``: the previous row's value in a total order within a
  partition key (a ``lag``), computed per minute block with minute / year carry
  tables, so no window holds a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def keep_first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                 rank_col: str | None = None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank_col) if rank_col else out.drop("_rn")


# Time units of the nested blocks, finest first; each nests inside the next one.
BLOCK_UNITS = ("minute", "year")


def previous_in_order(df: DataFrame, keys: Sequence[str], ts_col: str, tie_col: str,
                      value_col: str, out_col: str, units: Sequence[str] = BLOCK_UNITS) -> DataFrame:
    """``out_col`` = ``value_col`` of the previous row ordered by (ts_col, tie_col) within ``keys``.

    Equal to ``lag`` over ``keys``, but no window ever holds a whole key: rows are
    windowed per (keys, minute); the last value of every minute is carried to the
    next one through a per-minute table whose windows hold at most the 527,040
    minutes of one year, and the last value of each year through a per-year table
    (a calendar bound, whatever the data volume).  More ``units`` (hour, day,
    month) shrink the windows further at the cost of more stages.
    """
    keys = list(keys)
    value_col, plain = "_value", value_col
    df = df.withColumn(value_col, F.struct(F.col(plain).alias("v")))    # a NULL value is a predecessor too
    u = [f"_u{i}" for i in range(len(units))]
    b = df
    for name, unit in zip(u, units):
        b = b.withColumn(name, F.date_trunc(unit, F.col(ts_col)))
    w = Window.partitionBy(*keys, u[0]).orderBy(ts_col, tie_col)
    b = b.withColumn(out_col, F.lag(value_col).over(w)).withColumn("_first", F.row_number().over(w) == 1)

    # last value per unit, and the previous unit's last value within the parent unit
    order = F.struct(F.col(ts_col), F.col(tie_col))
    levels = []
    cur = b.groupBy(*keys, *u).agg(F.max_by(F.col(value_col), order).alias("_last"))
    for i in range(len(u)):
        parent = u[i + 1:i + 2]
        lv = cur.withColumn("_p", F.lag("_last").over(Window.partitionBy(*keys, *parent).orderBy(u[i])))
        levels.append(lv)
        if i + 1 < len(u):
            cur = lv.groupBy(*keys, *u[i + 1:]).agg(F.max_by("_last", u[i]).alias("_last"))

    # resolve from the coarsest unit down: the value before a unit is its own lag, else the parent's
    prev = levels[-1].select(*keys, u[-1], F.col("_p").alias("_before"))
    for i in range(len(u) - 2, -1, -1):
        lv = levels[i].select(*keys, *u[i:i + 2], "_p")
        prev = (lv.join(prev, [*keys, u[i + 1]], "left")
                  .select(*keys, u[i], F.coalesce("_p", "_before").alias("_before")))
    j = b.join(prev, [*keys, u[0]], "left")
    return (j.withColumn(out_col, F.when(F.col("_first"), F.col("_before")).otherwise(F.col(out_col))["v"])
             .drop(*u, "_first", "_before", value_col))
