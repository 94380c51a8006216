"""Portfolio windows.

A portfolio is the ordered series of steps of one (symbol[, model]); the
reference keeps numpy arrays of prices and shares, here every array becomes a
window partitioned by the series key and ordered by date.  Sums over the
look-back are written as explicit lag chains, added oldest first, so the sign
matches a running cumulative sum exactly even when it is close to zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys):
    return Window.partitionBy(*keys).orderBy("date")


def _ordered_sum(x: Column, w, n: int) -> Column:
    """x[t-n+1] + ... + x[t], summed oldest first."""
    terms = [F.lag(x, k).over(w) if k else x for k in range(n - 1, -1, -1)]
    acc = terms[0]
    for t in terms[1:]:
        acc = acc + t
    return acc


def next_day_record(prices: DataFrame, keys=("symbol",), keep_last: bool = False) -> DataFrame:
    """record = next row's price - this price; the last row has none and is removed."""
    w = _w(keys)
    out = prices.withColumn("record", F.lead("price").over(w) - F.col("price"))
    return out if keep_last else out.where(F.col("record").isNotNull())


def momentum(prices: DataFrame, keys=("symbol",), window: int = 3) -> DataFrame:
    """Sign of the sum of the last ``window`` price changes, once more than ``window`` steps exist.

    Tagged with the date ``window - 1`` rows back, as the reference reports it.
    """
    w = _w(keys)
    diff = F.col("price") - F.lag("price", 1).over(w)
    df = prices.withColumn("_d", diff).withColumn("_n", F.row_number().over(w))
    s = _ordered_sum(F.col("_d"), w, window)
    gate = F.col("_n") > window
    return (df.withColumn("momentum", F.when(gate, F.signum(s).cast("int")))
            .withColumn("momentum_date", F.when(gate, F.lag("date", window - 1).over(w)))
            .drop("_d", "_n"))


def holdings(actions: DataFrame, keys=("symbol", "model")) -> DataFrame:
    """Shares held after each step = running sum of directions."""
    w = _w(keys).rowsBetween(Window.unboundedPreceding, 0)
    return actions.withColumn("shares", F.sum("direction").over(w))


def feedback(steps: DataFrame, keys=("symbol", "model"), lookback: int = 7) -> DataFrame:
    """Sign of sum over the last ``lookback`` steps of price change x shares held before it.

    ``steps`` has (keys, date, price, direction).  Emitted once more than
    ``lookback`` steps exist; tagged with the date ``lookback - 1`` rows back.
    """
    w = _w(keys)
    df = holdings(steps, keys)
    x = (F.col("price") - F.lag("price", 1).over(w)) * F.lag("shares", 1).over(w)
    df = df.withColumn("_x", x).withColumn("_n", F.row_number().over(w))
    gate = F.col("_n") > lookback
    s = _ordered_sum(F.col("_x"), w, lookback)
    return (df.withColumn("feedback", F.when(gate, F.signum(s).cast("int")))
            .withColumn("feedback_date", F.when(gate, F.lag("date", lookback - 1).over(w)))
            .drop("_x", "_n"))


def is_monday(date: Column) -> Column:
    """B13 (Spark numbers Sunday=1, so Monday=2)."""
    return F.dayofweek(date) == 2


def train_direction(record: Column) -> Column:
    """H18 train rule: record > 0 -> 1, otherwise (zero included) -1."""
    return F.when(record > 0, F.lit(1)).otherwise(F.lit(-1))


def test_direction(decision: Column) -> Column:
    """H18 test rule: buy -> 1, hold or no decision -> 0, anything else -> -1."""
    return (F.when(decision == "buy", F.lit(1))
            .when(decision.isNull() | (decision == "hold") | (decision == ""), F.lit(0))
            .otherwise(F.lit(-1)))


def monday_steps(prices: DataFrame, keys=("symbol",)) -> DataFrame:
    """Q11: record computed over every priced row first, then only Mondays are stepped."""
    rec = next_day_record(prices, keys)
    return (rec.where(is_monday(F.col("date")))
            .withColumn("train_direction", train_direction(F.col("record")))
            .withColumn("reflect", F.col("record").isNotNull() & (F.col("record") != 0)))
