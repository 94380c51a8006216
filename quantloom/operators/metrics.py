"""Back-test metrics (P8-P10): rewards, cumulative rewards, risk metrics, Wilcoxon.

All series are keyed by ``symbol`` (and ``model`` for actions); every window
is partitioned by those keys and ordered by ``date``, so the work spreads
over symbols and models.  A series holds one row per trading day, so the
rows of one window partition are bounded by the calendar, not by the data.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.numeric import TRADING_DAYS, log_return, r6, safe_div, sig9

BUY_AND_HOLD = "Buy & Hold"  # fixed value: name of the benchmark model


def restrict_dates(df: DataFrame, start=None, end=None, end_inclusive: bool = False,
                   col: str = "date") -> DataFrame:
    """B1 (closed) / B2 (half-open) date range; None means unbounded."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(col) >= F.lit(start).cast("date"))
    if end is not None:
        e = F.lit(end).cast("date")
        cond = cond & ((F.col(col) <= e) if end_inclusive else (F.col(col) < e))
    return df.where(cond)


def with_next_price(prices: DataFrame, key: str = "symbol") -> DataFrame:
    """E3 input: next trading day's price per symbol (NULL on the last day)."""
    w = Window.partitionBy(key).orderBy("date")
    return prices.withColumn("next_price", F.lead("price").over(w))


def positional_pairs(prices: DataFrame, actions: DataFrame, by: str = "model") -> DataFrame:
    """Pair the i-th price with the i-th action of each (symbol, model) series."""
    wp = Window.partitionBy("symbol").orderBy("date")
    wa = Window.partitionBy("symbol", by).orderBy("date")
    p = with_next_price(prices).withColumn("pos", F.row_number().over(wp))
    a = actions.withColumn("pos", F.row_number().over(wa)).withColumnRenamed("date", "action_date")
    return a.join(p, ["symbol", "pos"])


def daily_rewards(prices: DataFrame, actions: DataFrame, by: str = "model") -> DataFrame:
    """reward_i = direction_i * ln(p_{i+1}/p_i), date-keyed pairing.

    Output: (symbol, model, date, price, next_price, direction, reward);
    ``reward`` is NULL on the last priced day of the series.
    """
    p = with_next_price(prices.select("symbol", "date", "price"))
    j = actions.select("symbol", by, "date", "direction").join(p, ["symbol", "date"])
    return j.withColumn("reward", F.col("direction") * log_return(F.col("price"), F.col("next_price")))


def with_buy_and_hold(prices: DataFrame, actions: DataFrame, by: str = "model") -> DataFrame:
    """Add the all-ones benchmark model for every priced day."""
    bh = prices.select(F.lit(BUY_AND_HOLD).alias(by), "symbol", "date", F.lit(1).alias("direction"))
    return actions.select(by, "symbol", "date", "direction").unionByName(bh)


def _equity_columns(rewards: DataFrame, by: str) -> DataFrame:
    """Running product of (1 + r) starting at 1 and its running peak."""
    w = Window.partitionBy("symbol", by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    r = rewards.where(F.col("reward").isNotNull())
    eq = r.withColumn("equity", F.product(F.lit(1.0) + F.col("reward")).over(w))
    return eq.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w)))


def backtest_metrics(rewards: DataFrame, by: str = "model", price_days: DataFrame | None = None) -> DataFrame:
    """Cumulative return, Sharpe, std dev, annualised volatility, max drawdown.

    ``rewards`` is the output of ``daily_rewards``; ``n_price`` counts the
    priced days of the series (the Sharpe divisor uses prices, not returns):
    ``price_days`` (symbol, n_price), or the reward rows of a model that acts on every day.
    """
    eq = _equity_columns(rewards, by)
    dd = (F.col("peak") - F.col("equity")) / F.col("peak")
    per_model_days = rewards.groupBy("symbol", by).agg(F.count(F.lit(1)).alias("n_price"))
    if price_days is not None:
        per_model_days = per_model_days.drop("n_price").join(price_days, "symbol")
    agg = eq.groupBy("symbol", by).agg(
        F.sum("reward").alias("cum_return"),
        F.stddev_samp("reward").alias("std_dev"),
        F.greatest(F.lit(0.0), F.max(dd)).alias("max_drawdown"),
    )
    vol = F.col("std_dev") * F.lit(TRADING_DAYS ** 0.5)
    sharpe = safe_div(F.col("cum_return") / (F.col("n_price") / F.lit(float(TRADING_DAYS))), vol)
    return (per_model_days.join(agg, ["symbol", by], "left")
            .select("symbol", by, "n_price",
                    F.coalesce(F.col("cum_return"), F.lit(0.0)).alias("cum_return"),
                    "std_dev", vol.alias("ann_vol"), sharpe.alias("sharpe"),
                    F.coalesce(F.col("max_drawdown"), F.lit(0.0)).alias("max_drawdown")))


def positional_rewards(prices: DataFrame, actions: DataFrame, by: str = "model") -> DataFrame:
    """E4 on C7 pairs: the i-th action earns the return of the i-th price, whatever their dates; ``date`` is the price's."""
    j = positional_pairs(prices.select("symbol", "date", "price"), actions.select("symbol", by, "date", "direction"), by)
    return j.drop("action_date", "pos").withColumn(
        "reward", F.col("direction") * log_return(F.col("price"), F.col("next_price")))


def backtest_report(prices: DataFrame, actions: DataFrame, by: str = "model",
                    include_buy_and_hold: bool = True, positional: bool = False) -> DataFrame:
    """One metric row per (symbol, model), buy-and-hold included.

    Actions pair with prices by date, or with ``positional`` by their place in the series (C7).
    """
    acts = with_buy_and_hold(prices, actions, by) if include_buy_and_hold else actions
    days = prices.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_price"))
    rewards = positional_rewards if positional else daily_rewards
    return backtest_metrics(rewards(prices, acts, by), by, days)


def price_summary(prices: DataFrame) -> DataFrame:
    """D17 per symbol: count, mean, sample std dev, min, exact quartiles (interpolated) and max.

    The exact percentile holds one series' distinct prices, a number bounded by the calendar.
    """
    quart = F.percentile("price", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = prices.groupBy("symbol").agg(
        F.count("price").alias("count"), F.avg("price").alias("mean"), F.stddev_samp("price").alias("std"),
        F.min("price").alias("min"), quart.alias("_q"), F.max("price").alias("max"))
    return g.select("symbol", "count", "mean", "std", "min", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"),
                    F.col("_q")[2].alias("q75"), "max")


def report_rounded(rep: DataFrame, by: str = "model") -> DataFrame:
    return rep.select("symbol", by, "n_price", r6("cum_return").alias("cum_return"),
                      r6("std_dev").alias("std_dev"), r6("ann_vol").alias("ann_vol"),
                      r6("sharpe").alias("sharpe"), sig9("max_drawdown").alias("max_drawdown"))


def report_matrix(rep: DataFrame, by: str = "model") -> DataFrame:
    """Long (symbol, model, metric, value) form; pivot on ``model`` for the wide view."""
    return rep.select("symbol", by, F.expr(
        "stack(5, 'Cumulative Return', cum_return, 'Sharpe Ratio', sharpe, "
        "'Standard Deviation', std_dev, 'Annualized Volatility', ann_vol, "
        "'Max Drawdown', max_drawdown) as (metric, value)"))


def cumulative_rewards(rewards: DataFrame, by: str = "model", leading_zero: bool = True) -> DataFrame:
    """E5 (with a leading 0 on the first day) / E6 (running sum of realised rewards).

    With ``leading_zero`` the value on day i is the sum of rewards of days < i,
    so the first day is 0 and the last priced day carries the total.
    Without it, day i carries the sum of rewards of days <= i and the last
    day (no next price) is dropped.
    """
    w = Window.partitionBy("symbol", by).orderBy("date")
    if leading_zero:
        prev = F.coalesce(F.lag("reward").over(w), F.lit(0.0))
        s = rewards.withColumn("_r", prev)
        return s.withColumn("cum_reward", F.sum("_r").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_r")
    s = rewards.where(F.col("reward").isNotNull())
    return s.withColumn("cum_reward", F.sum("reward").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def price_range(prices: DataFrame) -> DataFrame:
    """Max - min price per symbol."""
    return prices.groupBy("symbol").agg((F.max("price") - F.min("price")).alias("price_range"))


def pct_change_std(prices: DataFrame) -> DataFrame:
    """Sample std dev of the simple daily change (p_{i+1}-p_i)/p_i per symbol."""
    p = with_next_price(prices)
    chg = safe_div(F.col("next_price") - F.col("price"), F.col("price"))
    return p.groupBy("symbol").agg(F.stddev_samp(chg).alias("pct_change_std"))


# ---------------------------------------------------------------- Wilcoxon

def model_pairs(series: DataFrame, by: str = "model") -> DataFrame:
    """C14: pair the series of two models i < j on (symbol, date).

    Values are rounded to 9 digits, so sums that differ only by their order count as equal.
    """
    value = F.round("cum_reward", 9)
    a = series.select("symbol", "date", F.col(by).alias("model_a"), value.alias("x"))
    b = series.select("symbol", "date", F.col(by).alias("model_b"), value.alias("y"))
    return a.join(b, ["symbol", "date"]).where(F.col("model_a") < F.col("model_b"))


def wilcoxon_stat(paired: DataFrame, keys=("symbol", "model_a", "model_b")) -> DataFrame:
    """Signed-rank statistic per pair: zero differences dropped, ties get average ranks.

    Returns (keys..., n, w_plus, w_minus, stat, z, tie_term) where
    ``stat = min(W+, W-)`` and ``z`` is the tie-corrected normal score.
    """
    keys = list(keys)
    d = paired.withColumn("d", F.col("x") - F.col("y")).where(F.col("d") != 0)
    d = d.withColumn("ad", F.abs("d"))
    w_rank = Window.partitionBy(*keys).orderBy("ad")
    w_tie = Window.partitionBy(*keys, "ad")
    ranked = (d.withColumn("_rk", F.rank().over(w_rank))
              .withColumn("_t", F.count(F.lit(1)).over(w_tie))
              .withColumn("avg_rank", F.col("_rk") + (F.col("_t") - F.lit(1)) / F.lit(2.0)))
    t = F.col("_t")
    out = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("d") > 0, F.col("avg_rank")).otherwise(F.lit(0.0))).alias("w_plus"),
        F.sum(F.when(F.col("d") < 0, F.col("avg_rank")).otherwise(F.lit(0.0))).alias("w_minus"),
        F.sum(t * t - F.lit(1)).alias("tie_term"),      # t^3 - t per group of t equal differences
    )
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("tie_term") / 48.0
    stat = F.least("w_plus", "w_minus")
    return out.select(*keys, "n", "w_plus", "w_minus", stat.alias("stat"),
                      F.when(var > 0, (stat - mean) / F.sqrt(var)).alias("z"), "tie_term")


def _exact_signed_rank_cdf(n: int, w: float) -> float:
    """P(W+ <= w) for n untied non-zero differences (subset-sum counts of 1..n)."""
    import numpy as np
    top = n * (n + 1) // 2
    counts = np.zeros(top + 1, dtype=np.float64)
    counts[0] = 1.0
    for k in range(1, n + 1):
        counts[k:] = counts[k:] + counts[:-k].copy()
    return float(counts[: int(np.floor(w)) + 1].sum() / 2.0 ** n)


def signed_rank_pvalue(n: int | None, stat: float | None, z: float | None, ties: float | None,
                       exact_max_n: int = 50) -> float | None:
    """Two-sided p: exact for n <= 50 without ties, else the tie-corrected normal tail."""
    import math
    if n is None or stat is None or n == 0:
        return None
    if n <= exact_max_n and not ties:
        return min(1.0, 2.0 * _exact_signed_rank_cdf(int(n), float(stat)))
    if z is None:
        return None
    return math.erfc(abs(z) / math.sqrt(2.0))


def with_pvalue(stats: DataFrame) -> DataFrame:
    """D15 p-value on the one-row-per-pair output of ``wilcoxon_stat`` (Arrow UDF, tiny input)."""
    @F.pandas_udf("double")
    def pval(n: pd.Series, stat: pd.Series, z: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_pvalue(None if pd.isna(a) else int(a), None if pd.isna(b) else b,
                                             None if pd.isna(c) else c, None if pd.isna(d) else d)
                          for a, b, c, d in zip(n, stat, z, ties)], dtype="float64")
    return stats.withColumn("p_value", pval("n", "stat", "z", "tie_term"))
