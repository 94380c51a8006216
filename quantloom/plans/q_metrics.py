"""Registered queries: back-test metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.numeric import r6
from quantloom.operators import metrics as M
from quantloom.plans.fixtures_sql import ACTIONS, PRICES, with_
from quantloom.plans.registry import register
from quantloom.sources.tables import Tables

_ACTS_BH = """acts AS (
  select model, symbol, date, direction from actions
  union all select 'Buy & Hold', symbol, date, 1 from prices)"""
_P_NEXT = """p AS (select symbol, date, price, lead(price) over (partition by symbol order by date) as next_price
  from prices)"""
_RW = """rw AS (
  select a.symbol, a.model, a.date, a.direction,
         a.direction * case when p.price > 0 and p.next_price > 0 then ln(p.next_price / p.price) end as reward
  from acts a join p on a.symbol = p.symbol and a.date = p.date)"""


BACKTEST_SQL = with_(PRICES, ACTIONS, _ACTS_BH, _P_NEXT, _RW, """eq AS (
  select symbol, model, date, reward,
         product(1 + reward) over (partition by symbol, model order by date
                                   rows between unbounded preceding and current row) as equity
  from rw where reward is not null)""", """eq2 AS (
  select *, greatest(1.0, max(equity) over (partition by symbol, model order by date
                                            rows between unbounded preceding and current row)) as peak
  from eq)""", """agg AS (
  select symbol, model, sum(reward) as cum_return, stddev_samp(reward) as std_dev,
         greatest(0.0, max((peak - equity) / peak)) as max_drawdown
  from eq2 group by 1, 2)""", """n AS (select symbol, model, count(*) as n_price from rw group by 1, 2)""") + """
select n.symbol, n.model, n.n_price,
       round(coalesce(agg.cum_return, 0.0), 6) as cum_return,
       round(agg.std_dev, 6) as std_dev,
       round(agg.std_dev * sqrt(252), 6) as ann_vol,
       round(case when agg.std_dev * sqrt(252) <> 0
                  then (agg.cum_return / (n.n_price / 252.0)) / (agg.std_dev * sqrt(252)) end, 6) as sharpe,
       cast(printf('%.8e', coalesce(agg.max_drawdown, 0.0)) as double) as max_drawdown
from n left join agg on n.symbol = agg.symbol and n.model = agg.model
"""


@register("backtest_report", BACKTEST_SQL)
def q_backtest_report(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return M.report_rounded(M.backtest_report(t.prices, t.actions))


_MONDAYS_SQL = BACKTEST_SQL.replace(
    "from acts a join p on a.symbol = p.symbol and a.date = p.date)",
    "from acts a join p on a.symbol = p.symbol and a.date = p.date\n"
    f"  where a.model = '{M.BUY_AND_HOLD}' or dayofweek(a.date) = 1)").replace(
    "n AS (select symbol, model, count(*) as n_price from rw group by 1, 2)",
    "n AS (select rw.symbol, model, max(d.n) as n_price from rw\n"
    "  join (select symbol, count(*) as n from prices group by 1) d on d.symbol = rw.symbol group by 1, 2)")


@register("backtest_report_mondays", _MONDAYS_SQL)
def q_backtest_report_mondays(spark, sf_dir):
    """P8 with models that act on Mondays only: the Sharpe divisor stays the number of prices."""
    t = Tables(spark, sf_dir)
    mondays = t.actions.where(F.dayofweek("date") == 2)
    return M.report_rounded(M.backtest_report(t.prices, mondays))


_POSITIONAL_SQL = _MONDAYS_SQL.replace(_P_NEXT, """p AS (
  select symbol, date, price, lead(price) over (partition by symbol order by date) as next_price,
         row_number() over (partition by symbol order by date) as pos from prices)""").replace(_ACTS_BH, _ACTS_BH + """,
placed AS (select *, row_number() over (partition by symbol, model order by date) as pos from acts
           where model = 'Buy & Hold' or dayofweek(date) = 1)""").replace(
    "select a.symbol, a.model, a.date, a.direction,", "select a.symbol, a.model, p.date, a.direction,").replace(
    "from acts a join p on a.symbol = p.symbol and a.date = p.date",
    "from placed a join p on a.symbol = p.symbol and a.pos = p.pos").replace(
    f"  where a.model = '{M.BUY_AND_HOLD}' or dayofweek(a.date) = 1)", ")")


@register("backtest_report_positional", _POSITIONAL_SQL)
def q_backtest_report_positional(spark, sf_dir):
    """P8 as the reference pairs its lists (C7): the i-th Monday action earns the i-th price's return."""
    t = Tables(spark, sf_dir)
    mondays = t.actions.where(F.dayofweek("date") == 2)
    return M.report_rounded(M.backtest_report(t.prices, mondays, positional=True))


CUMULATIVE_SQL = with_(PRICES, ACTIONS, _ACTS_BH, _P_NEXT, _RW) + """
select symbol, model, date,
       round(sum(coalesce(prev_r, 0.0)) over (partition by symbol, model order by date
             rows between unbounded preceding and current row), 6) as cum_reward
from (select *, lag(reward) over (partition by symbol, model order by date) as prev_r from rw)
"""


@register("cumulative_returns", CUMULATIVE_SQL)
def q_cumulative_returns(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rw = M.daily_rewards(t.prices, M.with_buy_and_hold(t.prices, t.actions))
    cr = M.cumulative_rewards(rw, leading_zero=True)
    return cr.select("symbol", "model", "date", r6("cum_reward").alias("cum_reward"))


WILCOXON_SQL = with_(PRICES, ACTIONS, _P_NEXT, """acts AS (select model, symbol, date, direction from actions)""",
                     _RW, """cr AS (
  select symbol, model, date,
         round(sum(reward) over (partition by symbol, model order by date
               rows between unbounded preceding and current row), 9) as cum_reward
  from rw where reward is not null)""", """pr AS (
  select a.symbol, a.model as model_a, b.model as model_b, a.cum_reward - b.cum_reward as d
  from cr a join cr b on a.symbol = b.symbol and a.date = b.date and a.model < b.model)""", """nz AS (
  select *, abs(d) as ad from pr where d <> 0)""", """rk AS (
  select *, rank() over (partition by symbol, model_a, model_b order by ad)
            + (count(*) over (partition by symbol, model_a, model_b, ad) - 1) / 2.0 as avg_rank
  from nz)""", """agg AS (
  select symbol, model_a, model_b, count(*) as n,
         sum(case when d > 0 then avg_rank else 0.0 end) as w_plus,
         sum(case when d < 0 then avg_rank else 0.0 end) as w_minus
  from rk group by 1, 2, 3)""", """ties AS (
  select symbol, model_a, model_b, sum(t*t*t - t) as tie_term
  from (select symbol, model_a, model_b, ad, count(*) as t from rk group by 1, 2, 3, 4) group by 1, 2, 3)""") + """
select a.symbol, a.model_a, a.model_b, a.n, round(a.w_plus, 6) as w_plus, round(a.w_minus, 6) as w_minus,
       round(least(a.w_plus, a.w_minus), 6) as stat,
       round((least(a.w_plus, a.w_minus) - a.n * (a.n + 1) / 4.0)
             / sqrt(a.n * (a.n + 1) * (2 * a.n + 1) / 24.0 - t.tie_term / 48.0), 6) as z
from agg a join ties t on a.symbol = t.symbol and a.model_a = t.model_a and a.model_b = t.model_b
"""


@register("wilcoxon_stat", WILCOXON_SQL)
def q_wilcoxon(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rw = M.daily_rewards(t.prices, t.actions)
    cr = M.cumulative_rewards(rw, leading_zero=False)
    w = M.wilcoxon_stat(M.model_pairs(cr))
    return w.select("symbol", "model_a", "model_b", "n", r6("w_plus").alias("w_plus"),
                    r6("w_minus").alias("w_minus"), r6("stat").alias("stat"), r6("z").alias("z"))


@register("price_range", with_(PRICES) + """
select symbol, round(max(price) - min(price), 6) as price_range from prices group by 1""")
def q_price_range(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return M.price_range(t.prices).select("symbol", r6("price_range").alias("price_range"))


@register("pct_change_std", with_(PRICES, _P_NEXT) + """
select symbol, round(stddev_samp(case when price <> 0 then (next_price - price) / price end), 6) as pct_change_std
from p group by 1""")
def q_pct_change_std(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return M.pct_change_std(t.prices).select("symbol", r6("pct_change_std").alias("pct_change_std"))


# two-sided p: exact (counts of rank subsets by their sum) up to 50 differences without ties, else the normal tail as
# 1 - erf, erf by its series of positive terms
_PVALUE_SQL = WILCOXON_SQL.replace("WITH ", "WITH RECURSIVE ", 1).rsplit("\nselect a.symbol", 1)[0] + """
, subsets AS (
  select 0 as k, list_transform(range(1276), lambda s: case when s = 0 then 1.0::double else 0.0::double end) as c
  union all
  select k + 1, list_transform(range(1276), lambda s: c[s + 1] + case when s > k then c[s - k] else 0.0::double end)
  from subsets where k < 50)
, w AS (select a.symbol, a.model_a, a.model_b, a.n, least(a.w_plus, a.w_minus) as stat, t.tie_term,
               (least(a.w_plus, a.w_minus) - a.n * (a.n + 1) / 4.0)
               / sqrt(a.n * (a.n + 1) * (2 * a.n + 1) / 24.0 - t.tie_term / 48.0) as z
        from agg a join ties t on a.symbol = t.symbol and a.model_a = t.model_a and a.model_b = t.model_b)
, ez AS (select *, abs(z) / sqrt(2.0) as x from w)
, pv AS (select ez.*, case when x = 0 then 0.0 else 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 400),
          lambda i: exp(2 * i * ln(2.0) + (2 * i + 1) * ln(x) - lgamma(2.0 * i + 2) + lgamma(i + 1.0)))) end as erf from ez)
select pv.symbol, model_a, model_b, n, round(stat, 6) as stat, round(z, 6) as z,
       round(case when n <= 50 and tie_term = 0
                  then least(1.0, 2 * list_sum(s.c[1:cast(floor(stat) as int) + 1]) / power(2.0, n))
                  else 1 - erf end, 6) as p_value
from pv left join subsets s on s.k = pv.n"""


@register("wilcoxon_pvalue", _PVALUE_SQL)
def q_wilcoxon_pvalue(spark, sf_dir):
    """P10: the significance report with p-values."""
    t = Tables(spark, sf_dir)
    rw = M.daily_rewards(t.prices, t.actions)
    cr = M.cumulative_rewards(rw, leading_zero=False)
    w = M.with_pvalue(M.wilcoxon_stat(M.model_pairs(cr)))
    return w.select("symbol", "model_a", "model_b", "n", r6("stat").alias("stat"), r6("z").alias("z"),
                    r6("p_value").alias("p_value"))


@register("price_summary", with_(PRICES) + """
select symbol, count(price) as count, round(avg(price), 6) as mean, round(stddev_samp(price), 6) as std,
       round(min(price), 6) as min, round(quantile_cont(price, 0.25), 6) as q25,
       round(quantile_cont(price, 0.5), 6) as q50, round(quantile_cont(price, 0.75), 6) as q75,
       round(max(price), 6) as max
from prices group by 1""")
def q_price_summary(spark, sf_dir):
    """The summary of every price series with exact quartiles."""
    s = M.price_summary(Tables(spark, sf_dir).prices)
    return s.select("symbol", "count", *[r6(c).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


_METRICS = (("Cumulative Return", "cum_return"), ("Sharpe Ratio", "sharpe"), ("Standard Deviation", "std_dev"),
            ("Annualized Volatility", "ann_vol"), ("Max Drawdown", "max_drawdown"))
REPORT_MATRIX_SQL = ("WITH rep AS (" + BACKTEST_SQL + "), long AS (" + " union all ".join(
    f"select symbol, model, '{m}' as metric, {c} as value from rep" for m, c in _METRICS) + ")\nselect symbol, metric, " +
    ", ".join(f"max(value) filter (where model = '{m}') as \"{m}\"" for m in ("Buy & Hold", "m0", "m1", "m2")) +
    " from long group by 1, 2")


@register("report_matrix", REPORT_MATRIX_SQL)
def q_report_matrix(spark, sf_dir):
    """Metric rows x model columns per symbol (pivot of the long report)."""
    t = Tables(spark, sf_dir)
    long = M.report_matrix(M.report_rounded(M.backtest_report(t.prices, t.actions)))
    return long.groupBy("symbol", "metric").pivot("model", ["Buy & Hold", "m0", "m1", "m2"]).agg(F.first("value"))
