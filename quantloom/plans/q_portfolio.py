"""Registered queries: portfolio windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.numeric import r6
from quantloom.operators import portfolio as P
from quantloom.plans.fixtures_sql import ACTIONS, PRICES, TICKS, with_
from quantloom.plans.registry import register
from quantloom.sources.tables import Tables, derive_ticks


@register("next_day_record", with_(PRICES) + """
select symbol, date, round(price, 6) as price, round(record, 6) as record from (
  select *, lead(price) over (partition by symbol order by date) - price as record from prices)
where record is not null""")
def q_next_day_record(spark, sf_dir):
    t = Tables(spark, sf_dir)
    r = P.next_day_record(t.prices)
    return r.select("symbol", "date", r6("price").alias("price"), r6("record").alias("record"))


@register("momentum_3", with_(PRICES) + """
select symbol, date,
       case when n > 3 then cast(sign(lag(d, 2) over w + lag(d, 1) over w + d) as int) end as momentum,
       case when n > 3 then lag(date, 2) over w end as momentum_date
from (select symbol, date, price, price - lag(price) over w as d, row_number() over w as n
      from prices window w as (partition by symbol order by date))
window w as (partition by symbol order by date)""")
def q_momentum(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return P.momentum(t.prices).select("symbol", "date", "momentum", "momentum_date")


@register("holdings", with_(PRICES, ACTIONS) + """
select model, symbol, date, direction,
       cast(sum(direction) over (partition by symbol, model order by date
                                 rows between unbounded preceding and current row) as bigint) as shares
from actions""")
def q_holdings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return P.holdings(t.actions).select("model", "symbol", "date", "direction", "shares")


_FEEDBACK_BODY = """
select model, symbol, date,
       case when n > 7 then cast(sign(lag(x, 6) over w + lag(x, 5) over w + lag(x, 4) over w + lag(x, 3) over w
                                      + lag(x, 2) over w + lag(x, 1) over w + x) as int) end as feedback,
       case when n > 7 then lag(date, 6) over w end as feedback_date
from (select *, (price - lag(price) over w) * lag(shares) over w as x, row_number() over w as n
      from (select a.model, a.symbol, a.date, a.direction, p.price,
                   sum(a.direction) over (partition by a.symbol, a.model order by a.date
                                          rows between unbounded preceding and current row) as shares
            from actions a join prices p on a.symbol = p.symbol and a.date = p.date)
      window w as (partition by symbol, model order by date))
window w as (partition by symbol, model order by date)"""


@register("feedback_7", with_(PRICES, ACTIONS) + _FEEDBACK_BODY)
def q_feedback(spark, sf_dir):
    t = Tables(spark, sf_dir)
    steps = t.actions.join(t.prices, ["symbol", "date"])
    return P.feedback(steps).select("model", "symbol", "date", "feedback", "feedback_date")


@register("monday_steps", with_(PRICES) + """
select symbol, date, round(record, 6) as record,
       case when record > 0 then 1 else -1 end as train_direction,
       (record is not null and record <> 0) as reflect
from (select *, lead(price) over (partition by symbol order by date) - price as record from prices)
where record is not null and isodow(date) = 1""")
def q_monday_steps(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m = P.monday_steps(t.prices)
    return m.select("symbol", "date", r6("record").alias("record"), "train_direction", "reflect")


@register("tick_momentum", with_(TICKS) + """
select symbol, date, n_ticks,
       case when n > 3 then cast(sign(lag(d, 2) over w + lag(d, 1) over w + d) as int) end as momentum
from (select symbol, date, price, n_ticks, price - lag(price) over w as d, row_number() over w as n
      from ticks window w as (partition by symbol order by date))
window w as (partition by symbol order by date)""")
def q_tick_momentum(spark, sf_dir):
    """E7 over the dense daily series derived from ``events`` (many short series)."""
    ticks = derive_ticks(Tables(spark, sf_dir))
    return P.momentum(ticks).select("symbol", "date", "n_ticks", "momentum")
