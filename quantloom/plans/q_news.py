"""Registered queries: news extraction, cleaning and calendar alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import text as T
from quantloom.functions import timefns as TF
from quantloom.operators import calendar as C
from quantloom.operators import news as N
from quantloom.operators.ordered import previous_in_order
from quantloom.plans.fixtures_sql import (CALENDAR_TICKS, PRICES, RAW_NEWS, SUBJECTS, TICKER_MAP,
                                          with_)
from quantloom.plans.registry import register
from quantloom.sources.tables import (Tables, derive_raw_news, derive_subjects, derive_ticker_map,
                                      derive_ticks)
from quantloom.operators.calendar import trading_calendar

_UPD = r"coalesce(try_cast(nullif(regexp_extract(headline, '^UPDATE (\d+)', 1), '') as int), 0)"
_NEWH = r"regexp_replace(headline, 'UPDATE \d+-', '', 'g')"


def _news(spark, sf_dir):
    return derive_raw_news(Tables(spark, sf_dir))


def _calendar(spark, sf_dir):
    return trading_calendar(derive_ticks(Tables(spark, sf_dir)))


@register("update_number", with_(RAW_NEWS) + f"""
select item_id, symbol, {_UPD} as update_number from raw_news""")
def q_update_number(spark, sf_dir):
    n = _news(spark, sf_dir)
    return n.select("item_id", "symbol", T.update_number("headline").alias("update_number"))


@register("headline_normalize", with_(RAW_NEWS) + rf"""
select item_id, {_NEWH} as new_headline, regexp_replace(headline, '^\d+', '') as normalized_headline
from raw_news""")
def q_headline_normalize(spark, sf_dir):
    n = _news(spark, sf_dir)
    return n.select("item_id", T.strip_update_tags("headline").alias("new_headline"),
                    T.strip_leading_digits("headline").alias("normalized_headline"))


@register("trim_wire_marker", with_(RAW_NEWS) + """
select item_id, case when instr(body, '(Reuters)') > 0 then substring(body, instr(body, '(Reuters)'))
                     else body end as body
from raw_news""")
def q_trim_wire_marker(spark, sf_dir):
    n = _news(spark, sf_dir)
    return n.select("item_id", T.from_wire_marker("body").alias("body"))


@register("after_close_date", with_(RAW_NEWS) + """
select item_id, dates, case when hour(dates) >= 16 then cast(dates as date) + 1 else cast(dates as date) end as date
from raw_news""")
def q_after_close_date(spark, sf_dir):
    n = _news(spark, sf_dir)
    return n.select("item_id", "dates", TF.after_close_date("dates").alias("date"))


@register("round_next_day", with_(RAW_NEWS) + """
select item_id, make_timestamp(year(d), month(d), day(d), 9, 0, 0) as published
from (select item_id, case when hour(dates) >= 16 and (minute(dates) > 0 or second(dates) > 0)
                           then cast(dates as date) + 1 else cast(dates as date) end as d
      from raw_news)""")
def q_round_next_day(spark, sf_dir):
    n = _news(spark, sf_dir)
    return n.select("item_id", TF.round_next_day("dates").alias("published"))


@register("utc_to_eastern", with_(RAW_NEWS) + """
select item_id, timezone('America/New_York', timezone('UTC', dates)) as est_time from raw_news""")
def q_utc_to_eastern(spark, sf_dir):
    n = _news(spark, sf_dir)
    return n.select("item_id", TF.utc_to_eastern("dates").alias("est_time"))


def _clean_sql(col: str) -> str:
    # the patterns written out once more: the oracle takes nothing from the operator it checks
    t = f"lower(coalesce({col}, ''))"
    t = rf"regexp_replace({t}, '(?i)\b(?:https?://|ftp://|www\.)[^\s<>\"]+', '<url>', 'g')"
    t = rf"regexp_replace({t}, '(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{{2,}}\b', '<email>', 'g')"
    t = rf"regexp_replace({t}, '(?:\+?\d{{1,3}}[ .-]?)?(?:\(\d{{3}}\)|\d{{3}})[ .-]?\d{{3}}[ .-]?\d{{4}}\b', '<phone>', 'g')"
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


@register("clean_text_regex", with_(RAW_NEWS) + f"""
select item_id, {_clean_sql('body')} as cleaned_body from raw_news""")
def q_clean_text_regex(spark, sf_dir):
    n = _news(spark, sf_dir)
    return n.select("item_id", T.clean_text_regex("body").alias("cleaned_body"))


_CURLY = "'\u2019' || coalesce(body, '') || ' \u201cGr\u00f6\u00dfe\u201d \u2013 ' || coalesce(headline, '')"


@register("clean_text_full", with_(RAW_NEWS) + f"""
, quoted AS (select item_id, replace(replace(replace({_CURLY}, '\u2019', chr(39)), '\u201c', '"'), '\u201d', '"') as t
             from raw_news)
, folded AS (select item_id, regexp_replace(strip_accents(t), '[^\\x00-\\x7F]', '', 'g') as t from quoted)
select item_id, {_clean_sql('t')} as cleaned_body from folded""")
def q_clean_text_full(spark, sf_dir):
    """H6 with quote repair and folding, on bodies and headlines around typographic quotes, accents and a dash."""
    n = _news(spark, sf_dir)
    none = F.lit("")
    text = F.concat(F.lit("\u2019"), F.coalesce("body", none), F.lit(" \u201cGr\u00f6\u00dfe\u201d \u2013 "),
                    F.coalesce("headline", none))
    return n.select("item_id", T.clean_text(text).alias("cleaned_body"))


_DEDUP_SQL = with_(RAW_NEWS) + rf"""
, s1 AS (select *, {_UPD} as update_number, {_NEWH} as new_headline from raw_news)
, s2 AS (select * exclude (rn) from (select *, row_number() over (partition by symbol, new_headline
            order by update_number desc, dates desc, item_id) as rn from s1) where rn = 1)
, s3 AS (select * replace (case when instr(body, '(Reuters)') > 0 then substring(body, instr(body, '(Reuters)'))
                                else body end as body) from s2)
, s4 AS (select * exclude (rn) from (select *, row_number() over (partition by symbol, replace(body, ' ', '')
            order by dates desc, item_id) as rn from s3) where rn = 1)
, s5 AS (select * exclude (rn) from (select *, row_number() over (partition by symbol, replace(new_headline, ' ', '')
            order by dates desc, item_id) as rn from s4) where rn = 1)
"""


@register("dedup_keep_first", _DEDUP_SQL + """
select item_id, symbol, update_number, new_headline from s5""")
def q_dedup_keep_first(spark, sf_dir):
    d = N.dedup_updates(N.tag_updates(_news(spark, sf_dir)))
    return d.select("item_id", "symbol", "update_number", "new_headline")


# quotes straightened, accents off, other non-ASCII characters dropped
_FOLDED = ("regexp_replace(strip_accents(replace(replace(replace(replace(body, '\u2018', chr(39)), '\u2019', chr(39)), "
           "'\u201c', '\"'), '\u201d', '\"')), '[^\\x00-\\x7F]', '', 'g')")


@register("news_clean_pre_similarity", _DEDUP_SQL + f"""
, s6 AS (select *, case when hour(dates) >= 16 then cast(dates as date) + 1 else cast(dates as date) end as date,
                {_clean_sql(_FOLDED)} as cleaned_body from s5)
select item_id, symbol, date, new_headline, cleaned_body from (
  select *, row_number() over (partition by symbol, cleaned_body order by dates, item_id) as rn from s6)
where rn = 1""")
def q_news_clean_pre_similarity(spark, sf_dir):
    d = N.clean_bodies(N.dedup_updates(N.tag_updates(_news(spark, sf_dir))))
    return d.select("item_id", "symbol", "date", "new_headline", "cleaned_body")


@register("clean_step_counts", _DEDUP_SQL + f"""
, s6 AS (select distinct symbol, {_clean_sql(_FOLDED)} as cleaned_body from s5)
select 'raw' as step, count(*) as n from raw_news
union all select 'newest_update', count(*) from s2
union all select 'distinct_body', count(*) from s4
union all select 'distinct_headline', count(*) from s5
union all select 'distinct_cleaned_body', count(*) from s6""")
def q_clean_step_counts(spark, sf_dir):
    """Rows after each dedup step of P2, counted by the run itself (``Observation``), without a job of their own."""
    counts = {}
    N.clean_news(_news(spark, sf_dir), counts=counts)
    steps = N.CLEAN_STEPS[:N.CLEAN_STEPS.index("distinct_cleaned_body") + 1]
    return spark.createDataFrame([(s, counts[s].get["n"]) for s in steps], "step string, n long")


@register("news_clean")
def q_news_clean(spark, sf_dir):
    """P2 in full: dedup chain, cleaning, two adjacent-similarity passes, capped calendar roll."""
    clean = N.clean_news(_news(spark, sf_dir))
    return C.next_trading_day_capped(clean, _calendar(spark, sf_dir), "date").select(
        "item_id", "symbol", "date", "trading_day", "headline", "body")


@register("adjacent_prev", with_(RAW_NEWS) + """
select item_id, symbol, lag(headline) over (partition by symbol order by dates, item_id) as prev_headline
from raw_news""")
def q_adjacent_prev(spark, sf_dir):
    n = _news(spark, sf_dir)
    p = previous_in_order(n, ["symbol"], "dates", "item_id", "headline", "prev_headline")
    return p.select("item_id", "symbol", "prev_headline")


_DAY = "case when hour(dates) >= 16 then cast(dates as date) + 1 else cast(dates as date) end"
_NEXT_TD = with_(RAW_NEWS, CALENDAR_TICKS) + f"""
, nd AS (select item_id, symbol, {_DAY} as date from raw_news)
, m AS (select n.date, min(c.date) as td from (select distinct date from nd) n
        left join calendar c on c.date >= n.date group by n.date)
"""


@register("next_trading_day", _NEXT_TD + """
select nd.item_id, nd.symbol, nd.date, m.td as trading_day, m.td is null as beyond_calendar
from nd join m on nd.date = m.date""")
def q_next_trading_day(spark, sf_dir):
    n = _news(spark, sf_dir).select("item_id", "symbol", TF.after_close_date("dates").alias("date"))
    out = C.next_trading_day(n, _calendar(spark, sf_dir), "date")
    return out.select("item_id", "symbol", "date", "trading_day", "beyond_calendar")


@register("next_trading_day_capped", _NEXT_TD + """
select nd.item_id, nd.symbol, nd.date,
       case when m.td is not null and m.td - nd.date <= 10 then m.td else nd.date + 10 end as trading_day
from nd join m on nd.date = m.date""")
def q_next_trading_day_capped(spark, sf_dir):
    n = _news(spark, sf_dir).select("item_id", "symbol", TF.after_close_date("dates").alias("date"))
    out = C.next_trading_day_capped(n, _calendar(spark, sf_dir), "date")
    return out.select("item_id", "symbol", "date", "trading_day")


@register("week_ranges", with_(PRICES) + """
select symbol, cast(ws as date) as week_start, least(cast(ws as date) + 6, e) as week_end
from (select symbol, min(date) as s, max(date) as e from prices group by 1) b,
     unnest(generate_series(b.s, b.e, interval 7 day)) as g(ws)""")
def q_week_ranges(spark, sf_dir):
    p = Tables(spark, sf_dir).prices
    b = p.groupBy("symbol").agg(F.min("date").alias("s"), F.max("date").alias("e"))
    return C.week_blocks(b, "s", "e").select("symbol", "week_start", "week_end")


@register("cap_news_per_day", with_(RAW_NEWS) + """
select item_id, symbol, dates from (
  select *, row_number() over (partition by symbol, cast(dates as date) order by dates, item_id) as rn
  from raw_news) where rn <= 200""")
def q_cap_news_per_day(spark, sf_dir):
    return N.cap_per_day(_news(spark, sf_dir)).select("item_id", "symbol", "dates")


@register("vendor_extract", with_(RAW_NEWS, SUBJECTS, TICKER_MAP) + r"""
, keys AS (select ticker, 'R' as kind, regexp_extract(ric_prefix, '^R:([^.]+)\.', 1) as key from ticker_map
           union select ticker, 'P', perm_id from ticker_map)
, subj AS (select item_id, subject, substring(subject, 1, 1) as kind,
                  case when substring(subject, 1, 1) = 'R' then nullif(regexp_extract(subject, '^R:([^.]+)\.', 1), '')
                       when substring(subject, 1, 1) = 'P' then subject end as key
           from data_subject)
, j AS (select n.item_id, n.dates, s.subject, k.ticker, n.headline, n.body,
               regexp_replace(n.headline, '^\d+', '') as normalized_headline
        from raw_news n join subj s on n.item_id = s.item_id join keys k on s.kind = k.kind and s.key = k.key
        where n.item_language = 'en'
          and n.dates >= timezone('UTC', timezone('America/New_York', timestamp '2023-12-31 00:00:00'))
          and n.dates <= timezone('UTC', timezone('America/New_York', timestamp '2999-12-31 23:59:59')))
select item_id, dates, subject as symbols, ticker, headline from (
  select *, row_number() over (partition by ticker, normalized_headline order by dates desc, item_id) as rn from j)
where rn = 1 and body is not null and length(body) > 300""")
def q_vendor_extract(spark, sf_dir):
    t = Tables(spark, sf_dir)
    items = derive_raw_news(t).withColumnRenamed("dates", "first_created")
    out = N.vendor_extract(items, derive_subjects(t), derive_ticker_map(t),
                           start="2023-12-31 00:00:00", end="2999-12-31 23:59:59", tz="America/New_York")
    return out.select("item_id", "dates", "symbols", "ticker", "headline")
