"""Registered queries: environment assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.numeric import r6
from quantloom.operators import environment as V
from quantloom.plans.fixtures_sql import ENV_NEWS, FILINGS, NEWS_ITEMS, PRICES, RAW_NEWS, TICKS, with_
from quantloom.plans.registry import register
from quantloom.sources.tables import Tables, derive_env_news, derive_filings, derive_ticks

SEP = " || "  # fixed value: separator used when a news list is shown as one string


def _inputs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    prices = derive_ticks(t).select("symbol", "date", "price")
    return prices, V.news_items(derive_env_news(t)), derive_filings(t)


def _flat(env):
    return env.select("symbol", "date", r6("price").alias("price"), "filing_k", "filing_q",
                      F.size(F.coalesce("news", F.array())).alias("n_news"),
                      F.array_join("news", SEP).alias("news_text"))


_BASE = with_(RAW_NEWS, TICKS, ENV_NEWS, NEWS_ITEMS, FILINGS)
_NEWS_DAY = """nd AS (select symbol, date, count(*) as n_news, string_agg(text, ' || ' order by seq) as news_text
                      from news_items group by 1, 2)"""
_FIL_DAY = """fd AS (select symbol, date,
                     arg_max(content, seq) filter (where form = '10-K') as filing_k,
                     arg_max(content, seq) filter (where form in ('10-Q', '20-F')) as filing_q
              from filings group by 1, 2)"""


@register("env_aligned", _BASE + ", " + _NEWS_DAY + ", " + _FIL_DAY + """
select p.symbol, p.date, round(p.price, 6) as price, fd.filing_k, fd.filing_q,
       coalesce(nd.n_news, 0) as n_news, coalesce(nd.news_text, '') as news_text
from ticks p left join nd on p.symbol = nd.symbol and p.date = nd.date
             left join fd on p.symbol = fd.symbol and p.date = fd.date""")
def q_env_aligned(spark, sf_dir):
    prices, items, filings = _inputs(spark, sf_dir)
    return _flat(V.env_aligned(prices, items, filings)).withColumn("n_news", F.col("n_news").cast("long"))


@register("env_outer", _BASE + ", " + _NEWS_DAY + ", " + _FIL_DAY + """
, keys AS (select symbol, date from ticks union select symbol, date from filings union select symbol, date from news_items)
select k.symbol, k.date, round(p.price, 6) as price, fd.filing_k, fd.filing_q,
       coalesce(nd.n_news, 0) as n_news, nd.news_text
from keys k left join ticks p on k.symbol = p.symbol and k.date = p.date
            left join nd on k.symbol = nd.symbol and k.date = nd.date
            left join fd on k.symbol = fd.symbol and k.date = fd.date""")
def q_env_outer(spark, sf_dir):
    prices, items, filings = _inputs(spark, sf_dir)
    return _flat(V.env_outer(prices, items, filings)).withColumn("n_news", F.col("n_news").cast("long"))


@register("news_list_by_day", _BASE + ", " + _NEWS_DAY + """
select symbol, date, n_news, news_text from nd""")
def q_news_list_by_day(spark, sf_dir):
    _, items, _ = _inputs(spark, sf_dir)
    n = V.news_by_day(items)
    return n.select("symbol", "date", F.size("news").cast("long").alias("n_news"),
                    F.array_join("news", SEP).alias("news_text"))


@register("news_list_chunks", _BASE + f"""
, placed AS (select *, row_number() over (partition by symbol, date order by seq, text) - 1 as k from news_items)
select symbol, date, cast(k // 3 as bigint) as chunk_no, count(*) as n_news, string_agg(text, '{SEP}' order by seq, text) as news_text
from placed group by 1, 2, 3""")
def q_news_list_chunks(spark, sf_dir):
    """D1 in lists of at most three texts."""
    _, items, _ = _inputs(spark, sf_dir)
    c = V.news_chunks(items, 3)
    return c.select("symbol", "date", "chunk_no", F.size("news").cast("long").alias("n_news"),
                    F.array_join("news", SEP).alias("news_text"))


@register("filings_last_wins", _BASE + ", " + _FIL_DAY + """
select symbol, date, filing_k, filing_q from fd""")
def q_filings_last_wins(spark, sf_dir):
    _, _, filings = _inputs(spark, sf_dir)
    return V.filings_by_day(filings).select("symbol", "date", "filing_k", "filing_q")


@register("replay_rows", _BASE + ", " + _NEWS_DAY + ", " + _FIL_DAY + """
, e AS (select p.symbol, p.date, p.price, fd.filing_k, fd.filing_q, coalesce(nd.n_news, 0) as n_news,
               coalesce(nd.news_text, '') as news_text
        from ticks p left join nd on p.symbol = nd.symbol and p.date = nd.date
                     left join fd on p.symbol = fd.symbol and p.date = fd.date
        where p.date between date '2024-01-02' and date '2024-01-29')
, r AS (select *, lead(price) over (partition by symbol order by date) - price as record from e)
select symbol, date, round(price, 6) as price, n_news, news_text, round(record, 6) as record,
       lead(record) over (partition by symbol order by date) is null as done, filing_k, filing_q
from r qualify record is not null""")
def q_replay_rows(spark, sf_dir):
    prices, items, filings = _inputs(spark, sf_dir)
    env = V.env_aligned(prices, items, filings)
    r = V.replay_rows(env, "2024-01-02", "2024-01-29", prices)
    return r.select("symbol", "date", r6("price").alias("price"), F.size("news").cast("long").alias("n_news"),
                    F.array_join("news", SEP).alias("news_text"), r6("record").alias("record"), "done",
                    "filing_k", "filing_q")


@register("env_news_entries", _BASE + ", " + _NEWS_DAY + """
select symbol, date, n_news from nd""")
def q_env_news_entries(spark, sf_dir):
    """B16 over every symbol: outer env dates that carry the symbol's news entry."""
    prices, items, filings = _inputs(spark, sf_dir)
    e = V.with_news_entry(V.env_outer(prices, items, filings))
    return e.select("symbol", "date", F.size("news").cast("long").alias("n_news"))


@register("symbols_by_day", with_(PRICES) + """
select date, string_agg(symbol, ',' order by symbol) as symbols, count(*) as n_symbols from prices group by 1""")
def q_symbols_by_day(spark, sf_dir):
    s = V.symbols_by_day(Tables(spark, sf_dir).prices)
    return s.select("date", F.array_join("symbols", ",").alias("symbols"),
                    F.size("symbols").cast("long").alias("n_symbols"))


@register("price_map_by_day", with_(PRICES) + """
select date, string_agg(symbol || '=' || cast(round(price, 2) as varchar), ',' order by symbol) as price_map
from prices group by 1""")
def q_price_map_by_day(spark, sf_dir):
    m = V.price_map_by_day(Tables(spark, sf_dir).prices)
    entries = F.transform(F.map_entries("price"),
                          lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 2).cast("string")))
    return m.select("date", F.array_join(entries, ",").alias("price_map"))


@register("validate_prices", with_(PRICES) + """
select symbol, date, price > 0 as valid from prices""")
def q_validate_prices(spark, sf_dir):
    p = Tables(spark, sf_dir).prices
    ok, bad = V.validate_prices(p)
    return (ok.select("symbol", "date", F.lit(True).alias("valid"))
            .unionByName(bad.select("symbol", "date", F.lit(False).alias("valid"))))
