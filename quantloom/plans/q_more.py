"""Registered queries: landed JSON pages, positional pairing, request grids, summaries and ranges
(A7, A9, B2, B4, B11, C7, C11, C13, D5, D17, G1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.numeric import r6
from quantloom.operators import environment as V
from quantloom.operators import filings as FL
from quantloom.operators import memory as MM
from quantloom.operators import metrics as M
from quantloom.operators import textops as X
from quantloom.plans.fixtures_sql import ACTIONS, CITATIONS, FILINGS, MEMORIES, PRICES, RAW_NEWS, with_
from quantloom.plans.registry import register
from quantloom.sources.tables import (Tables, derive_actions, derive_citations, derive_filings,
                                      derive_memories, derive_raw_news)


def _news_pages(spark, sf_dir):
    """One landed API page per news item, in the provider's JSON shape."""
    n = derive_raw_news(Tables(spark, sf_dir))
    item = F.struct(F.col("item_id").alias("id"), F.lit(None).cast("string").alias("author"),
                    F.col("body").alias("content"),
                    F.concat(F.date_format("dates", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("created_at"),
                    F.lit("wire").alias("source"), F.col("headline").alias("summary"),
                    F.col("headline").alias("headline"),
                    F.concat(F.lit("https://news.example/"), F.col("item_id").cast("string")).alias("url"),
                    F.array(F.col("symbol")).alias("symbols"))
    return n.select("item_id", F.to_json(F.struct(F.array(item).alias("news"),
                                                  F.lit(None).cast("string").alias("next_page_token")))
                    .alias("payload"))


@register("landed_news_pages", with_(RAW_NEWS) + """
select null::varchar as author, body as content, dates as datetime, 'wire' as source, headline as summary,
       headline as title, 'https://news.example/' || cast(item_id as varchar) as url,
       cast(dates as date) as date, symbol as equity
from raw_news""")
def q_landed_news_pages(spark, sf_dir):
    """News API pages (JSON) flattened into one row per item, ISO time without the 'Z'."""
    return X.flatten_news_pages(_news_pages(spark, sf_dir))


@register("filing_index_pick", with_(FILINGS) + """
select symbol as ticker, cast(seq as varchar) as cik, form as type, strftime(date, '%Y-%m-%d') as filed_at,
       'https://filings.example/' || cast(seq as varchar) || '/main' as document_url
from filings""")
def q_filing_index_pick(spark, sf_dir):
    """Landed filing-index pages; the first document whose type equals the form is kept."""
    f = derive_filings(Tables(spark, sf_dir))
    url = F.concat(F.lit("https://filings.example/"), F.col("seq").cast("string"))
    docs = F.array(
        F.struct(F.lit("EX-99").alias("type"), F.concat(url, F.lit("/exhibit")).alias("documentUrl")),
        F.struct(F.col("form").alias("type"), F.concat(url, F.lit("/main")).alias("documentUrl")),
        F.struct(F.col("form").alias("type"), F.concat(url, F.lit("/copy")).alias("documentUrl")))
    filing = F.struct(F.col("symbol").alias("ticker"), F.col("seq").cast("string").alias("cik"),
                      F.col("form").alias("formType"), F.date_format("date", "yyyy-MM-dd").alias("filedAt"),
                      docs.alias("documentFormatFiles"))
    pages = f.select(F.to_json(F.struct(F.array(filing).alias("filings"))).alias("payload"))
    return X.pick_filing_documents(pages)


@register("positional_pairs", with_(PRICES, ACTIONS) + """
, p AS (select symbol, date, price, row_number() over (partition by symbol order by date) as pos from prices)
, a AS (select model, symbol, date as action_date, direction,
               row_number() over (partition by symbol, model order by date) as pos
        from actions where isodow(date) = 1)
select a.model, a.symbol, a.pos, a.action_date, p.date, round(p.price, 6) as price, a.direction
from a join p on a.symbol = p.symbol and a.pos = p.pos""")
def q_positional_pairs(spark, sf_dir):
    """The i-th action of the weekly (Monday) series paired with the i-th price, as the reference pairs lists."""
    t = Tables(spark, sf_dir)
    acts = t.actions.where(F.dayofweek("date") == 2)
    j = M.positional_pairs(t.prices, acts)
    return j.select("model", "symbol", F.col("pos").cast("long").alias("pos"), "action_date", "date",
                    r6("price").alias("price"), "direction")


@register("backtest_window", with_(PRICES, ACTIONS) + """
, p AS (select * from prices where date >= date '1996-01-01' and date < date '1997-01-01')
, a AS (select * from actions where date >= date '1996-01-01' and date < date '1997-01-01')
, pn AS (select *, lead(price) over (partition by symbol order by date) as next_price from p)
select a.model, a.symbol, count(*) as n_price,
       round(sum(a.direction * ln(pn.next_price / pn.price)), 6) as cum_return
from a join pn on a.symbol = pn.symbol and a.date = pn.date group by 1, 2""")
def q_backtest_window(spark, sf_dir):
    """B2: a half-open test window [start, end) on both prices and actions, then the return."""
    t = Tables(spark, sf_dir)
    p = t.prices_between("1996-01-01", "1997-01-01")
    a = M.restrict_dates(derive_actions(p), "1996-01-01", "1997-01-01")
    rw = M.daily_rewards(p, a)
    return rw.groupBy("model", "symbol").agg(F.count(F.lit(1)).alias("n_price"),
                                             r6(F.sum("reward")).alias("cum_return"))


@register("request_grid", with_(RAW_NEWS) + """
select distinct cast(dates as date) as date, symbol from raw_news""")
def q_request_grid(spark, sf_dir):
    """The distinct (date, symbol) request grid of the news table."""
    n = derive_raw_news(Tables(spark, sf_dir))
    return n.select(F.to_date("dates").alias("date"), "symbol").distinct()


@register("unique_documents", with_(FILINGS) + """
select url as document_url, min(seq) as seq from (
  select 'doc/' || cast(seq % 500 as varchar) as url, seq from filings) group by 1""")
def q_unique_documents(spark, sf_dir):
    """One row per document url (the earliest), urls repeating across the index."""
    f = derive_filings(Tables(spark, sf_dir)).select(
        F.concat(F.lit("doc/"), (F.col("seq") % 500).cast("string")).alias("document_url"), "seq")
    return FL.unique_documents(f, "document_url", "seq").select("document_url", "seq")


@register("news_nonblank", with_(RAW_NEWS) + """
select symbol, cast(dates as date) as date,
       len(list_filter(list(headline order by item_id), lambda x: trim(x) <> '')) as n_items
from raw_news group by 1, 2""")
def q_news_nonblank(spark, sf_dir):
    """Per (symbol, day) number of non-blank news items, counted without building the lists."""
    n = derive_raw_news(Tables(spark, sf_dir))
    g = n.groupBy("symbol", F.to_date("dates").alias("date")).agg(
        F.count(F.when(V.non_blank(F.col("headline")), 1)).alias("n_items"))
    return g.select("symbol", "date", "n_items")


@register("removed_ids_ignored", with_(MEMORIES, CITATIONS) + """
, removed AS (select symbol, id from memories where importance < 50)
, c AS (select distinct symbol, date, cited_id, feedback from citations)
select c.symbol, c.date, c.cited_id, m.layer from c
join memories m on c.symbol = m.symbol and c.cited_id = m.id
where not exists (select 1 from removed r where r.symbol = c.symbol and r.id = c.cited_id)""")
def q_removed_ids_ignored(spark, sf_dir):
    """Feedback routing with an id-removal list applied as an anti-join."""
    t = Tables(spark, sf_dir)
    mem = derive_memories(t)
    removed = mem.where(F.col("importance") < 50).select("symbol", "id")
    r = MM.route_feedback(mem, derive_citations(t), removed)
    return r.select("symbol", "date", "cited_id", "layer")


@register("column_summary")
def q_column_summary(spark, sf_dir):
    """Count / mean / stddev / min / quartiles / max of the price table (rows-only)."""
    return Tables(spark, sf_dir).prices.select("price").summary()


@register("filings_union", with_(FILINGS) + """
select symbol, date, form, seq from filings where form = '10-K'
union all select symbol, date, form, seq from filings where form in ('10-Q', '20-F')""")
def q_filings_union(spark, sf_dir):
    """G1: per-form frames concatenated by name."""
    f = derive_filings(Tables(spark, sf_dir)).select("symbol", "date", "form", "seq")
    return FL.union_forms(f.where(F.col("form") == "10-K"), f.where(F.col("form").isin("10-Q", "20-F")))


def _nested_sql() -> str:
    from quantloom.plans.q_env import _BASE, _FIL_DAY, _NEWS_DAY

    def shown(value):
        return (f"coalesce(string_agg(p.symbol || '=' || {value}, chr(10) order by p.symbol) "
                f"filter (where {value} is not null), '')")
    return _BASE + ", " + _NEWS_DAY + ", " + _FIL_DAY + f"""
select p.date, {shown("cast(cast(round(p.price, 2) as double) as varchar)")} as price,
       {shown("fd.filing_k")} as filing_k, {shown("fd.filing_q")} as filing_q,
       string_agg(p.symbol || '=' || coalesce(nd.news_text, ''), chr(10) order by p.symbol) as news
from ticks p left join nd on p.symbol = nd.symbol and p.date = nd.date
             left join fd on p.symbol = fd.symbol and p.date = fd.date
group by 1"""


@register("env_nested_view", _nested_sql())
def q_env_nested_view(spark, sf_dir):
    """Per-date maps keyed by symbol (price, filings, news texts), shown as 'symbol=value' lines."""
    from quantloom.plans.q_env import SEP, _inputs
    prices, items, filings = _inputs(spark, sf_dir)
    nested = V.to_nested(V.env_aligned(prices, items, filings))

    def shown(c, value):
        lines = F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), value(e["value"])))
        return F.array_join(lines, "\n").alias(c)
    return nested.select("date", shown("price", lambda v: F.round(v, 2).cast("string")), shown("filing_k", lambda v: v),
                         shown("filing_q", lambda v: v), shown("news", lambda v: F.array_join(v, SEP)))
