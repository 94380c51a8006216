"""Registered queries: scans, sinks, checkpoints and filing tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quantloom.operators import environment as V
from quantloom.operators import filings as FL
from quantloom.operators import memory as MM
from quantloom.operators import news as N
from quantloom.operators import retrieval as R
from quantloom.plans.fixtures_sql import FILINGS, MEMORIES, PRICES, RAW_NEWS, with_
from quantloom.plans.q_news import _DEDUP_SQL
from quantloom.plans.registry import register
from quantloom.session import scratch_path
from quantloom.sources import io as IO
from quantloom.sources.tables import Tables, derive_filings, derive_memories, derive_raw_news


def _fresh(spark, name):
    return scratch_path(spark, f"io/{name}_{uuid.uuid4().hex[:12]}")


@register("csv_roundtrip", with_(RAW_NEWS) + """
select item_id, symbol, dates, headline, body, item_language from raw_news""")
def q_csv_roundtrip(spark, sf_dir):
    """A11 then A1: news with multi-line, quoted bodies written as CSV and read back by schema."""
    path = _fresh(spark, "news_csv")
    IO.write_csv(derive_raw_news(Tables(spark, sf_dir)), path)
    return IO.read_csv(spark, path, IO.NEWS_CSV_SCHEMA)


@register("parquet_partitioned", with_(PRICES) + """
select symbol, date, price from prices""")
def q_parquet_partitioned(spark, sf_dir):
    """A12 then A2/A3: prices written partitioned by symbol, read back with partition discovery."""
    path = _fresh(spark, "prices_parquet")
    IO.write_parquet(Tables(spark, sf_dir).prices, path, "symbol")
    return IO.read_parquet(spark, path).select("symbol", "date", "price")


@register("price_ingest", """
select cast(o.o_orderdate as timestamp) as est_time, concat('S', cast(c.c_nationkey as varchar)) as equity,
       o.o_totalprice as close
from orders o join customer c on o.o_custkey = c.c_custkey
where o.o_orderdate is not null and o.o_totalprice is not null""")
def q_price_ingest(spark, sf_dir):
    """A5 over raw order prices keyed by nation symbol."""
    t = Tables(spark, sf_dir)
    raw = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderdate", F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("sym"), "o_totalprice")
    return IO.price_ingest(raw, "o_orderdate", "sym", "o_totalprice")


@register("adjusted_close", """
select concat('U', cast(user_id as varchar)) as symbol, cast(ts as date) as date, value as price from events""")
def q_adjusted_close(spark, sf_dir):
    """A6 over the raw event values: (symbol, date, price) of every row."""
    raw = Tables(spark, sf_dir).events.withColumn("sym", F.concat(F.lit("U"), F.col("user_id").cast("string")))
    return IO.adjusted_close(raw, "ts", "value", symbol_col="sym")


_SYMS = [f"S{i}" for i in range(25)]


@register("price_wide", with_(PRICES) + "select date, " + ", ".join(
    f"max(price) filter (where symbol = '{s}') as \"{s}\"" for s in _SYMS) + " from prices group by date")
def q_price_wide(spark, sf_dir):
    """M2: one column per symbol found in the prices."""
    return IO.price_wide(Tables(spark, sf_dir).prices)


@register("state_checkpoint", with_(MEMORIES) + """
select symbol, layer, id, importance, recency, delta, access_counter,
       array_to_string(list_transform(cast(embedding as double[]), lambda x: cast(round(x * 1000000) as bigint)), ',') as vector
from memories""")
def q_state_checkpoint(spark, sf_dir):
    """A16 then A17: an agent state, saved twice, restored from its newest snapshot; vectors in millionths."""
    path = _fresh(spark, "memory_state")
    mem = derive_memories(Tables(spark, sf_dir)).drop("seq")
    IO.save_agent_state(path, mem.where("id % 2 = 0"), MM.params_df(spark))
    IO.save_agent_state(path, mem, MM.params_df(spark), force=True)
    back = IO.load_agent_state(spark, path)["memory"]
    millionths = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string"))
    return back.select("symbol", "layer", "id", "importance", "recency", "delta", "access_counter",
                       F.array_join(millionths, ",").alias("vector"))


@register("clean_counts", _DEDUP_SQL + """
select r.symbol, r.n_before, coalesce(a.n_after, 0) as n_after
from (select symbol, count(*) as n_before from raw_news group by 1) r
left join (select symbol, count(*) as n_after from s5 group by 1) a on a.symbol = r.symbol""")
def q_clean_counts(spark, sf_dir):
    """Rows per symbol before and after the dedup chain."""
    raw = derive_raw_news(Tables(spark, sf_dir))
    after = N.dedup_updates(N.tag_updates(raw))
    b = N.count_by_symbol(raw, name="n_before")
    a = N.count_by_symbol(after, name="n_after")
    return b.join(a, "symbol", "left").select("symbol", "n_before", F.coalesce("n_after", F.lit(0)).alias("n_after"))


@register("filing_sections", with_(FILINGS) + """
, sec AS (select * from (values ('10-K', '7'), ('10-Q', 'part1item2')) t(form, section))
select f.symbol, f.date, f.form, s.section, f.seq
from filings f join sec s on s.form = f.form""")
def q_filing_sections(spark, sf_dir):
    """Every filing paired with the sections of its form (a fixed list per form, exploded)."""
    return FL.with_sections(derive_filings(Tables(spark, sf_dir))).select("symbol", "date", "form", "section", "seq")


@register("filing_table", with_(FILINGS) + """
, idx AS (select 'doc/' || cast(seq as varchar) as document_url, symbol as ticker, form as type, date from filings)
, content AS (select 'doc/' || cast(seq as varchar) as document_url,
                   case when seq % 7 = 0 then null else content end as content from filings)
select i.document_url, i.ticker, i.type, i.date, c.content
from idx i join content c on i.document_url = c.document_url
where i.ticker is not null and i.type is not null and i.date is not null and c.content is not null""")
def q_filing_table(spark, sf_dir):
    """Index (C2) joined to fetched contents on the document url, rows with any NULL dropped.

    The content of every seventh document comes back NULL, as a failed download does.
    """
    f = derive_filings(Tables(spark, sf_dir))
    idx = f.select(F.concat(F.lit("doc/"), F.col("seq").cast("string")).alias("document_url"),
                   F.col("symbol").alias("ticker"), F.col("form").alias("type"), "date")
    content = f.select(F.concat(F.lit("doc/"), F.col("seq").cast("string")).alias("document_url"),
                       F.when(F.col("seq") % 7 != 0, F.col("content")).alias("content"))
    return FL.filing_table(idx, content)


@register("filing_content_by_form", with_(FILINGS) + """
select symbol, date, form, content from (
  select symbol, date, form,
         case form when '10-K' then management_discussion when '10-Q' then mda when '20-F' then item_5 end as content
  from (select *, case when form = '10-K' then content end as management_discussion,
               case when form = '10-Q' then content end as mda,
               case when form = '20-F' then content end as item_5 from filings))
where content is not null and content <> ''""")
def q_filing_content_by_form(spark, sf_dir):
    """Content chosen by form from the extracted sections; empty ones skipped."""
    f = derive_filings(Tables(spark, sf_dir))
    wide = f.select("symbol", "date", "form",
                    F.when(F.col("form") == "10-K", F.col("content")).alias("management_discussion"),
                    F.when(F.col("form") == "10-Q", F.col("content")).alias("mda"),
                    F.when(F.col("form") == "20-F", F.col("content")).alias("item_5"))
    return FL.content_by_form(wide).select("symbol", "date", "form", "content")


def _env_sink_sql() -> str:
    from quantloom.plans.q_env import _BASE, _FIL_DAY, _NEWS_DAY
    return _BASE + ", " + _NEWS_DAY + ", " + _FIL_DAY + """
select p.symbol, p.date, round(p.price, 6) as price, fd.filing_k, fd.filing_q,
       coalesce(nd.n_news, 0) as n_news, replace(replace(p.symbol, '/', '_'), '.', '_') as ticker_file
from ticks p left join nd on p.symbol = nd.symbol and p.date = nd.date
             left join fd on p.symbol = fd.symbol and p.date = fd.date"""


@register("env_sink_roundtrip", _env_sink_sql())
def q_env_sink_roundtrip(spark, sf_dir):
    """Aligned environment written per file-safe ticker folder (H21) and read back."""
    from quantloom.plans.q_env import _inputs
    prices, items, filings = _inputs(spark, sf_dir)
    path = _fresh(spark, "env")
    IO.write_env(V.env_aligned(prices, items, filings), path)
    back = IO.read_parquet(spark, path)
    return back.select("symbol", "date", F.round("price", 6).alias("price"), "filing_k", "filing_q",
                       F.size("news").cast("long").alias("n_news"), F.col("ticker_file").cast("string"))


@register("memory_view_ordered", with_(MEMORIES) + """
select symbol, layer, id, round(recency + least(importance, 100.0) / 100.0, 6) as compound,
       row_number() over (partition by symbol, layer order by recency + least(importance, 100.0) / 100.0, seq) as rank
from memories""")
def q_memory_view_ordered(spark, sf_dir):
    """the score-ordered memory view as a rank within (symbol, layer)."""
    mem = MM.with_compound(derive_memories(Tables(spark, sf_dir)).drop("embedding"))
    return R.score_ranks(mem).select("symbol", "layer", "id", F.round("compound", 6).alias("compound"), "rank")
