"""Registered queries: texts to memory records and retrieval over them (I1, K1, F5), the ordered view."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.embed import embed_texts
from quantloom.functions.numeric import r6
from quantloom.functions.vectors import l2_normalize
from quantloom.operators import retrieval as R
from quantloom.operators.intake import add_memory
from quantloom.plans.fixtures_sql import ENV_NEWS, FILINGS, RAW_NEWS, with_
from quantloom.plans.registry import register
from quantloom.session import cut_lineage
from quantloom.sources.tables import Tables, derive_env_news, derive_filings

TOP_K = 3
CHUNK = 256


def news_and_filings(spark, sf_dir):
    """One item per news row (a list: headline, body) and per filing (its content)."""
    t = Tables(spark, sf_dir)
    news = derive_env_news(t).select("symbol", "date", (F.col("seq") * 2).alias("key"), F.lit("news").alias("source_type"),
                                     F.array("headline", "body").alias("text"))
    annual = F.when(F.col("form") == "10-K", "10-K").otherwise("10-Q")
    filings = derive_filings(t).select("symbol", "date", (F.col("seq") * 2 + 1).alias("key"), annual.alias("source_type"),
                                       F.array("content").alias("text"))
    return news.unionByName(filings)


_DRAW = ("cast(cast(concat('0x', substring(md5(concat('42-', cast(id as varchar))), 1, 8)) as bigint) as double)"
         " / 4294967296")

_RECORDS = with_(RAW_NEWS, ENV_NEWS, FILINGS) + rf"""
, items AS (
  select symbol, date, seq * 2 as key, 0 as place, 'short' as layer, headline as text from env_news
  union all select symbol, date, seq * 2, 1, 'short', body from env_news
  union all select symbol, date, seq * 2 + 1, 0, case when form = '10-K' then 'long' else 'mid' end, content from filings)
, numbered AS (select *, row_number() over (order by date, symbol, key, place) - 1 as id from items)
, rec AS (
  select symbol, layer, id, date, 1.0 + imp / 100.0 as compound, imp as importance from (
    select *, case layer when 'short' then (case when u < 0.5 then 50.0 when u < 0.95 then 70.0 else 90.0 end)
                         when 'mid' then (case when u < 0.05 then 40.0 when u < 0.85 then 60.0 else 80.0 end)
                         else (case when u < 0.05 then 40.0 when u < 0.2 then 60.0 else 80.0 end) end as imp
    from (select *, {_DRAW} as u from numbered) a) b)
"""


def _vectors_sql(source: str, key: str, out: str) -> str:
    """CTEs that hash the texts of ``source`` (key, text) into unit vectors ``out`` (key, dim_idx, value)."""
    return rf"""
, {out}_t AS (select {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\v\f\r]+'), lambda x: x <> '') as toks
             from {source})
, {out}_h AS (select {key}, cast(floor(pos / {CHUNK}) as int) as chunk, md5(tok) as m
             from (select {key}, unnest(toks) as tok, unnest(range(len(toks))) as pos from {out}_t) a)
, {out}_c AS (select {key}, chunk, cast(cast(concat('0x', substring(m, 1, 8)) as bigint) % 64 as int) as dim_idx,
                    sum(case when cast(concat('0x', substring(m, 9, 1)) as int) % 2 = 0 then 1.0 else -1.0 end) as v
             from {out}_h group by 1, 2, 3)
, {out}_n AS (select {key}, chunk, sqrt(sum(v * v)) as norm from {out}_c group by 1, 2)
, {out}_p AS (select {key}, dim_idx, sum(v / norm) as s from {out}_c join {out}_n using ({key}, chunk)
             where norm > 0 group by 1, 2)
, {out}_l AS (select {key}, sqrt(sum(s * s)) as len from {out}_p group by 1)
, {out} AS (select {key}, dim_idx, cast(s / len as double) as value from {out}_p join {out}_l using ({key}) where len > 0)
"""


@register("add_memory_vectors", _RECORDS + _vectors_sql("numbered", "id", "vec") + """
select symbol, layer, rec.id, date, cast(importance as double) as importance, cast(compound as double) as compound,
       dim_idx, round(value, 6) as value
from rec join vec on rec.id = vec.id where round(value, 6) <> 0""")
def q_add_memory_vectors(spark, sf_dir):
    """I1 + K1: every news text and filing as a scored record with its unit vector, one row per non-zero value."""
    records = add_memory(news_and_filings(spark, sf_dir), chunk_tokens=CHUNK)
    long = records.select("symbol", "layer", "id", "date", "importance", "compound",
                          F.posexplode("embedding").alias("dim_idx", "value"))
    # most slots of a short text are zero: they go before the rounding
    return long.where("value <> 0").withColumn("value", r6("value")).where("value <> 0")


@register("add_memory_retrieval", _RECORDS + _vectors_sql("numbered", "id", "vec") + """
, ask AS (select symbol, arg_min(headline, seq) as text from env_news group by 1)
""" + _vectors_sql("ask", "symbol", "qv") + f"""
, sims AS (select q.symbol, v.id, sum(v.value * q.value) as sim
           from vec v join rec r on r.id = v.id join qv q on q.symbol = r.symbol and q.dim_idx = v.dim_idx group by 1, 2)
, pairs AS (select r.symbol, r.layer, r.id, r.compound, round(coalesce(s.sim, 0), 9) as sim
            from rec r join ask on ask.symbol = r.symbol left join sims s on s.id = r.id)
, f2 AS (select * exclude (rn) from (select *, row_number() over (partition by symbol, layer order by sim desc, id) as rn
                                     from pairs) where rn <= {TOP_K})
, f3 AS (select * exclude (rn) from (select *, row_number() over (partition by symbol, layer order by compound, id) as rn
                                     from pairs) where rn <= {TOP_K})
, n AS (select symbol, layer, count(*) as n from pairs group by 1, 2)
, bag AS (select symbol, layer, id, sim + compound as score, 0 as src from f2
          union all select symbol, layer, id, sim + compound, 1 from f3)
, top AS (select b.* from (select bag.*, n.n, row_number() over (partition by bag.symbol, bag.layer
                                   order by round(score, 9) desc, id, src) as rn
                           from bag join n using (symbol, layer)) b where rn <= least({TOP_K}, n))
, u AS (select symbol, layer, id, max(score) as score from top group by 1, 2, 3)
select symbol, layer, id, round(cast(score as double), 6) as score,
       row_number() over (partition by symbol, layer order by id) as pos from u""")
def q_add_memory_retrieval(spark, sf_dir):
    """F5 over the records that ``add_memory`` wrote; a symbol's query is its first headline, embedded by the same model."""
    records = cut_lineage(add_memory(news_and_filings(spark, sf_dir), chunk_tokens=CHUNK), "memories")
    first = derive_env_news(Tables(spark, sf_dir)).groupBy("symbol").agg(F.min_by("headline", "seq").alias("text"))
    asked = embed_texts(first.withColumn("qid", F.xxhash64("symbol")), chunk_tokens=CHUNK)
    asked = asked.withColumn("embedding", l2_normalize(F.col("embedding")))
    out = R.hybrid_retrieval(records, asked.select("qid", "symbol", "embedding"), TOP_K)
    return out.select("symbol", "layer", "id", r6("score").alias("score"), "pos")
