"""DuckDB text of the derived inputs, used by the oracle SQL of each query.

These mirror ``quantloom.sources.tables.derive_*`` so the oracle sees the
same prices, actions, news, memories and citations as the Spark plans.
"""

PRICES = """prices AS (
  select concat('S', cast(c.c_nationkey as varchar)) as symbol, cast(o.o_orderdate as date) as date,
         max(o.o_totalprice) as price
  from orders o join customer c on o.o_custkey = c.c_custkey group by 1, 2)"""

ACTIONS = """actions AS (
  select m.model, p.symbol, p.date,
         cast((day(p.date)*7 + month(p.date)*3 + length(p.symbol) + m.k*5) % 3 - 1 as int) as direction
  from prices p cross join (select 'm0' as model, 0 as k union all select 'm1', 1 union all select 'm2', 2) m)"""

RAW_NEWS = """raw_news AS (
  select doc_id as item_id, upper(source) as symbol,
         cast(timestamp '2024-01-01 00:00:00' + doc_id * interval '37' minute as timestamp) as dates,
         concat(case when doc_id % 3 = 0 then concat('UPDATE ', cast(doc_id % 4 as varchar), '-') else '' end,
                substring(replace(text, chr(10), ' '), 1, 40)) as headline,
         concat(case when doc_id % 5 = 0 then 'CITY, Jan 1 (Reuters) - ' else '' end, text) as body,
         lang as item_language
  from documents)"""

MEMORIES = """memories AS (
  select case vec_id % 4 when 0 then 'short' when 1 then 'mid' when 2 then 'long' else 'reflection' end as layer,
         concat('L', cast(label as varchar)) as symbol, vec_id as id,
         cast(40 + (vec_id * 7) % 56 as double) as importance,
         exp(-(cast(vec_id % 9 as double) / cast(3 as double))) as recency,
         cast(vec_id % 9 as int) as delta, cast(0 as int) as access_counter, vec_id as seq, embedding
  from embeddings)"""

CITATIONS = """citations AS (
  select concat('L', cast(vec_id % 10 as varchar)) as symbol,
         date '2024-01-01' + cast(vec_id % 30 as int) as date,
         vec_id as cited_id, cast(vec_id % 3 - 1 as int) as feedback
  from embeddings)"""

TICKS = """ticks AS (
  select concat('U', cast(user_id as varchar)) as symbol, cast(ts as date) as date,
         max(value) as price, count(*) as n_ticks
  from events group by 1, 2)"""

MEMORY_PARAMS = """memory_params AS (
  select * from (values
    ('short', cast(null as double), 60.0, 3.0, 0.92, 0.05, 5.0, 0),
    ('mid', 60.0, 80.0, 90.0, 0.967, 0.05, 5.0, 1),
    ('long', 80.0, cast(null as double), 365.0, 0.988, 0.05, 5.0, 2),
    ('reflection', cast(null as double), cast(null as double), 365.0, 0.988, 0.05, 5.0, 3))
    t(layer, jump_lower, jump_upper, recency_factor, importance_factor, recency_threshold,
      importance_threshold, priority))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"

SUBJECTS = """data_subject AS (
  select doc_id as item_id,
         case when doc_id % 2 = 0 then concat('R:', upper(source), '.O')
              else concat('P:', cast(100000 + cast(substring(source, 4, 10) as int) as varchar)) end as subject
  from documents
  union all select doc_id, concat('N:', upper(lang)) from documents)"""

TICKER_MAP = """ticker_map AS (
  select distinct upper(source) as ticker, concat('R:', upper(source), '.') as ric_prefix,
         concat('P:', cast(100000 + cast(substring(source, 4, 10) as int) as varchar)) as perm_id
  from documents)"""

CALENDAR_TICKS = """calendar AS (
  select distinct cast(ts as date) as date from events where isodow(cast(ts as date)) between 1 and 5)"""

ENV_NEWS = """env_news AS (
  select concat('U', cast(item_id % 150 as varchar)) as symbol,
         case when hour(dates) >= 16 then cast(dates as date) + 1 else cast(dates as date) end as date,
         item_id as seq, headline, body
  from raw_news)"""

NEWS_ITEMS = """news_items AS (
  select symbol, date, seq, trim(concat(coalesce(headline, ''), ' ', coalesce(body, ''))) as text from env_news
  where trim(concat(coalesce(headline, ''), ' ', coalesce(body, ''))) <> '')"""

FILINGS = """filings AS (
  select concat('U', cast(doc_id % 150 as varchar)) as symbol,
         cast(timestamp '2024-01-01 00:00:00' + doc_id * interval '37' minute as date) as date,
         case doc_id % 3 when 0 then '10-K' when 1 then '10-Q' else '20-F' end as form,
         text as content, doc_id as seq
  from documents)"""
