"""Registered queries: batch decision preparation and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import decisions as D
from quantloom.operators import memory as MM
from quantloom.operators import portfolio as P
from quantloom.operators import retrieval as R
from quantloom.plans import q_retrieval as QR
from quantloom.plans.fixtures_sql import ACTIONS, CITATIONS, MEMORIES, PRICES, with_
from quantloom.plans.registry import register
from quantloom.sources.tables import Tables, derive_citations, derive_memories


def _q(s: str) -> str:
    return s.replace("'", "''")


# ----------------------------------------------------------------- shared inputs

def _steps(t: Tables):
    """One decision step per query row: its symbol, a date and a momentum sign."""
    e = t.embeddings
    return e.select(F.col("vec_id").alias("qid"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("symbol"),
                    F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 30).cast("int")).alias("date"),
                    (F.col("vec_id") % 3 - 1).cast("int").alias("momentum"))


def _budgeted(spark, sf_dir):
    t = Tables(spark, sf_dir)
    mem, q = QR._inputs(spark, sf_dir)
    from quantloom.session import cut_lineage
    hits = cut_lineage(R.hybrid_retrieval(mem, q, QR.TOP_K), "hits")   # later steps fork over it
    return D.budgeted_hits(hits, t.documents.select(F.col("doc_id").alias("id"), "text"))


def _prompts(spark, sf_dir, mode="test"):
    t = Tables(spark, sf_dir)
    steps = _steps(t).withColumn("record", (F.col("qid") % 7 - 3) / F.lit(2.0))
    return D.render_prompt(D.memory_blocks(_budgeted(spark, sf_dir)), steps, mode=mode)


_HITS_SQL = QR._BASE + """
, n AS (select symbol, layer, count(*) as n from mem group by 1, 2)
, bag AS (select qid, symbol, layer, id, sim + compound as score, 0 as src from f2
          union all select qid, symbol, layer, id, sim + compound, 1 from f3)
, top AS (select b.* from (select bag.*, n.n, row_number() over (partition by qid, bag.layer
                                   order by score desc, id, src) as rn
                           from bag join n on bag.symbol = n.symbol and bag.layer = n.layer) b
          where rn <= least(3, n))
, hits AS (select qid, symbol, layer, id, row_number() over (partition by qid, layer order by id) as pos
           from (select qid, symbol, layer, id from top group by 1, 2, 3, 4))
, it AS (select h.*, d.text,
                list_filter(string_split_regex(coalesce(d.text, ''), '\\s+'), lambda t: t <> '') as tok,
                case h.layer when 'short' then 300 when 'mid' then 80 when 'long' then 80 else 50 end as budget
         from hits h join documents d on d.doc_id = h.id)
, it2 AS (select *, len(tok) as n_tok,
                 coalesce(sum(len(tok)) over (partition by qid, layer order by pos
                                              rows between unbounded preceding and 1 preceding), 0) as prior
          from it)
, budgeted AS (select qid, symbol, layer, id, pos,
                      case when prior + n_tok <= budget then text
                           else array_to_string(tok[1:budget - prior], ' ') end as text,
                      case when prior + n_tok <= budget then n_tok else budget - prior end as n_tokens
               from it2 where prior + n_tok <= budget or prior < budget)
"""


@register("token_budget", _HITS_SQL + """
select qid, layer, id, pos, cast(n_tokens as int) as n_tokens, text from budgeted""")
def q_token_budget(spark, sf_dir):
    b = _budgeted(spark, sf_dir)
    return b.select("qid", "layer", "id", "pos", F.col("n_tokens").cast("int").alias("n_tokens"), "text")


def _prompt_sql() -> str:
    titles = " ".join(f"when '{k}' then '{v}'" for k, v in D.LAYER_TITLE.items())
    order = "case layer when 'short' then 0 when 'mid' then 1 when 'long' then 2 else 3 end"
    sent = _q(D.SENTIMENT_EXPLANATION)
    mexp = _q(D.MOMENTUM_EXPLANATION)
    return _HITS_SQL + f"""
, qids AS (select distinct qid from budgeted)
, grid AS (select qid, unnest(['short', 'mid', 'long', 'reflection']) as layer from qids)
, cnt AS (select qid, layer, count(*) as n from budgeted group by 1, 2)
, lines AS (
    select g.qid, g.layer, b.pos as o, b.id, b.text, coalesce(c.n, 0) as n, 1 as copy
    from grid g join budgeted b on b.qid = g.qid and b.layer = g.layer left join cnt c on c.qid = g.qid and c.layer = g.layer
    union all
    select g.qid, g.layer, b.pos, b.id, b.text, 1, 2
    from grid g join budgeted b on b.qid = g.qid and b.layer = g.layer join cnt c on c.qid = g.qid and c.layer = g.layer
    where c.n = 1
    union all
    select g.qid, g.layer, 0, -1, 'No ' || (case g.layer {titles} end) || ' information.', 0, k
    from grid g left join cnt c on c.qid = g.qid and c.layer = g.layer, (select unnest([1, 2]) as k)
    where c.n is null)
, blocks AS (
    select qid, layer,
           'The ' || (case layer {titles} end) || ' information:' || chr(10)
           || string_agg(cast(id as varchar) || '. ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10)
                         order by o, copy) as block
    from lines group by 1, 2)
, body AS (
    select qid, string_agg(block || case when layer = 'short' then '{sent}' else '' end || chr(10) || chr(10), ''
                           order by {order}) as body
    from blocks group by 1)
, steps AS (select vec_id as qid, concat('L', cast(label as varchar)) as symbol,
                   date '2024-01-01' + cast(vec_id % 30 as int) as date, cast(vec_id % 3 - 1 as int) as momentum
            from embeddings)
, prompts AS (
    select s.qid, s.symbol, s.date, s.momentum,
           'The ticker of the stock to be analyzed is ' || s.symbol || ' and the current date is '
           || strftime(s.date, '%Y-%m-%d') || b.body
           || case when s.momentum = 1 then '{mexp}' || '{_q(D.MOMENTUM_SENTENCE[1])}'
                   when s.momentum = -1 then '{mexp}' || '{_q(D.MOMENTUM_SENTENCE[-1])}' else '' end as prompt
    from steps s join body b on s.qid = b.qid)
"""


@register("prompt_render", _prompt_sql() + """
select qid, symbol, date, prompt from prompts""")
def q_prompt_render(spark, sf_dir):
    return _prompts(spark, sf_dir).select("qid", "symbol", "date", "prompt")


def _train_sql() -> str:
    """The train-mode prompts over the blocks of ``_prompt_sql``: no sentiment or momentum text, the record in front."""
    order = "case layer when 'short' then 0 when 'mid' then 1 when 'long' then 2 else 3 end"
    return _prompt_sql() + f"""
, facts AS (select qid, symbol, date, cast((qid % 7 - 3) / 2.0 as double) as record, momentum from steps)
, train AS (
    select f.qid, f.symbol, f.date, f.record, f.momentum,
           'The current date is ' || strftime(f.date, '%Y-%m-%d')
           || '. Here are the observed financial market facts: for ' || f.symbol
           || ', the price difference between the next trading day and the current trading day is: '
           || cast(f.record as varchar) || chr(10) || chr(10) || b.body as prompt
    from facts f join (select qid, string_agg(block || chr(10) || chr(10), '' order by {order}) as body
                       from blocks group by 1) b on b.qid = f.qid)
"""


@register("prompt_render_train", _train_sql() + """
select qid, symbol, date, prompt from train""")
def q_prompt_render_train(spark, sf_dir):
    """H23 train mode: the observed record instead of momentum and sentiment texts."""
    return _prompts(spark, sf_dir, "train").select("qid", "symbol", "date", "prompt")


def _decided(spark, sf_dir, mode="test"):
    """Default decision, with some answers made invalid to exercise the validation paths."""
    resp = D.default_decision(_prompts(spark, sf_dir, mode))
    bad_choice = F.regexp_replace("response", r'"investment_decision":"[a-z]+"', '"investment_decision":"maybe"')
    bad_id = F.regexp_replace("response", r'"long_memory_index":\[\{"memory_index":-?[0-9]+\}\]',
                              '"long_memory_index":[{"memory_index":999999999}]')
    no_list = F.regexp_replace("response", r',"middle_memory_index":\[\{"memory_index":-?[0-9]+\}\]', "")
    resp = resp.withColumn("response", F.when(F.col("qid") % 13 == 0, F.lit(None).cast("string"))
                           .when(F.col("qid") % 11 == 0, F.lit("no answer"))
                           .when(F.col("qid") % 17 == 0, no_list)
                           .when(F.col("qid") % 7 == 0, bad_choice)
                           .when(F.col("qid") % 5 == 0, bad_id).otherwise(F.col("response")))
    return D.parse_decision(resp, mode)


@register("decision_parse", _prompt_sql() + """
, ids AS (select qid, layer, min(id) filter (where id >= 0) as first_real,
                 arg_min(id, o * 10 + copy) as first_id from lines group by 1, 2)
, d AS (select p.qid, p.momentum,
               case when p.qid % 13 = 0 then 'empty'
                    when p.qid % 11 = 0 or p.qid % 17 = 0 or p.qid % 7 = 0 or p.qid % 5 = 0 then 'fallback'
                    else 'ok' end as status,
               case when p.momentum = 1 then 'buy' when p.momentum = -1 then 'sell' else 'hold' end as dec
        from prompts p)
select d.qid, d.status,
       case when d.status = 'ok' then d.dec when d.status = 'fallback' then 'hold' end as investment_decision,
       case when d.status = 'ok' then s.first_id end as short_id,
       case when d.status = 'ok' and s.first_id <> -1 then s.first_id end as short_cited,
       case d.status when 'ok' then 'momentum rule: ' || d.dec when 'fallback' then 'JSON does not match schema' end
         as summary_reason,
       case when d.status = 'empty' then 0 when d.status = 'fallback' then 0
            when d.dec = 'buy' then 1 when d.dec = 'hold' then 0 else -1 end as direction
from d join ids s on s.qid = d.qid and s.layer = 'short'""")
def q_decision_parse(spark, sf_dir):
    p = _decided(spark, sf_dir)
    first = F.element_at(F.col("offered_ids")["short"], 1)
    cited = F.element_at(F.col("short_memory_index"), 1)["memory_index"].cast("long")
    return p.select("qid", "status", "investment_decision",
                    F.when(F.col("status") == "ok", first).alias("short_id"),
                    cited.alias("short_cited"), "summary_reason",
                    P.test_direction(F.col("investment_decision")).alias("direction"))


@register("decision_parse_train", _train_sql() + """
, d AS (select qid, record,
               case when momentum = 1 then 'buy' when momentum = -1 then 'sell' else 'hold' end as dec,
               case when qid % 13 = 0 then 'empty' when qid % 11 = 0 or qid % 17 = 0 then 'fallback'
                    when qid % 7 = 0 then 'ok' when qid % 5 = 0 then 'fallback' else 'ok' end as status
        from train)
select qid, status,
       case when status = 'ok' and qid % 7 = 0 then 'maybe' when status = 'ok' then dec end as investment_decision,
       case status when 'ok' then 'momentum rule: ' || dec when 'fallback' then 'JSON does not match schema' end
         as summary_reason,
       case when record > 0 then 1 else -1 end as direction
from d""")
def q_decision_parse_train(spark, sf_dir):
    """H25 + H18 train mode: the decision word is free, a fallback has no decision, the record gives the action."""
    p = _decided(spark, sf_dir, "train")
    return p.select("qid", "status", "investment_decision", "summary_reason",
                    P.train_direction(F.col("record")).alias("direction"))


@register("decision_cited_ids", _prompt_sql() + """
, ids AS (select qid, layer, arg_min(id, o * 10 + copy) as first_id from lines group by 1, 2)
, d AS (select p.qid, case when p.qid % 13 = 0 then 'empty'
                           when p.qid % 11 = 0 or p.qid % 17 = 0 or p.qid % 7 = 0 or p.qid % 5 = 0 then 'fallback'
                           else 'ok' end as status from prompts p)
select d.qid, d.status,
       max(case when i.layer = 'short' and d.status = 'ok' and i.first_id <> -1 then cast(i.first_id as varchar) end)
         as short_ids,
       max(case when i.layer = 'mid' and d.status = 'ok' and i.first_id <> -1 then cast(i.first_id as varchar) end)
         as mid_ids,
       max(case when i.layer = 'long' and d.status = 'ok' and i.first_id <> -1 then cast(i.first_id as varchar) end)
         as long_ids,
       max(case when i.layer = 'reflection' and d.status = 'ok' and i.first_id <> -1
                then cast(i.first_id as varchar) end) as reflection_ids
from d join ids i on i.qid = d.qid group by 1, 2""")
def q_decision_cited_ids(spark, sf_dir):
    """Distinct cited ids per layer list of each parsed decision, shown as comma lists (NULL when none)."""
    c = D.cited_ids(_decided(spark, sf_dir))
    lists = [F.when(F.size(f"{layer}_ids") > 0, F.array_join(f"{layer}_ids", ",")).alias(f"{layer}_ids")
             for layer in ("short", "mid", "long", "reflection")]
    return c.select("qid", "status", *lists)


_DECISIONS_SQL = """decisions AS (
  select symbol, date, day(date) % 4 <> 0 as has_decision,
         case day(date) % 4 when 1 then case direction when 1 then 'BUY' when -1 then 'SELL' else 'HOLD' end
                            when 2 then ' ' || case direction when 1 then 'buy' when -1 then 'sell' else 'hold' end || ' '
                            when 3 then 'maybe' end as investment_decision,
         'reason ' || symbol || ' ' || strftime(date, '%Y-%m-%d') as summary_reason
  from actions where model = 'm0')"""


def _decisions(t: Tables):
    a = t.actions.where(F.col("model") == "m0")
    dom = F.dayofmonth("date") % 4
    lab = F.when(F.col("direction") == 1, "buy").when(F.col("direction") == -1, "sell").otherwise("hold")
    dec = (F.when(dom == 1, F.upper(lab)).when(dom == 2, F.concat(F.lit(" "), lab, F.lit(" ")))
           .when(dom == 3, F.lit("maybe")))
    return a.select("symbol", "date", (dom != 0).alias("has_decision"), dec.alias("investment_decision"),
                    F.concat(F.lit("reason "), F.col("symbol"), F.lit(" "), F.date_format("date", "yyyy-MM-dd"))
                    .alias("summary_reason"))


@register("decision_label", with_(PRICES, ACTIONS, _DECISIONS_SQL) + """
select d.symbol, d.date,
       case when lower(trim(d.investment_decision)) in ('buy', 'sell', 'hold') then upper(lower(trim(d.investment_decision)))
            when a.direction = 1 then 'BUY' when a.direction = -1 then 'SELL' else 'HOLD' end as decision
from decisions d left join (select * from actions where model = 'm1') a on a.symbol = d.symbol and a.date = d.date""")
def q_decision_label(spark, sf_dir):
    t = Tables(spark, sf_dir)
    acts = t.actions.where(F.col("model") == "m1").select("symbol", "date", "direction")
    j = _decisions(t).join(acts, ["symbol", "date"], "left")
    return j.select("symbol", "date", D.decision_label(F.col("investment_decision"), F.col("direction")).alias("decision"))


@register("decision_export", with_(PRICES, ACTIONS, _DECISIONS_SQL) + """
, a AS (select symbol, date, direction from actions where model = 'm0')
, bt AS (select d.symbol as stock, d.date as test_date,
                case when lower(trim(d.investment_decision)) in ('buy', 'sell', 'hold')
                     then upper(lower(trim(d.investment_decision)))
                     when a.direction = 1 then 'BUY' when a.direction = -1 then 'SELL' else 'HOLD' end as decision
         from decisions d left join a on a.symbol = d.symbol and a.date = d.date where d.has_decision)
select stock, test_date, decision,
       stock || '_decisions_' || strftime(min(test_date) over (partition by stock), '%Y-%m-%d') || '_'
             || strftime(max(test_date) over (partition by stock), '%Y-%m-%d') || '_agent.csv' as file_name,
       count(*) over (partition by stock) as n_decisions
from bt""")
def q_decision_export(spark, sf_dir):
    t = Tables(spark, sf_dir)
    acts = t.actions.where(F.col("model") == "m0").select("symbol", "date", "direction")
    out = D.decision_export(acts, _decisions(t))["backtest"]
    return out.select("stock", "test_date", "decision",
                      D.backtest_file_name(F.col("stock"), F.col("first_date"), F.col("last_date")).alias("file_name"),
                      "n_decisions")


@register("decision_legacy", with_(PRICES, ACTIONS, _DECISIONS_SQL) + """
select d.symbol, d.date, d.investment_decision, d.summary_reason, a.direction
from decisions d left join (select * from actions where model = 'm0') a on a.symbol = d.symbol and a.date = d.date""")
def q_decision_legacy(spark, sf_dir):
    t = Tables(spark, sf_dir)
    acts = t.actions.where(F.col("model") == "m0").select("symbol", "date", "direction")
    return D.decision_export(acts, _decisions(t))["legacy"]


_LOOP_SQL = with_(PRICES, ACTIONS, MEMORIES, CITATIONS) + """
, steps AS (select a.model, a.symbol, a.date, a.direction, p.price,
                   sum(a.direction) over (partition by a.symbol, a.model order by a.date
                                          rows between unbounded preceding and current row) as shares
            from actions a join prices p on a.symbol = p.symbol and a.date = p.date where a.model = 'm0')
, fb AS (select symbol, date,
                case when n > 7 then cast(sign(lag(x, 6) over w + lag(x, 5) over w + lag(x, 4) over w + lag(x, 3) over w
                                               + lag(x, 2) over w + lag(x, 1) over w + x) as int) end as feedback,
                case when n > 7 then lag(date, 6) over w end as feedback_date
         from (select *, (price - lag(price) over w) * lag(shares) over w as x, row_number() over w as n
               from steps window w as (partition by symbol, model order by date))
         window w as (partition by symbol, model order by date))
, dec AS (select concat('S', cast(vec_id % 25 as varchar)) as symbol,
                 date '1995-01-01' + cast((vec_id * 13) % 2400 as int) as date, vec_id as cited_id from embeddings)
, hits AS (select fb.symbol, fb.date, fb.feedback, dec.cited_id
           from fb join dec on fb.symbol = dec.symbol and fb.feedback_date = dec.date
           where fb.feedback is not null and fb.feedback <> 0)
"""


@register("feedback_loop", _LOOP_SQL + """
select symbol, date, cited_id, feedback from hits""")
def q_feedback_loop(spark, sf_dir):
    """Portfolio feedback sign -> the decision of the tagged date -> its cited memory ids."""
    t = Tables(spark, sf_dir)
    steps = t.actions.where(F.col("model") == "m0").join(t.prices, ["symbol", "date"])
    fb = P.feedback(steps).where(F.col("feedback").isNotNull() & (F.col("feedback") != 0))
    e = t.embeddings
    dec = e.select(F.concat(F.lit("S"), (F.col("vec_id") % 25).cast("string")).alias("symbol"),
                   F.date_add(F.lit("1995-01-01").cast("date"), ((F.col("vec_id") * 13) % 2400).cast("int"))
                   .alias("feedback_date"), F.col("vec_id").alias("cited_id"))
    j = fb.join(dec, ["symbol", "feedback_date"])
    return j.select("symbol", "date", "cited_id", "feedback")


@register("feedback_applied", _LOOP_SQL + """
, mem AS (select concat('S', cast(id % 25 as varchar)) as symbol, id, layer, importance, recency, delta,
                 access_counter from memories)
, ev AS (select symbol, cited_id as id, feedback,
                sum(feedback) over (partition by symbol, cited_id order by date
                                    rows between unbounded preceding and current row) as so_far
         from hits)
, g AS (select symbol, id, sum(feedback) as total, sum(so_far) as steps, count(*) as n from ev group by 1, 2)
, after AS (select m.symbol, m.id, m.layer, m.recency, m.delta, g.n is not null as updated,
                   m.importance + 5.0 * coalesce(g.n * m.access_counter + g.steps, 0) as importance,
                   cast(m.access_counter + coalesce(g.total, 0) as int) as access_counter
            from mem m left join g on g.symbol = m.symbol and g.id = m.id)
select symbol, id, layer, round(importance, 6) as importance, round(recency, 6) as recency, delta,
       round(recency + least(importance, 100.0) / 100.0, 6) as compound, access_counter, updated
from after""")
def q_feedback_applied(spark, sf_dir):
    """I13 to its end: the cited memories of each judged decision get their access counters and importance (I4)."""
    from quantloom.plans.q_memory import _out
    mem = MM.with_compound(derive_memories(Tables(spark, sf_dir)).drop("embedding")).withColumn(
        "symbol", F.concat(F.lit("S"), (F.col("id") % 25).cast("string")))
    routed = MM.route_feedback(mem, q_feedback_loop(spark, sf_dir))
    return _out(MM.apply_feedback(mem, routed), ["updated"])
