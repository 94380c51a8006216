"""Registered queries: memory scoring, ageing, promotion, lifecycle and feedback (I*, C10, A19)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions.numeric import r6
from quantloom.functions.vectors import inner_product
from quantloom.operators import agent_loop as AL
from quantloom.operators import memory as MM
from quantloom.plans.fixtures_sql import CITATIONS, ENV_NEWS, FILINGS, MEMORIES, PRICES, RAW_NEWS, with_
from quantloom.plans.registry import register
from quantloom.sources.tables import (Tables, derive_citations, derive_env_news, derive_filings,
                                      derive_memories)

LIFECYCLE_STEPS = 30   # the citation dates span 30 days: one memory step per day
EPOCH = "2024-01-01"   # first day of the citation series (step 1)


def _mem(spark, sf_dir):
    return MM.with_compound(derive_memories(Tables(spark, sf_dir)).drop("embedding"))


def _out(df, extra=()):
    return df.select("symbol", "id", "layer", r6("importance").alias("importance"), r6("recency").alias("recency"),
                     "delta", r6("compound").alias("compound"), "access_counter", *extra)


# ----------------------------------------------------------------- SQL text of the rules (oracle side)

# the rules once more, written out: the oracle takes nothing from the operators it checks
_RULES = {
    "recency_factor": {"short": 3.0, "mid": 90.0, "long": 365.0, "reflection": 365.0},
    "importance_factor": {"short": 0.92, "mid": 0.967, "long": 0.988, "reflection": 0.988},
    "recency_threshold": {"short": 0.05, "mid": 0.05, "long": 0.05, "reflection": 0.05},
    "importance_threshold": {"short": 5.0, "mid": 5.0, "long": 5.0, "reflection": 5.0},
}
# two rounds, each short, mid, long in turn: where an importance leads, whether a move went up, and the moves
_MOVES = (
    ("short", ">= 80", "long", True, "short>mid;mid>long;"),
    ("short", ">= 60", "mid", True, "short>mid;"),
    ("mid", ">= 80", "long", True, "mid>long;"),
    ("mid", "< 60", "short", False, "mid>short;"),
    ("long", "< 60", "short", False, "long>mid;mid>short;"),
    ("long", "< 80", "mid", False, "long>mid;"),
)


def _case_sql(layer: str, attr: str) -> str:
    parts = " ".join(f"when {layer} = '{name}' then cast({v} as double)" for name, v in _RULES[attr].items())
    return f"(case {parts} end)"


def _jump_sql(layer: str, imp: str):
    def case(values, rest):
        parts = " ".join(f"when {layer} = '{name}' and {imp} {cond} then {v}"
                         for (name, cond, *_), v in zip(_MOVES, values))
        return f"(case {parts} else {rest} end)"
    return (case([f"'{m[2]}'" for m in _MOVES], layer), case([str(m[3]).lower() for m in _MOVES], "false"),
            case([f"'{m[4]}'" for m in _MOVES], "''"))


def _compound_sql(rec: str, imp: str) -> str:
    return f"({rec} + least({imp}, 100.0) / 100.0)"


_MEM_C = with_(MEMORIES) + ", mc AS (select *, " + _compound_sql("recency", "importance") + " as compound from memories)\n"

_DECAY_COLS = f"""delta + 1 as delta1,
       exp(-(cast(delta + 1 as double) / {_case_sql('layer', 'recency_factor')})) as rec1,
       importance * {_case_sql('layer', 'importance_factor')} as imp1"""


def _step_select(src: str) -> str:
    """One memory step over relation ``src`` with columns of the state."""
    final, up, path = _jump_sql("layer", "imp1")
    return f"""
select symbol, id,
       case when alive1 then {final} else layer end as layer,
       imp1 as importance,
       case when alive1 and {up} then 1.0 else rec1 end as recency,
       case when alive1 and {up} then 0 else delta1 end as delta,
       {_compound_sql('rec1', 'imp1')} as compound, access_counter, alive1 as alive,
       jumped or (alive1 and {path} <> '') as jumped,
       transition || case when alive1 then {path} else '' end as transition
from (select *, alive and not (rec1 < {_case_sql('layer', 'recency_threshold')}
                               or imp1 < {_case_sql('layer', 'importance_threshold')}) as alive1
      from (select *, {_DECAY_COLS} from {src}) a) b"""


def _rounded(src: str, extra: str = "") -> str:
    return f"""select symbol, id, layer, round(importance, 6) as importance, round(recency, 6) as recency, delta,
       round(compound, 6) as compound, access_counter{extra} from {src}"""


# ----------------------------------------------------------------- queries

@register("memory_params", with_(MEMORIES) + """
, p AS (select layer, cast(jump_lower as double) as jump_lower, cast(jump_upper as double) as jump_upper,
               cast(recency_factor as double) as recency_factor, cast(importance_factor as double) as importance_factor,
               cast(recency_threshold as double) as recency_threshold,
               cast(importance_threshold as double) as importance_threshold, priority
        from (values
          ('short', null, 60, 3, 0.92, 0.05, 5, 0),
          ('mid', 60, 80, 90, 0.967, 0.05, 5, 1),
          ('long', 80, null, 365, 0.988, 0.05, 5, 2),
          ('reflection', null, null, 365, 0.988, 0.05, 5, 3))
          t(layer, jump_lower, jump_upper, recency_factor, importance_factor, recency_threshold,
            importance_threshold, priority))
select p.*, coalesce(c.n_records, 0) as n_records
from p left join (select layer, count(*) as n_records from memories group by 1) c on c.layer = p.layer""")
def q_memory_params(spark, sf_dir):
    """The layer parameter table with the number of memory records each layer holds."""
    counts = derive_memories(Tables(spark, sf_dir)).groupBy("layer").agg(F.count(F.lit(1)).alias("n_records"))
    return (MM.params_df(spark).join(counts, "layer", "left")
            .withColumn("n_records", F.coalesce("n_records", F.lit(0).cast("long"))))


_DRAW = ("cast(cast(concat('0x', substring(md5(concat('42-', cast(id as varchar))), 1, 8)) as bigint) as double)"
         " / 4294967296")


@register("memory_init", with_(RAW_NEWS, ENV_NEWS, FILINGS) + f"""
, items AS (
  select symbol, date, seq * 4 as id, 'short' as layer from env_news
  union all select symbol, date, seq * 4 + case when form = '10-K' then 2 else 1 end,
                   case when form = '10-K' then 'long' else 'mid' end from filings)
, d AS (select *, {_DRAW} as u from items)
select symbol, date, id, layer, cast(
       case layer when 'short' then (case when u < 0.5 then 50.0 when u < 0.95 then 70.0 else 90.0 end)
                  when 'mid' then (case when u < 0.05 then 40.0 when u < 0.85 then 60.0 else 80.0 end)
                  else (case when u < 0.05 then 40.0 when u < 0.2 then 60.0 else 80.0 end) end as double) as importance,
       cast(1.0 as double) as recency, 0 as delta, 0 as access_counter,
       round(cast(1.0 + least(case layer when 'short' then (case when u < 0.5 then 50.0 when u < 0.95 then 70.0 else 90.0 end)
                  when 'mid' then (case when u < 0.05 then 40.0 when u < 0.85 then 60.0 else 80.0 end)
                  else (case when u < 0.05 then 40.0 when u < 0.2 then 60.0 else 80.0 end) end, 100.0) / 100.0 as double), 6)
         as compound
from d""")
def q_memory_init(spark, sf_dir):
    t = Tables(spark, sf_dir)
    news = derive_env_news(t).select("symbol", "date", (F.col("seq") * 4).alias("id"),
                                     MM.route_layer(F.lit("news")).alias("layer"))
    fil = derive_filings(t)
    fil = fil.select("symbol", "date",
                     (F.col("seq") * 4 + F.when(F.col("form") == "10-K", 2).otherwise(1)).alias("id"),
                     MM.route_layer(F.when(F.col("form") == "10-K", "10-K").otherwise("10-Q")).alias("layer"))
    m = MM.init_memories(news.unionByName(fil))
    return m.select("symbol", "date", "id", "layer", "importance", "recency", "delta", "access_counter",
                    r6("compound").alias("compound"))


@register("memory_decay", _MEM_C + f"""
select symbol, id, layer, round(imp1, 6) as importance, round(rec1, 6) as recency, delta1 as delta,
       round({_compound_sql('rec1', 'imp1')}, 6) as compound, access_counter
from (select *, {_DECAY_COLS} from mc)""")
def q_memory_decay(spark, sf_dir):
    return _out(MM.decay(_mem(spark, sf_dir)))


@register("memory_cleanup", _MEM_C + f"""
select symbol, id, layer, (rec1 < {_case_sql('layer', 'recency_threshold')}
                           or imp1 < {_case_sql('layer', 'importance_threshold')}) as removed
from (select *, {_DECAY_COLS} from mc)""")
def q_memory_cleanup(spark, sf_dir):
    kept, removed = MM.cleanup(MM.decay(_mem(spark, sf_dir)))
    return (kept.select("symbol", "id", "layer", F.lit(False).alias("removed"))
            .unionByName(removed.select("symbol", "id", "layer", F.lit(True).alias("removed"))))


_JF, _JU, _JP = _jump_sql("layer", "importance")


@register("memory_transition", _MEM_C + f"""
select symbol, id, {_JF} as layer, round(importance, 6) as importance,
       round(case when {_JU} then 1.0 else recency end, 6) as recency,
       case when {_JU} then 0 else delta end as delta, round(compound, 6) as compound, access_counter,
       {_JP} as transition
from mc""")
def q_memory_transition(spark, sf_dir):
    return _out(MM.transitions(_mem(spark, sf_dir)), ["transition"])


@register("memory_step", _MEM_C + ", s AS (" + _step_select(
    "(select *, true as alive, false as jumped, '' as transition from mc)") + ")\n" +
    _rounded("s", ", alive, jumped, transition"))
def q_memory_step(spark, sf_dir):
    return _out(MM.memory_step(_mem(spark, sf_dir)), ["alive", "jumped", "transition"])


def _lifecycle_sql(n: int, events: bool = True, audit: bool = False) -> str:
    final, up, path = _jump_sql("layer", "imp1")
    fb_ok = "(alive and not jumped and fb is not null and fb <> 0)"
    ev_sql = (f"select cited_id as id, cast(date - date '{EPOCH}' as int) + 1 as step, feedback from citations"
              if events else "select cast(null as bigint) as id, cast(null as int) as step, "
                             "cast(null as int) as feedback where false")
    return with_(MEMORIES, CITATIONS).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, ev AS ({ev_sql})
, st AS (
  select symbol, id, 0 as k, layer, importance, recency, delta,
         {_compound_sql('recency', 'importance')} as compound, access_counter, true as alive, false as jumped,
         '' as transition
  from memories
  union all
  select symbol, id, k, case when alive1 then {final} else layer end, imp1,
         case when alive1 and {up} then 1.0 else rec1 end, case when alive1 and {up} then 0 else delta1 end,
         {_compound_sql('rec1', 'imp1')}, access_counter, alive1, jumped or (alive1 and {path} <> ''),
         transition || case when alive1 then {path} else '' end
  from (select *, alive and not (rec1 < {_case_sql('layer', 'recency_threshold')}
                                 or imp1 < {_case_sql('layer', 'importance_threshold')}) as alive1
        from (select *, case when alive then delta + 1 else delta end as delta1,
                     case when alive then exp(-(cast(delta + 1 as double) / {_case_sql('layer', 'recency_factor')}))
                          else recency end as rec1,
                     case when alive then importance2 * {_case_sql('layer', 'importance_factor')}
                          else importance2 end as imp1
              from (select st.symbol, st.id, st.k + 1 as k, st.layer, st.recency, st.delta, st.alive, st.jumped,
                           st.transition,
                           case when {fb_ok.replace('fb', 'ev.feedback').replace('alive', 'st.alive').replace('jumped', 'st.jumped')}
                                then st.access_counter + ev.feedback else st.access_counter end as access_counter,
                           case when {fb_ok.replace('fb', 'ev.feedback').replace('alive', 'st.alive').replace('jumped', 'st.jumped')}
                                then st.importance + cast(st.access_counter + ev.feedback as double) * 5.0
                                else st.importance end as importance2
                    from st left join ev on ev.id = st.id and ev.step = st.k + 1
                    where st.k < {n}) f) d) e
)
""" + ("""select symbol, id, k as step, layer, round(importance, 6) as importance, round(recency, 6) as recency,
       alive from st where k >= 1""" if audit else f"""select symbol, id, layer, round(importance, 6) as importance,
       round(recency, 6) as recency, delta, round(compound, 6) as compound, access_counter, alive, jumped, transition
from st where k = {n}""")


@register("memory_lifecycle", _lifecycle_sql(LIFECYCLE_STEPS))
def q_memory_lifecycle(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ev = derive_citations(t).select(F.col("cited_id").alias("id"),
                                    (F.datediff("date", F.lit(EPOCH).cast("date")) + 1).alias("step"), "feedback")
    out = MM.memory_lifecycle(_mem(spark, sf_dir), LIFECYCLE_STEPS, ev)
    return _out(out, ["alive", "jumped", "transition"])


AUDIT_STEPS = 10


@register("memory_audit", _lifecycle_sql(AUDIT_STEPS, events=False, audit=True))
def q_memory_audit(spark, sf_dir):
    """Per-step snapshots of every record over ten steps without feedback."""
    out = MM.audit_rows(MM.memory_lifecycle(_mem(spark, sf_dir), AUDIT_STEPS, None, trace=True))
    return out.select("symbol", "id", "step", "layer", r6("importance").alias("importance"),
                      r6("recency").alias("recency"), "alive")


@register("memory_audit_jumps", _lifecycle_sql(LIFECYCLE_STEPS).rsplit("select symbol, id, layer,", 1)[0] + """
, d AS (select *, substr(transition, length(lag(transition) over w) + 1) as moves, coalesce(lag(alive) over w, true) as lived
        from st window w as (partition by symbol, id order by k))
select symbol, id, k as step, layer, round(importance, 6) as importance, round(recency, 6) as recency,
       round(compound, 6) as compound, access_counter, alive, moves as transition,
       cast(case when moves = '' then 0 when moves like 'short%' or moves like 'mid>long%' then 1 else -1 end as int) as direction
from d where k >= 1 and lived""")
def q_memory_audit_jumps(spark, sf_dir):
    """I12 over the whole replay: the state, moves and their direction of every record in every step, events applied."""
    mem = _mem(spark, sf_dir)
    ev = derive_citations(Tables(spark, sf_dir)).select(F.col("cited_id").alias("id"), (F.datediff(
        "date", F.lit(EPOCH).cast("date")) + 1).alias("step"), "feedback").join(mem.select("symbol", "id"), "id")
    out = AL.audit_steps(mem, LIFECYCLE_STEPS, ev)
    return out.select("symbol", "id", "step", "layer", r6("importance").alias("importance"), r6("recency").alias("recency"),
                      r6("compound").alias("compound"), "access_counter", "alive", "transition", "direction")


LOOP_DAYS, LOOP_K, LOOP_BACK = 6, 3, 2


def _loop_sql() -> str:
    sql = with_(MEMORIES, PRICES) + f"""
, dated AS (select 'L' || substr(symbol, 2) as symbol, price, row_number() over (partition by symbol order by date) - 1 as day
            from prices where cast(substr(symbol, 2) as int) < 10)
, p AS (select * from dated where day < {LOOP_DAYS})
, dir AS (select *, coalesce(cast(sign(price - lag(price) over w) as int), 0) as direction
          from p window w as (partition by symbol order by day))
, held AS (select *, sum(direction) over (partition by symbol order by day) as shares from dir)
, x AS (select *, (price - lag(price) over w) * lag(shares) over w as x from held window w as (partition by symbol order by day))
, fb AS (select symbol, day, case when day >= {LOOP_BACK} then cast(sign(lag(x) over w + x) as int) end as feedback
         from x window w as (partition by symbol order by day))
, q AS (select concat('L', cast(label as varchar)) as symbol, arg_min(embedding, vec_id) as qv from embeddings group by label)
, rec AS (select m.*, cast(m.id % {LOOP_DAYS} as int) as created, {_compound_sql('recency', 'importance')} as compound,
                 list_inner_product(cast(m.embedding as double[]), cast(q.qv as double[])) as sim
          from memories m join q on q.symbol = m.symbol)
, live0 AS (select symbol, id, seq, sim, layer, importance, recency, delta, compound, access_counter, false as jumped
            from rec where false)"""
    final, up, path = _jump_sql("layer", "imp1")
    for d in range(LOOP_DAYS):
        cited = f"(select distinct symbol, id from ret{d - 1})" if d else "(select symbol, id from rec where false)"
        sql += f"""
, st{d} AS (select * from live{d} union all
            select symbol, id, seq, sim, layer, importance, recency, delta, compound, access_counter, false from rec where created = {d})
, bag{d} AS (
  select symbol, layer, id, sim + compound as score, 0 as src from (select *, row_number() over (partition by symbol, layer
    order by sim desc, id) as rn from st{d}) where rn <= {LOOP_K}
  union all select symbol, layer, id, sim + compound, 1 from (select *, row_number() over (partition by symbol, layer
    order by compound, seq) as rn from st{d}) where rn <= {LOOP_K})
, top{d} AS (select * from (select b.*, n.n, row_number() over (partition by b.symbol, b.layer order by score desc, id, src) as rn
             from bag{d} b join (select symbol, layer, count(*) as n from st{d} group by 1, 2) n
               on n.symbol = b.symbol and n.layer = b.layer) where rn <= least({LOOP_K}, n))
, ret{d} AS (select {d} as day, symbol, layer, id, max(score) as score from top{d} group by 2, 3, 4)
, fed{d} AS (select s.* exclude (access_counter, importance, compound),
    case when f.feedback is not null and f.feedback <> 0 and not s.jumped then s.access_counter + f.feedback else s.access_counter end as access_counter,
    case when f.feedback is not null and f.feedback <> 0 and not s.jumped
         then s.importance + cast(s.access_counter + f.feedback as double) * 5.0 else s.importance end as importance
  from st{d} s left join (select c.symbol, c.id, fb.feedback from {cited} c join fb on fb.symbol = c.symbol and fb.day = {d}) f
    on f.symbol = s.symbol and f.id = s.id)
, aged{d} AS (select *, delta + 1 as delta1, exp(-(cast(delta + 1 as double) / {_case_sql('layer', 'recency_factor')})) as rec1,
    importance * {_case_sql('layer', 'importance_factor')} as imp1 from fed{d})
, live{d + 1} AS (select symbol, id, seq, sim, {final} as layer, imp1 as importance, case when {up} then 1.0 else rec1 end as recency,
    case when {up} then 0 else delta1 end as delta, {_compound_sql('rec1', 'imp1')} as compound, access_counter,
    jumped or {path} <> '' as jumped
  from aged{d} where not (rec1 < {_case_sql('layer', 'recency_threshold')} or imp1 < {_case_sql('layer', 'importance_threshold')}))"""
    rows = " union all ".join(f"select * from ret{d}" for d in range(LOOP_DAYS))
    return sql + f"""
select cast(day as int) as day, symbol, layer, id, round(score, 6) as score,
       row_number() over (partition by day, symbol, layer order by id) as pos from ({rows})"""


def loop_inputs(spark, sf_dir):
    """Records created on day id % LOOP_DAYS with their similarity to the symbol's profile; prices of the first days."""
    t = Tables(spark, sf_dir)
    prof = t.embeddings.groupBy(F.concat(F.lit("L"), F.col("label").cast("string")).alias("symbol")).agg(
        F.min_by("embedding", "vec_id").alias("_q"))
    mem = derive_memories(t).join(prof, "symbol").withColumns({
        "created": (F.col("id") % LOOP_DAYS).cast("int"), "sim": inner_product(F.col("embedding"), F.col("_q"))})
    order = Window.partitionBy("symbol").orderBy("date")
    p = t.prices.where(F.substring("symbol", 2, 10).cast("int") < 10)
    p = p.withColumn("day", (F.row_number().over(order) - 1).cast("int")).where(F.col("day") < LOOP_DAYS)
    return mem.drop("embedding", "_q"), p.select(F.concat(F.lit("L"), F.substring("symbol", 2, 10)).alias("symbol"), "day", "price")


@register("agent_replay", _loop_sql())
def q_agent_replay(spark, sf_dir):
    """P12 + I13: what every symbol retrieves on each of six days when feedback on a day's decisions changes the next days."""
    mem, prices = loop_inputs(spark, sf_dir)
    out = AL.replay(mem, prices, LOOP_DAYS, LOOP_K, LOOP_BACK).retrieved
    return out.select("day", "symbol", "layer", "id", r6("score").alias("score"), "pos")


_ROUTE_SQL = with_(MEMORIES, CITATIONS) + """
, c AS (select distinct symbol, date, cited_id, feedback from citations)
, r AS (select c.*, m.layer, row_number() over (partition by c.symbol, c.date, c.cited_id
            order by case m.layer when 'short' then 0 when 'mid' then 1 when 'long' then 2 else 3 end) as rn
        from c join memories m on c.symbol = m.symbol and c.cited_id = m.id)
"""


@register("feedback_routing", _ROUTE_SQL + """
select symbol, date, cited_id, feedback, layer from r where rn = 1""")
def q_feedback_routing(spark, sf_dir):
    t = Tables(spark, sf_dir)
    r = MM.route_feedback(derive_memories(t), derive_citations(t))
    return r.select("symbol", "date", "cited_id", "feedback", "layer")


@register("access_update", _ROUTE_SQL + f"""
, ev AS (select symbol, layer, cited_id as id, feedback, date,
                sum(feedback) over (partition by symbol, layer, cited_id order by date
                                    rows between unbounded preceding and current row) as cum_fb
         from r where rn = 1 and feedback <> 0)
, a AS (select symbol, layer, id, sum(feedback) as fb_total, sum(cum_fb) as cum_total, count(*) as n_ev
        from ev group by 1, 2, 3)
, mc AS (select *, {_compound_sql('recency', 'importance')} as compound from memories)
select m.symbol, m.id, m.layer,
       round(case when a.n_ev is not null then m.importance + cast(a.n_ev * m.access_counter + a.cum_total as double) * 5.0
                  else m.importance end, 6) as importance,
       round(m.recency, 6) as recency, m.delta,
       round(case when a.n_ev is not null then {_compound_sql('m.recency', '(m.importance + cast(a.n_ev * m.access_counter + a.cum_total as double) * 5.0)')}
                  else m.compound end, 6) as compound,
       cast(case when a.n_ev is not null then m.access_counter + a.fb_total else m.access_counter end as int)
         as access_counter,
       a.n_ev is not null as updated
from mc m left join a on m.symbol = a.symbol and m.layer = a.layer and m.id = a.id""")
def q_access_update(spark, sf_dir):
    t = Tables(spark, sf_dir)
    mem = _mem(spark, sf_dir)
    routed = MM.route_feedback(derive_memories(t), derive_citations(t))
    return _out(MM.apply_feedback(mem, routed), ["updated"])
