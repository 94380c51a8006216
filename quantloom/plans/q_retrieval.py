"""Registered queries: vector helpers, embedder and exact retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.numeric import r6
from quantloom.functions.vectors import hash_embed_long, inner_product, l2_normalize
from quantloom.operators import memory as MM
from quantloom.operators import retrieval as R
from quantloom.plans.fixtures_sql import MEMORIES, with_
from quantloom.plans.registry import register
from quantloom.sources.tables import Tables, derive_memories

TOP_K = 3  # fixed value: retrieval depth of the reference configuration


def _inputs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    mem = MM.with_compound(derive_memories(t))
    q = t.embeddings.select(F.col("vec_id").alias("qid"),
                            F.concat(F.lit("L"), F.col("label").cast("string")).alias("symbol"), "embedding")
    return mem, q


_BASE = with_(MEMORIES) + """
, mem AS (select *, recency + least(importance, 100.0) / 100.0 as compound from memories)
, q AS (select vec_id as qid, concat('L', cast(label as varchar)) as symbol, embedding as qv from embeddings)
, pairs AS (select q.qid, m.symbol, m.layer, m.id, m.seq, m.compound,
                   list_inner_product(cast(m.embedding as double[]), cast(q.qv as double[])) as sim
            from q join mem m on m.symbol = q.symbol)
, f2 AS (select * exclude (rn) from (select *, row_number() over (partition by qid, layer order by sim desc, id) as rn
                                     from pairs) where rn <= 3)
, low AS (select * exclude (rn) from (select *, row_number() over (partition by symbol, layer order by compound, seq) as rn
                                      from mem) where rn <= 3)
, f3 AS (select q.qid, l.symbol, l.layer, l.id, l.seq, l.compound,
                list_inner_product(cast(l.embedding as double[]), cast(q.qv as double[])) as sim
         from q join low l on l.symbol = q.symbol)
"""


@register("vector_topk", _BASE + """
select qid, symbol, layer, id, round(sim, 6) as sim from f2""")
def q_vector_topk(spark, sf_dir):
    mem, q = _inputs(spark, sf_dir)
    out = R.vector_topk(mem, q, TOP_K)
    return out.select("qid", "symbol", "layer", "id", r6("sim").alias("sim"))


@register("lowest_compound_k", _BASE + """
select qid, symbol, layer, id, round(compound, 6) as compound, round(sim, 6) as sim from f3""")
def q_lowest_compound_k(spark, sf_dir):
    mem, q = _inputs(spark, sf_dir)
    out = R.lowest_compound_k(mem, q, TOP_K)
    return out.select("qid", "symbol", "layer", "id", r6("compound").alias("compound"), r6("sim").alias("sim"))


@register("hybrid_retrieval", _BASE + """
, n AS (select symbol, layer, count(*) as n from mem group by 1, 2)
, bag AS (select qid, symbol, layer, id, sim + compound as score, 0 as src from f2
          union all select qid, symbol, layer, id, sim + compound, 1 from f3)
, top AS (select b.* from (select bag.*, n.n, row_number() over (partition by qid, bag.layer
                                   order by score desc, id, src) as rn
                           from bag join n on bag.symbol = n.symbol and bag.layer = n.layer) b
          where rn <= least(3, n))
, u AS (select qid, symbol, layer, id, max(score) as score from top group by 1, 2, 3, 4)
select qid, symbol, layer, id, round(score, 6) as score,
       row_number() over (partition by qid, layer order by id) as pos from u""")
def q_hybrid_retrieval(spark, sf_dir):
    mem, q = _inputs(spark, sf_dir)
    out = R.hybrid_retrieval(mem, q, TOP_K)
    return out.select("qid", "symbol", "layer", "id", r6("score").alias("score"), "pos")


@register("inner_product", """
select a.vec_id as id_a, b.vec_id as id_b,
       round(list_inner_product(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as dot
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def q_inner_product(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    a = e.select(F.col("vec_id").alias("id_a"), F.col("embedding").alias("va"))
    b = e.select(F.col("vec_id").alias("id_b"), F.col("embedding").alias("vb"))
    j = a.join(b, F.col("id_b") == F.col("id_a") + 1)
    return j.select("id_a", "id_b", r6(inner_product(F.col("va"), F.col("vb"))).alias("dot"))


@register("l2_normalize", """
select vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) as norm2, round(v[1], 6) as first
from (select vec_id, list_transform(cast(embedding as double[]),
                                    lambda x: x * 3.0 / sqrt(list_sum(list_transform(cast(embedding as double[]), lambda y: y * y * 9.0))))
             as v from embeddings)""")
def q_l2_normalize(spark, sf_dir):
    """H26 on scaled vectors (3 x stored unit vector): the norm comes back to 1."""
    e = Tables(spark, sf_dir).embeddings
    v = l2_normalize(F.transform("embedding", lambda x: x.cast("double") * F.lit(3.0)))
    n = e.select("vec_id", v.alias("v"))
    return n.select("vec_id", r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2"),
                    r6(F.col("v")[0]).alias("first"))


@register("chunk_mean_embedding", r"""
WITH t AS (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') as toks
           from documents)
, e AS (select doc_id, unnest(toks) as tok, unnest(range(len(toks))) as pos from t)
, h AS (select doc_id, cast(floor(pos / 256) as int) as chunk, md5(tok) as m from e)
, b AS (select doc_id, chunk,
               cast(cast(concat('0x', substring(m, 1, 8)) as bigint) % 64 as int) as dim_idx,
               case when cast(concat('0x', substring(m, 9, 1)) as int) % 2 = 0 then 1.0 else -1.0 end as s from h)
, cv AS (select doc_id, chunk, dim_idx, sum(s) as v from b group by 1, 2, 3)
, nr AS (select doc_id, chunk, sqrt(sum(v * v)) as norm from cv group by 1, 2)
, nc AS (select doc_id, count(distinct chunk) as n_chunks from b group by 1)
, p AS (select cv.doc_id, cv.dim_idx, sum(cv.v / nr.norm) as s from cv join nr using (doc_id, chunk)
        where nr.norm > 0 group by 1, 2)
select p.doc_id, p.dim_idx, round(p.s / nc.n_chunks, 6) as value from p join nc using (doc_id)
where p.s / nc.n_chunks <> 0""")
def q_chunk_mean_embedding(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", "text")
    out = hash_embed_long(d, "doc_id", "text", dim=64, chunk_tokens=256)
    return out.select("doc_id", "dim_idx", r6("value").alias("value"))


REPLAY_DAYS = 30  # the replay horizon in days; records are created on day vec_id % 30


def _replay_sql() -> str:
    from quantloom.plans.q_memory import _case_sql, _compound_sql, _jump_sql
    final, up, path = _jump_sql("layer", "imp1")
    step = f"""
  select symbol, id, seq, created, k + 1 as k,
         case when alive1 then {final} else layer end as layer, imp1 as importance,
         case when alive1 and {up} then 1.0 else rec1 end as recency,
         case when alive1 and {up} then 0 else delta1 end as delta,
         {_compound_sql('rec1', 'imp1')} as compound, alive1 as alive
  from (select *, not (rec1 < {_case_sql('layer', 'recency_threshold')}
                       or imp1 < {_case_sql('layer', 'importance_threshold')}) as alive1
        from (select *, delta + 1 as delta1,
                     exp(-(cast(delta + 1 as double) / {_case_sql('layer', 'recency_factor')})) as rec1,
                     importance * {_case_sql('layer', 'importance_factor')} as imp1
              from st where alive and k < {REPLAY_DAYS} - created) a) b"""
    return with_(MEMORIES).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, mem AS (select *, {_compound_sql('recency', 'importance')} as compound, cast(id % {REPLAY_DAYS} as int) as created
          from memories)
, st AS (select symbol, id, seq, created, 0 as k, layer, importance, recency, delta, compound, true as alive from mem
         union all {step})
, q AS (select concat('L', cast(label as varchar)) as symbol, arg_min(embedding, vec_id) as qv
        from embeddings group by label)
, sims AS (select m.symbol, m.id, list_inner_product(cast(m.embedding as double[]), cast(q.qv as double[])) as sim
           from mem m join q on q.symbol = m.symbol)
, rows_ AS (select s.symbol, s.id, s.seq, s.created + s.k as day, s.layer, s.compound, x.sim
            from st s join sims x on x.symbol = s.symbol and x.id = s.id where s.alive)
, f2 AS (select * exclude (rn) from (select *, row_number() over (partition by symbol, day, layer
            order by sim desc, id) as rn from rows_) where rn <= {TOP_K})
, f3 AS (select * exclude (rn) from (select *, row_number() over (partition by symbol, day, layer
            order by compound, seq) as rn from rows_) where rn <= {TOP_K})
, n AS (select symbol, day, layer, count(*) as n from rows_ group by 1, 2, 3)
, bag AS (select symbol, day, layer, id, sim + compound as score, 0 as src from f2
          union all select symbol, day, layer, id, sim + compound, 1 from f3)
, top AS (select b.* from (select bag.*, n.n, row_number() over (partition by bag.symbol, bag.day, bag.layer
                                   order by score desc, id, src) as rn
                           from bag join n on bag.symbol = n.symbol and bag.day = n.day and bag.layer = n.layer) b
          where rn <= least({TOP_K}, n))
, u AS (select symbol, day, layer, id, max(score) as score from top group by 1, 2, 3, 4)
select symbol, date '2024-01-01' + day as day, layer, id, round(score, 6) as score,
       row_number() over (partition by symbol, day, layer order by id) as pos from u"""


@register("retrieval_by_day", _replay_sql())
def q_retrieval_by_day(spark, sf_dir):
    """F5 on each of 30 replay days with the memory state of that day (records created on day id % 30)."""
    t = Tables(spark, sf_dir)
    mem = MM.with_compound(derive_memories(t)).withColumn("created", (F.col("id") % REPLAY_DAYS).cast("int"))
    prof = t.embeddings.groupBy(F.concat(F.lit("L"), F.col("label").cast("string")).alias("symbol")).agg(
        F.min_by("embedding", "vec_id").alias("embedding"))
    out = R.retrieval_by_day(mem, prof, TOP_K, REPLAY_DAYS)
    return out.select("symbol", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).alias("day"), "layer", "id",
                      r6("score").alias("score"), "pos")
