"""Exact vector retrieval over layered memory.

``vector_topk`` cuts the memories and the queries of a symbol into groups of a
bounded size, brings every (memory group, query group) of a symbol together by an
equi-join on (symbol, memory group, query group) and scores each such pair of groups
with numpy.  A pair of groups emits only the best ``top_k`` rows of each (query, layer)
under the total order (similarity desc, id asc); a final ``row_number() <= top_k``
keeps the global best.  No (query, memory) row is ever shuffled, a symbol holding
a third of the memories becomes many pairs of groups spread over all tasks, and
nothing is collected or broadcast by hand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.vectors import inner_product
from quantloom.operators.ordered import keep_first_n
from quantloom.operators.ranking import positions_in_groups

MEMORY_GROUP = 16_384      # memories of a symbol scored by one call
QUERY_GROUP = 4_096        # queries of a symbol scored by one call
SCORES_AT_ONCE = 1 << 22   # similarities held at a time, 32 MB

CANDIDATE_SCHEMA = ("qid long, symbol string, layer string, id long, seq long, compound double, "
                    "sim double")


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best similarities of every row, equal ones by the smaller id."""
    k = min(k, sims.shape[1])
    worst = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
    row, col = np.nonzero(sims >= worst[:, None])
    order = np.lexsort((ids[col], -sims[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _matrix(embeddings: pa.ChunkedArray) -> np.ndarray:
    values = embeddings.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(embeddings), -1)


def _score_groups(top_k: int):
    names = [c.split()[0] for c in CANDIDATE_SCHEMA.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(n, types[c.split()[1]]) for n, c in zip(names, CANDIDATE_SCHEMA.split(", "))])

    def run(mem: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if mem.num_rows and queries.num_rows:
            qids, qmat = queries.column("qid"), _matrix(queries.column("embedding"))
            for layer in mem.column("layer").unique().drop_null():
                g = mem.filter(pc.equal(mem.column("layer"), layer))
                mmat, ids = _matrix(g.column("embedding")).T, g.column("id").to_numpy()
                step = max(1, SCORES_AT_ONCE // g.num_rows)
                for lo in range(0, len(qmat), step):
                    sims = qmat[lo:lo + step] @ mmat
                    row, col = _best(sims, ids, top_k)
                    best = g.select(["symbol", "layer", "id", "seq", "compound"]).take(pa.array(col))
                    found.append(best.append_column("qid", qids.take(pa.array(lo + row)))
                                 .append_column("sim", pa.array(sims[row, col])).select(names).cast(schema))
        return pa.concat_tables(found) if found else schema.empty_table()
    return run


def _groups(rows: DataFrame, id_col: str, size: int, out: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their group number ``out`` (by hash of the id) and, per symbol, the number of groups ``_n``."""
    n = rows.groupBy("symbol").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("_n"))
    numbered = rows.join(n, "symbol").withColumn(out, F.expr(f"cast(pmod(xxhash64({id_col}), _n) as int)"))
    return numbered.drop("_n"), n


def vector_topk(memories: DataFrame, queries: DataFrame, top_k: int, memory_group: int = MEMORY_GROUP,
                query_group: int = QUERY_GROUP) -> DataFrame:
    """the ``top_k`` memories of each layer by inner product with each query.

    ``memories``: (symbol, layer, id, seq, compound, embedding);
    ``queries``: (qid, symbol, embedding).  k = min(top_k, rows of the layer).
    A memory is sent once per query group of its symbol, a query once per memory group.
    """
    if top_k <= 0:
        return memories.sparkSession.createDataFrame([], CANDIDATE_SCHEMA)
    mem = memories.where(F.col("embedding").isNotNull()).select("symbol", "layer", "id", "seq", "compound", "embedding")
    q = queries.where(F.col("embedding").isNotNull()).select("qid", "symbol", "embedding")
    mem, n_mem = _groups(mem, "id", memory_group, "_mg")
    q, n_q = _groups(q, "qid", query_group, "_qg")

    def every(n):
        return n.select("symbol", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_other"))

    keys = ["symbol", "_mg", "_qg"]
    mem = mem.join(every(n_q).withColumnRenamed("_other", "_qg"), "symbol")
    q = q.join(every(n_mem).withColumnRenamed("_other", "_mg"), "symbol")
    cand = mem.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(_score_groups(top_k), CANDIDATE_SCHEMA)
    return keep_first_n(cand, ["qid", "layer"], [F.col("sim").desc(), F.col("id").asc()], top_k)


def lowest_compound_k(memories: DataFrame, queries: DataFrame, top_k: int, lowest: bool = True) -> DataFrame:
    """per query and layer, the ``top_k`` rows of lowest compound score (ties by seq),
    with the similarity to the query recomputed.  ``lowest=False`` takes the highest
    instead (Q1: the reference's list is ascending, so it takes the lowest).

    The k rows per (symbol, layer) do not depend on the query, so they are
    chosen once (partial top-k before the shuffle) and then joined to the queries.
    """
    low = keep_first_n(memories.select("symbol", "layer", "id", "seq", "compound", "embedding"),
                       ["symbol", "layer"],
                       [F.col("compound").asc() if lowest else F.col("compound").desc(), F.col("seq").asc()], top_k)
    q = queries.select("qid", "symbol", F.col("embedding").alias("_q"))
    j = low.join(q, "symbol")
    return j.select("qid", "symbol", "layer", "id", "seq", "compound",
                    inner_product(F.col("embedding"), F.col("_q")).alias("sim"))


def hybrid_retrieval(memories: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """F4 + F5 (I3): bag union of F2 and F3, score = sim + compound, best k of the bag
    (a duplicate id takes a slot), k = min(top_k, rows of the layer), distinct ids in id order.

    Output: (qid, symbol, layer, id, score, pos) with ``pos`` the 1-based id order.
    """
    f2 = vector_topk(memories, queries, top_k).withColumn("_src", F.lit(0))
    f3 = lowest_compound_k(memories, queries, top_k).withColumn("_src", F.lit(1))
    bag = f2.unionByName(f3).withColumn("score", F.col("sim") + F.col("compound"))
    sizes = memories.groupBy("symbol", "layer").agg(F.count(F.lit(1)).alias("_n"))
    bag = bag.join(sizes, ["symbol", "layer"])
    w = Window.partitionBy("qid", "layer").orderBy(F.col("score").desc(), F.col("id").asc(), F.col("_src").asc())
    top = bag.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.least(F.lit(top_k), F.col("_n")))
    uniq = top.groupBy("qid", "symbol", "layer", "id").agg(F.max("score").alias("score"))
    wp = Window.partitionBy("qid", "layer").orderBy("id")
    return uniq.withColumn("pos", F.row_number().over(wp).cast("long"))


def score_ordered(memories: DataFrame) -> DataFrame:
    """the memory view ordered by (symbol, layer, compound, seq)."""
    return memories.orderBy("symbol", "layer", "compound", "seq")


def score_ranks(memories: DataFrame) -> DataFrame:
    """``rank`` of every record within (symbol, layer) by (compound, seq), by range partitions and prefix sums:
    a (symbol, layer) of any size is spread over all tasks."""
    return positions_in_groups(memories, ["symbol", "layer"], ["compound", "seq"], "rank")


def hybrid_of(rows: DataFrame, keys: list[str], top_k: int) -> DataFrame:
    """F4 + F5 over rows (keys, id, seq, compound, sim): per group the best ``top_k`` of the bag of the most similar and the
    lowest compound rows; (keys, id, score, pos)."""
    f2 = keep_first_n(rows, keys, [F.col("sim").desc(), F.col("id").asc()], top_k).withColumn("_src", F.lit(0))
    f3 = keep_first_n(rows, keys, [F.col("compound").asc(), F.col("seq").asc()], top_k).withColumn("_src", F.lit(1))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    bag = f2.unionByName(f3).withColumn("score", F.col("sim") + F.col("compound")).join(sizes, keys)
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc(), F.col("_src").asc())
    top = bag.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.least(F.lit(top_k), F.col("_n")))
    uniq = top.groupBy(*keys, "id").agg(F.max("score").alias("score"))
    return uniq.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("id")).cast("long"))


# ------------------------------------------------------------------ retrieval on every replay day

def memory_days(mem: DataFrame, horizon: int, created_col: str = "created", params=None) -> DataFrame:
    """The state of every record on every day it is alive, days ``created .. horizon``.

    A record created on day c is retrievable that day with its initial state,
    and on day c + k with its state after k memory steps (the replay ages the
    memory at the end of each day).  The fold is per record and the number of
    rows per record is bounded by its lifetime within the horizon.
    """
    from quantloom.operators import memory as MM
    params = params or MM.DEFAULT_PARAMS
    n = F.greatest(F.lit(horizon) - F.col(created_col), F.lit(0))
    traced = MM.memory_lifecycle(mem, n, None, params, trace=True)
    day0 = mem.select("symbol", "id", "seq", F.col(created_col).alias("day"), "layer", "compound")
    later = (traced.select("symbol", "id", "seq", F.col(created_col).alias("_c"), F.explode("trace").alias("t"))
             .where(F.col("t.alive"))
             .select("symbol", "id", "seq", (F.col("_c") + F.col("t.step")).alias("day"),
                     F.col("t.layer").alias("layer"), F.col("t.compound").alias("compound")))
    return day0.unionByName(later)


def retrieval_by_day(memories: DataFrame, profile_queries: DataFrame, top_k: int, horizon: int,
                     created_col: str = "created", params=None) -> DataFrame:
    """F5 on every replay day with that day's memory state (P12 / S2 without self-feedback).

    ``profile_queries`` = (symbol, embedding), one query per symbol (the agent's
    profile text embeds to the same vector every day), so each record's
    similarity is computed once; per (symbol, day, layer) the top-k by
    similarity and the k lowest compound scores are merged as in ``hybrid_retrieval``.
    Output: (symbol, day, layer, id, score, pos).
    """
    from quantloom.session import cut_lineage
    q = profile_queries.select("symbol", F.col("embedding").alias("_q"))
    sims = memories.join(q, "symbol").select("symbol", "id", inner_product(F.col("embedding"), F.col("_q")).alias("sim"))
    rows = cut_lineage(memory_days(memories, horizon, created_col, params).join(sims, ["symbol", "id"]), "memory_days")
    return hybrid_of(rows, ["symbol", "day", "layer"], top_k)
