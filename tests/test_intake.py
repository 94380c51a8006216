"""Texts to memory records (I1, K1): user models, lists, ids; distributed positions."""
import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions.embed import HashingEmbedder, chunks, embed_texts, mean_of_chunks
from quantloom.functions.vectors import hash_embed_long, l2_normalize, to_vector
from quantloom.operators import intake as I
from quantloom.operators import retrieval as R
from quantloom.operators.ranking import global_positions, positions_in_groups

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # workers cannot import this file


class CountingModel:
    """Two numbers per text: its length and its number of a's."""
    loads = 0

    def __init__(self):
        CountingModel.loads += 1

    def __call__(self, texts):
        return np.array([[len(t), t.count("a")] for t in texts], dtype="float32")


ITEMS = "symbol string, date date, key long, source_type string, text array<string>, note string"


def items(spark, rows):
    return spark.createDataFrame(rows, ITEMS).selectExpr("symbol", "date", "key", "source_type", "text", "note")


def day(n):
    import datetime
    return datetime.date(2024, 1, n)


def test_user_model_records(spark):
    rows = [("B", day(2), 1, "10-K", ["aaa"], "x"), ("A", day(1), 7, "news", ["banana split", None, "a a"], "y"),
            ("A", day(1), 8, "reflection", [], "z"), ("A", day(1), 9, "10-Q", None, "z")]
    got = I.add_memory(items(spark, rows), CountingModel, dim=2, first_id=100).orderBy("id").collect()
    assert [(r.id, r.symbol, r.layer, r.text) for r in got] == [
        (100, "A", "short", "banana split"), (101, "A", "short", None), (102, "A", "short", "a a"), (103, "B", "long", "aaa")]
    assert got[0].embedding == pytest.approx(np.array([12, 3]) / np.hypot(12, 3))
    assert got[1].embedding == [0.0, 0.0]
    assert all(r.recency == 1.0 and r.delta == 0 and r.access_counter == 0 for r in got)
    assert all(r.compound == pytest.approx(1 + r.importance / 100) for r in got)
    assert CountingModel.loads == 0          # loaded in the tasks only


def test_one_text_is_a_list_of_one(spark):
    rows = [("A", day(1), 7, "news", ["banana"], "y")]
    one = I.add_memory(items(spark, rows).withColumn("text", F.col("text")[0]), CountingModel, dim=2).collect()
    assert one == I.add_memory(items(spark, rows), CountingModel, dim=2).collect()


def test_wrong_shapes_and_sources_stop_the_job(spark):
    rows = items(spark, [("A", day(1), 7, "news", ["banana"], "y")])
    with pytest.raises(Exception, match="expected"):
        I.add_memory(rows, CountingModel, dim=3).collect()
    with pytest.raises(Exception, match="invalid memory layer"):
        I.add_memory(rows.withColumn("layer", F.lit("attic")), CountingModel, dim=2).collect()
    with pytest.raises(ValueError, match="initialization"):
        I.add_memory(rows, CountingModel, dim=2, importance="guess")


def test_default_model_equals_the_relational_embedder(spark):
    texts = [(1, "one two  three"), (2, " ".join(f"w{k % 37}" for k in range(40))), (3, "Tab\tand\nline"), (4, "x")]
    df = spark.createDataFrame(texts, "id long, text string")
    rel = {r.id: r.embedding for r in to_vector(hash_embed_long(df, "id", "text", 64, 8), "id").collect()}
    got = {r.id: r.embedding for r in embed_texts(df, chunk_tokens=8).collect()}
    for k, v in rel.items():
        assert got[k] == pytest.approx(v)


def test_relational_embedder_deals_more_parts_for_more_text(spark, monkeypatch):
    monkeypatch.setattr("quantloom.functions.vectors.PART_CHARS", 100)
    rows = [(k % 30, " ".join(f"w{k * j % 11}" for j in range(9))) for k in range(60)] + [(None, "x y"), (31, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    chars = sum(len(t) for k, t in rows if k is not None and t)
    few, many = (hash_embed_long(df.unionByName(df) if twice else df, "id", "text", 8, 4) for twice in (False, True))
    for out, n in ((few, chars), (many, 2 * chars)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"hashpartitioning\(id#\d+L?, {n // 100 + 2}\)", plan), plan
    # a repeated row doubles every sum of its chunks, so the unit vectors stay
    a, b = ({(r.id, r.dim_idx): r.value for r in x.collect()} for x in (few, many))
    assert a and a == pytest.approx(b)


def test_chunks_cover_the_whole_text():
    text = "  ".join(f"w{k}" for k in range(25))
    assert chunks(text, 25) == [text] and len(chunks(text, 10)) == 3 and chunks("", 3) == [""]
    whole = mean_of_chunks(HashingEmbedder(16), [text, ""], 16, 10)
    parts = HashingEmbedder(16)([" ".join(f"w{k}" for k in range(a, min(25, a + 10))) for a in (0, 10, 20)])
    assert whole[0] == pytest.approx(parts.mean(axis=0)) and not whole[1].any()


def test_embedder_gives_the_slots_of_md5():
    import hashlib
    text = "Rates\u00a0rise \tnow\x0b\x0c\r\nnow  \u2028\x1cx \ud800 na\u00efve " + " ".join(f"w{k % 90}" for k in range(400))
    want = np.zeros(8)
    for token in re.split("[ \t\n\x0b\f\r]+", text.lower()):
        h = hashlib.md5(token.encode("utf-8", "surrogatepass")).hexdigest()
        want[int(h[:8], 16) % 8] += 1.0 if int(h[8], 16) % 2 == 0 else -1.0
    model = HashingEmbedder(8)
    got = model([text, "", text])
    assert (got[0] == want / np.sqrt((want * want).sum())).all() and (got[2] == got[0]).all() and not got[1].any()


def test_norm_is_computed_once_per_vector(spark):
    """A norm inside the lambda would be summed again for every element."""
    rows = spark.createDataFrame([([3.0, 4.0] * 32,), ([0.0, 0.0],), ([1.0, None],), ([],), (None,)], "v array<double>")
    got = [r.v for r in rows.select(l2_normalize(F.col("v")).alias("v")).collect()]
    norm = np.sqrt(25.0 * 32)
    assert got == [[3.0 / norm, 4.0 / norm] * 32, [0.0, 0.0], [1.0, None], [], None]
    plan = rows.select(l2_normalize(F.col("v")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1, plan


def test_retrieval_over_added_records(spark):
    rows = [("A", day(1), k, "news", [t], "") for k, t in enumerate(
        ["rates rise again", "rates fall", "new phone launch", "bank rates rise", "weather is fine"])]
    mem = I.add_memory(items(spark, rows))
    ask = embed_texts(spark.createDataFrame([(1, "A", "rates rise")], "qid long, symbol string, text string"))
    top = R.vector_topk(mem, ask.select("qid", "symbol", "embedding"), 2).collect()
    assert sorted(r.id for r in top) == [0, 3]


def test_positions_equal_the_window(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 7 > 0, F.lit("b")).alias("g"),
        (F.col("id") * 37 % 101).alias("x"), "id")
    got = positions_in_groups(df, ["g"], ["x", "id"])
    w = Window.partitionBy("g").orderBy("x", "id")
    both = got.withColumn("w", F.row_number().over(w))
    assert both.count() == 3000 and both.where("position <> w").count() == 0
    assert [r.position for r in global_positions(df, ["x", "id"], partitions=5).orderBy("x", "id").collect()] == list(range(1, 3001))
    assert global_positions(df.limit(0), ["id"]).count() == 0


def test_score_ranks_plan_has_no_window(spark):
    mem = spark.createDataFrame([("A", "short", 1, 0.5, 1)], "symbol string, layer string, id long, compound double, seq long")
    plan = R.score_ranks(mem)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
