"""Plan-shape checks: the physical plans are the ones the scale design relies on."""
import pytest

import __spark_entry__ as E
from small_data import SF_SMALL

# Queries that run a job while building their plan (streams, sinks); their plans are checked elsewhere.
EAGER = {"memory_stream", "portfolio_stream", "csv_roundtrip", "parquet_partitioned", "state_checkpoint",
         "env_sink_roundtrip"}


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in E.queries() if n not in EAGER))
def test_no_pairwise_joins(spark, name):
    p = plan_text(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, p


def test_dedup_limits_before_the_shuffle(spark):
    df = E.queries()["dedup_keep_first"](spark, SF_SMALL)
    s = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in s and "Partial" in s


def test_date_range_reaches_the_scan(spark):
    """The window is applied to the derived prices before staging: it reaches the orders scan."""
    from quantloom.operators.metrics import restrict_dates
    from quantloom.sources.tables import Tables, derive_prices
    df = restrict_dates(derive_prices(Tables(spark, SF_SMALL)), "1996-01-01", "1997-01-01")
    s = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in s and "LessThan(o_orderdate" in s


def test_vector_topk_meets_by_group(spark):
    df = E.queries()["vector_topk"](spark, SF_SMALL)
    s = df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in s and "WindowGroupLimit" in s
    keys = [x for x in s.splitlines() if "hashpartitioning(symbol" in x and "_mg" in x and "_qg" in x]
    assert len(keys) == 2, s


def test_replay_windows_hold_no_texts(spark):
    s = plan_text(E.queries()["replay_rows"](spark, SF_SMALL))
    windows = [x for x in s.splitlines() if " Window [" in x or "+- Window [" in x]
    assert windows and not any("news" in x or "filing" in x for x in windows)


def test_chunk_embedding_reads_and_deals_texts_once(spark):
    s = plan_text(E.queries()["chunk_mean_embedding"](spark, SF_SMALL))
    assert s.count("FileScan") == 1 and s.count("Exchange hashpartitioning") == 1, s


@pytest.mark.parametrize("name", ["dedup_keep_first", "hybrid_retrieval", "memory_lifecycle", "env_outer",
                                  "lexicon_sentiment", "next_trading_day"])
def test_partition_count_invariance(spark, name):
    q = E.queries()[name]
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    a = sorted(tuple(r) for r in q(spark, SF_SMALL).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    b = sorted(tuple(r) for r in q(spark, SF_SMALL).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b
