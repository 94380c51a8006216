"""User-level compositions: the reference's scripts as single calls over every symbol.

Each function only chains operators; the registered queries exercise the same
chains on the shared tables.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import calendar as C
from quantloom.operators import decisions as D
from quantloom.operators import environment as V
from quantloom.operators import metrics as M
from quantloom.operators import news as N
from quantloom.operators import retrieval as R
from quantloom.operators import textops as X
from quantloom.session import cut_lineage
from quantloom.sources import io as IO


def clean_news(raw: DataFrame, calendar: DataFrame | None = None, capped: bool = True) -> DataFrame:
    """Dedup, clean, similarity passes, then the trading-day roll (capped C6 or open C5)."""
    clean = N.clean_news(raw)
    if calendar is None:
        return clean
    roll = C.next_trading_day_capped if capped else C.next_trading_day
    return roll(clean, calendar, "date")


def environment(prices: DataFrame, news: DataFrame, filings: DataFrame, aligned: bool = True) -> DataFrame:
    """P4 (aligned on priced days) or P5 (outer over every source's dates)."""
    items = V.news_items(news)
    if aligned:
        return V.env_aligned(prices, items, filings)
    return V.env_outer(prices, items, filings)


def sentiment_enrichment(news_items: DataFrame, lexicon: DataFrame, key: str = "seq") -> DataFrame:
    """Lexicon shares per item and the sentences appended to its text."""
    s = X.lexicon_sentiment(news_items, key, lexicon)
    j = news_items.join(s, key)
    return j.withColumn("text", X.sentiment_append(F.col("text"), F.col("pos"), F.col("neu"), F.col("neg")))


def backtest(prices: DataFrame, actions: DataFrame) -> dict:
    """Metric report, cumulative-return table and pairwise significance."""
    rewards = M.daily_rewards(prices, actions)
    series = M.cumulative_rewards(rewards, leading_zero=False)
    return {
        "report": M.backtest_report(prices, actions),
        "cumulative": M.cumulative_rewards(M.daily_rewards(prices, M.with_buy_and_hold(prices, actions))),
        "significance": M.with_pvalue(M.wilcoxon_stat(M.model_pairs(series))),
    }


def decision_batch(memories: DataFrame, queries: DataFrame, steps: DataFrame, texts: DataFrame,
                   top_k: int = 3, decide: Callable[[pd.Series], pd.Series] | None = None,
                   mode: str = "test") -> DataFrame:
    """Retrieve (F5), budget (E13), pad and render (H24, H23), decide (K4), parse (H25), act.

    ``texts`` = (id, text) of the memories; ``steps`` = (qid, symbol, date, momentum[, record]).
    """
    hits = cut_lineage(R.hybrid_retrieval(memories, queries, top_k), "hits")
    items = D.budgeted_hits(hits, texts)
    prompts = D.render_prompt(D.memory_blocks(items), steps, mode=mode)
    responses = D.default_decision(prompts) if decide is None else D.decision_hook(prompts, decide)
    parsed = D.parse_decision(responses, mode)
    from quantloom.operators.portfolio import test_direction
    return parsed.withColumn("direction", test_direction(F.col("investment_decision")))


def export_decisions(actions: DataFrame, decisions: DataFrame, out_dir: str) -> DataFrame:
    """Actions, legacy decisions and back-test decisions as CSV per symbol;
    returns the symbols skipped for lack of test-mode decisions."""
    out = D.decision_export(actions, decisions)
    IO.write_csv(out["actions"], os.path.join(out_dir, "actions"), partition_by="symbol")
    IO.write_csv(out["legacy"], os.path.join(out_dir, "decisions"), partition_by="symbol")
    bt = out["backtest"].withColumn("file_name", D.backtest_file_name(F.col("stock"), F.col("first_date"),
                                                                      F.col("last_date")))
    IO.write_csv(bt.select("stock", "test_date", "decision", "file_name"), os.path.join(out_dir, "backtest"),
                 partition_by="file_name")
    return out["skipped"]


def decision_replay(memories: DataFrame, profile_queries: DataFrame, texts: DataFrame, steps: DataFrame,
                    horizon: int, top_k: int = 3, decide: Callable[[pd.Series], pd.Series] | None = None,
                    created_col: str = "created", mode: str = "test") -> DataFrame:
    """P12 on every replay day: retrieval with that day's memory state, then budget, prompt,
    decision and parse per (symbol, day).  ``steps`` = (symbol, day, date, momentum[, record])."""
    keys = ["symbol", "day"]
    hits = cut_lineage(R.retrieval_by_day(memories, profile_queries, top_k, horizon, created_col), "day_hits")
    items = D.budgeted_hits(hits, texts, keys)
    prompts = D.render_prompt(D.memory_blocks(items, keys), steps, keys, mode=mode)
    responses = D.default_decision(prompts) if decide is None else D.decision_hook(prompts, decide)
    from quantloom.operators.portfolio import test_direction
    parsed = D.parse_decision(responses, mode)
    return parsed.withColumn("direction", test_direction(F.col("investment_decision")))
