"""Decision preparation, parsing and export.

Prompt assembly works on bounded groups only: the retrieved memories of one
(query, layer) are at most ``top_k`` rows (+2 placeholders), and a prompt
has four layer blocks.  The decision function is a user hook applied with
``mapInPandas``; the default is a deterministic momentum rule.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Per-layer token budgets of the reference configuration.
TOKEN_BUDGETS = {"short": 300, "mid": 80, "long": 80, "reflection": 50}
# Layer order, block titles and placeholder texts of the prompt.
LAYER_ORDER = ("short", "mid", "long", "reflection")
LAYER_TITLE = {"short": "short-term", "mid": "mid-term", "long": "long-term", "reflection": "reflection-term"}
LAYER_INDEX_KEY = {"short": "short_memory_index", "mid": "middle_memory_index",
                   "long": "long_memory_index", "reflection": "reflection_memory_index"}
PLACEHOLDER_ID = -1
# Prompt texts.
TEST_PREFIX = "The ticker of the stock to be analyzed is {symbol} and the current date is {cur_date}"
TRAIN_PREFIX = ("The current date is {cur_date}. Here are the observed financial market facts: for {symbol}, "
                "the price difference between the next trading day and the current trading day is: {future_record}\n\n")
SENTIMENT_EXPLANATION = """For example, positive news about a company can lift investor sentiment, encouraging more buying activity which in turn can push stock prices higher. 
        Conversely, negative news can dampen investor sentiment, leading to selling pressure and a decrease in stock prices.
        News about competitors can also have a ripple effect on a company's stock price. 
        For instance, if a competitor announces a groundbreaking new product, other companies in the industry might see their stock prices fall as investors anticipate a loss of market share. The positive score, neutral score and negative score are sentiment score.
        Sentiment score involves evaluating and interpreting subjective information in text data to understand the sentiments, opinions, or emotions expressed.
        The positive score, neutral score, and negative scores are ratios for proportions of text that fall in each category (so these should all add up to be 1).
        These are the most useful metrics if you want to analyze the context & presentation of how sentiment is conveyed or embedded in rhetoric for a given sentence.
"""
MOMENTUM_EXPLANATION = """The information below provides a summary of stock price fluctuations over the previous few days, which is the "Momentum" of a stock.
        It reflects the trend of a stock.
        Momentum is based on the idea that securities that have performed well in the past will continue to perform well, and conversely, securities that have performed poorly will continue to perform poorly.
        """
MOMENTUM_SENTENCE = {-1: "The cumulative return of past 3 days for this stock is negative.",
                     0: "The cumulative return of past 3 days for this stock is zero.",
                     1: "The cumulative return of past 3 days for this stock is positive."}
DECISIONS = ("buy", "sell", "hold")


def word_tokens(text: Column) -> Column:
    """K6 default tokeniser for budgets: whitespace tokens, case kept."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\f\u000b")), r"\s+")


def token_count_hook(count_fn: Callable[[str], int]):
    """K6 hook: an Arrow UDF counting tokens with a user tokeniser (e.g. a BPE encoder).

    Use it for the budget counts in place of ``word_count``; the default stays JVM-side.
    """
    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: 0 if t is None else int(count_fn(t))).astype("int32")
    return count


def word_count(text: Column) -> Column:
    """Number of whitespace tokens, counted without building the token array."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def budget_plan(items: DataFrame, keys, order_col: str, budget: Column, count_col: str) -> DataFrame:
    """E13 on token counts only: which rows survive and how many tokens each keeps.

    Rows are kept while the running count fits the budget; the first row that
    overflows keeps the remaining tokens (``cut``); the rest are dropped.
    Texts are not needed here, so they stay out of the window's shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(order_col)
    d = items.withColumn("_prior", F.coalesce(F.sum(count_col).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                              F.lit(0)))
    d = d.withColumn("_budget", budget)
    full = F.col("_prior") + F.col(count_col) <= F.col("_budget")
    cut = ~full & (F.col("_prior") < F.col("_budget"))
    d = d.where(full | cut)
    return (d.withColumn("cut", ~full)
             .withColumn("n_tokens", F.when(full, F.col(count_col)).otherwise(F.col("_budget") - F.col("_prior"))
                         .cast("int"))
             .drop("_prior", "_budget"))


def apply_budget(plan: DataFrame, text_col: str = "text") -> DataFrame:
    """Cut the texts marked by ``budget_plan`` (only those rows are split into tokens)."""
    cut_text = F.array_join(F.slice(word_tokens(F.col(text_col)), 1, F.col("n_tokens")), " ")
    return plan.withColumn(text_col, F.when(F.col("cut"), cut_text).otherwise(F.col(text_col))).drop("cut")


def token_budget(items: DataFrame, keys, order_col: str, budget: Column, text_col: str = "text") -> DataFrame:
    """E13 on rows that carry their text (counts with ``regexp_count``)."""
    d = items.withColumn("_n", word_count(F.col(text_col)))
    return apply_budget(budget_plan(d, keys, order_col, budget, "_n"), text_col).drop("_n")


def budgeted_hits(hits: DataFrame, texts: DataFrame, keys=("qid",)) -> DataFrame:
    """E13 on retrieval hits: the texts of the hits only are read and counted, once, and cut to their layer's budget.

    ``hits`` = (keys..., layer, id, pos); ``texts`` = (id, text).
    """
    from quantloom.session import cut_lineage
    wanted = texts.select("id", "text").join(hits.select("id").distinct(), "id", "left_semi")
    wanted = cut_lineage(wanted.withColumn("_n", word_count(F.col("text"))), "hit_texts")    # joined twice below
    plan = budget_plan(hits.join(wanted.select("id", "_n"), "id"), [*keys, "layer"], "pos",
                       layer_budget(F.col("layer")), "_n")
    return apply_budget(plan.join(wanted.select("id", "text"), "id"), "text").drop("_n")


def layer_budget(layer: Column, budgets=TOKEN_BUDGETS) -> Column:
    out = None
    for k, v in budgets.items():
        out = F.when(layer == k, F.lit(v)) if out is None else out.when(layer == k, F.lit(v))
    return out


def memory_blocks(items: DataFrame, keys=("qid",), order_col: str = "pos") -> DataFrame:
    """H24 + H23: per (keys, layer) the ordered (id, text) list with placeholder padding
    (none -> two placeholder rows of id -1, one -> duplicated), rendered as a block.

    ``items`` = (keys..., layer, id, text, pos) for the retrieved memories;
    layers without any row still get their placeholder block.
    Output: (keys..., layer, ids array<long>, block string).
    """
    keys = list(keys)
    got = items.groupBy(*keys, "layer").agg(
        F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col("id").cast("long").alias("id"),
                                             F.col("text").alias("text")))).alias("_l"))
    # the layers of a key come from its own groups: a few lists bounded by the retrieval depth
    per = got.groupBy(*keys).agg(F.map_from_entries(F.collect_list(
        F.when(F.col("layer").isNotNull(), F.struct("layer", "_l")))).alias("_m"))
    layers = F.array(*[F.lit(x) for x in LAYER_ORDER])
    g = per.select(*keys, "_m", F.explode(layers).alias("layer")).withColumn(
        "_l", F.try_element_at("_m", F.col("layer")))
    title = F.lit(None).cast("string")
    for k, v in LAYER_TITLE.items():
        title = F.when(F.col("layer") == k, F.lit(v)).otherwise(title)
    placeholder = F.struct(F.lit(0).alias("o"), F.lit(PLACEHOLDER_ID).cast("long").alias("id"),
                           F.concat(F.lit("No "), title, F.lit(" information.")).alias("text"))
    n = F.coalesce(F.size("_l"), F.lit(0))
    lst = (F.when((n <= 0) | F.col("_l").isNull(), F.array(placeholder, placeholder))
           .when(n == 1, F.concat(F.col("_l"), F.col("_l"))).otherwise(F.col("_l")))
    g = g.withColumn("_l", lst)
    lines = F.transform("_l", lambda x: F.concat(x["id"].cast("string"), F.lit(". "),
                                                 F.regexp_replace(x["text"], r"^\s+|\s+$", "")))
    block = F.concat(F.lit("The "), title, F.lit(" information:\n"), F.array_join(lines, "\n"))
    return g.select(*keys, "layer", F.transform("_l", lambda x: x["id"]).alias("ids"), block.alias("block"))


def render_prompt(blocks: DataFrame, steps: DataFrame, keys=("qid",), mode: str = "test") -> DataFrame:
    """H23 + H22: one prompt per step from its four blocks.

    ``steps`` = (keys..., symbol, date, momentum[, record]).  The short block
    carries the sentiment explanation in test mode; a momentum of 0 or NULL
    adds nothing (the reference tests its truthiness).
    """
    keys = list(keys)
    sent = F.lit(SENTIMENT_EXPLANATION) if mode == "test" else F.lit("")
    b = blocks.withColumn("_txt", F.concat(F.col("block"), F.when(F.col("layer") == "short", sent).otherwise(F.lit("")),
                                           F.lit("\n\n")))
    order = F.when(F.col("layer") == "short", 0).when(F.col("layer") == "mid", 1).when(
        F.col("layer") == "long", 2).otherwise(3)
    b = b.withColumn("_o", order)
    per = b.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_txt"))), lambda x: x["_txt"]), "")
        .alias("_body"),
        F.map_from_entries(F.collect_list(F.struct("layer", "ids"))).alias("offered_ids"))
    s = steps.join(per, keys)
    d = F.date_format("date", "yyyy-MM-dd")
    if mode == "test":
        prefix = F.format_string(TEST_PREFIX.replace("{symbol}", "%s").replace("{cur_date}", "%s"), "symbol", d)
        mom = F.when(F.col("momentum") == 1, F.lit(MOMENTUM_SENTENCE[1])).when(
            F.col("momentum") == -1, F.lit(MOMENTUM_SENTENCE[-1]))
        tail = F.when(mom.isNotNull(), F.concat(F.lit(MOMENTUM_EXPLANATION), mom)).otherwise(F.lit(""))
    else:
        prefix = F.format_string(TRAIN_PREFIX.replace("{cur_date}", "%2$s").replace("{symbol}", "%1$s")
                                 .replace("{future_record}", "%3$s"), "symbol", d, F.col("record").cast("string"))
        tail = F.lit("")
    return s.withColumn("prompt", F.concat(prefix, F.col("_body"), tail)).drop("_body")


# ------------------------------------------------------------------ decision hook (K4)

RESPONSE_SCHEMA = ("investment_decision string, summary_reason string, "
                   "short_memory_index array<struct<memory_index:int>>, "
                   "middle_memory_index array<struct<memory_index:int>>, "
                   "long_memory_index array<struct<memory_index:int>>, "
                   "reflection_memory_index array<struct<memory_index:int>>")


def default_decision(prompts: DataFrame) -> DataFrame:
    """K4 default: a deterministic rule on momentum, answering in the decision JSON shape.

    buy on positive momentum, sell on negative, hold otherwise; it cites the
    first offered id of every layer.  Runs JVM-side (no model needed).
    """
    dec = F.when(F.col("momentum") == 1, "buy").when(F.col("momentum") == -1, "sell").otherwise("hold")

    def cite(layer):
        return F.array(F.struct(F.element_at(F.col("offered_ids")[layer], 1).cast("int").alias("memory_index")))
    payload = F.struct(dec.alias("investment_decision"),
                       F.concat(F.lit("momentum rule: "), dec).alias("summary_reason"),
                       cite("short").alias("short_memory_index"), cite("mid").alias("middle_memory_index"),
                       cite("long").alias("long_memory_index"), cite("reflection").alias("reflection_memory_index"))
    return prompts.withColumn("response", F.to_json(payload))


def decision_hook(prompts: DataFrame, fn: Callable[[pd.Series], pd.Series], batch_col: str = "prompt") -> DataFrame:
    """K4 user hook: ``fn(prompts: pd.Series) -> pd.Series`` of response texts, run per Arrow batch."""
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType(list(prompts.schema.fields) + [StructField("response", StringType())])

    def run(batches):
        for pdf in batches:
            pdf["response"] = fn(pdf[batch_col]).astype(object).values
            yield pdf
    return prompts.mapInPandas(run, schema)


# fixed value: the reason stored when an answer does not validate
FALLBACK_REASON = "JSON does not match schema"


def parse_decision(responses: DataFrame, mode: str = "test") -> DataFrame:
    """H25 (+H24 removal): parse the response JSON, validate the decision and every cited id
    against the offered ids of its layer; drop placeholder citations (-1 / NULL).

    ``status``: ok | fallback (unparsable text, a missing field or citation list, a decision
    or an id that was not offered: test -> hold, train -> no decision; both with NULL
    citations and the fixed message) | empty (the call gave no response: direction 0, no reflection).
    """
    p = responses.withColumn("_r", F.from_json("response", RESPONSE_SCHEMA, {"mode": "PERMISSIVE"}))
    dec = F.lower(F.trim(F.col("_r.investment_decision")))
    valid_dec = dec.isin(*DECISIONS) if mode == "test" else F.lit(True)
    checks = [F.col(f"_r.{key}").isNotNull() for key in LAYER_INDEX_KEY.values()]    # every list is required
    for layer, key in LAYER_INDEX_KEY.items():
        cited = F.transform(F.coalesce(F.col(f"_r.{key}"), F.array()), lambda x: x["memory_index"].cast("long"))
        offered = F.coalesce(F.col("offered_ids")[layer], F.array().cast("array<long>"))
        checks.append(F.size(F.array_except(cited, offered)) == 0)
    ok_ids = reduce(lambda a, b: a & b, checks)
    parsed = F.col("_r").isNotNull() & F.col("_r.summary_reason").isNotNull()
    status = (F.when(F.col("response").isNull(), F.lit("empty"))
              .when(F.coalesce(parsed & valid_dec & ok_ids, F.lit(False)), F.lit("ok")).otherwise(F.lit("fallback")))
    p = p.withColumn("status", status)

    def cleaned(key):
        lst = F.col(f"_r.{key}")
        first = F.get(lst, F.lit(0))["memory_index"]       # NULL for an empty list
        return F.when((F.col("status") == "ok") & lst.isNotNull() & (F.size(lst) > 0)
                      & first.isNotNull() & (first != PLACEHOLDER_ID), lst)
    out = p.select(
        "*",
        F.when(F.col("status") == "ok", dec).when((F.col("status") == "fallback") & F.lit(mode == "test"),
                                                  F.lit("hold")).alias("investment_decision"),
        F.when(F.col("status") == "ok", F.col("_r.summary_reason"))
         .when(F.col("status") == "fallback", F.lit(FALLBACK_REASON)).alias("summary_reason"),
        *[cleaned(k).alias(k) for k in LAYER_INDEX_KEY.values()])
    return out.drop("_r")


def cited_ids(parsed: DataFrame) -> DataFrame:
    """Distinct cited ids of each layer list, first-seen order kept."""
    cols = []
    for layer, key in LAYER_INDEX_KEY.items():
        cols.append(F.array_distinct(F.transform(F.coalesce(F.col(key), F.array()),
                                                 lambda x: x["memory_index"])).alias(f"{layer}_ids"))
    return parsed.select("*", *cols)


# ------------------------------------------------------------------ export

def decision_label(decision: Column, direction: Column) -> Column:
    """buy/sell/hold after trim + lower -> upper case; otherwise from the direction."""
    d = F.lower(F.trim(decision))
    from_dir = F.when(direction == 1, "BUY").when(direction == -1, "SELL").otherwise("HOLD")
    return F.when(d.isin(*DECISIONS), F.upper(d)).otherwise(from_dir)


def decision_export(actions: DataFrame, decisions: DataFrame) -> dict:
    """The three export tables for every symbol at once.

    ``actions`` = (symbol, date, direction); ``decisions`` = (symbol, date,
    has_decision, investment_decision, summary_reason).  Returns DataFrames:
    ``actions``, ``legacy`` (C8: decisions left-joined with the action of the
    date), ``backtest`` (rows that carry a decision key, labelled by H17, with
    per-symbol first/last test date D18), ``skipped`` (symbols with no
    back-test row: the reference refuses to export them).
    """
    legacy = decisions.join(actions.select("symbol", "date", "direction"), ["symbol", "date"], "left")
    bt = legacy.where(F.col("has_decision")).select(
        F.col("symbol").alias("stock"), F.col("date").alias("test_date"),
        decision_label(F.col("investment_decision"), F.col("direction")).alias("decision"))
    span = bt.groupBy("stock").agg(F.min("test_date").alias("first_date"), F.max("test_date").alias("last_date"),
                                   F.count(F.lit(1)).alias("n_decisions"))
    bt = bt.join(span, "stock")
    syms = actions.select("symbol").distinct().unionByName(decisions.select("symbol").distinct()).distinct()
    skipped = syms.join(span.withColumnRenamed("stock", "symbol"), "symbol", "left_anti").withColumn(
        "warning", F.lit("No test-mode investment decisions found"))
    return {"actions": actions.select("date", "symbol", "direction"),
            "legacy": legacy.select("symbol", "date", "investment_decision", "summary_reason", "direction"),
            "backtest": bt, "skipped": skipped}


def backtest_file_name(stock: Column, first: Column, last: Column, tag: str = "agent") -> Column:
    """A14 file name: '<symbol>_decisions_<first>_<last>_<tag>.csv' (the tag names the producing agent)."""
    return F.concat(stock, F.lit("_decisions_"), F.date_format(first, "yyyy-MM-dd"), F.lit("_"),
                    F.date_format(last, "yyyy-MM-dd"), F.lit(f"_{tag}.csv"))
