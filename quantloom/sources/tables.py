"""Shared input tables and the domain inputs derived from them.

``Tables`` reads the parquet files lazily (Catalyst prunes columns and pushes
filters into each scan).  The ``derive_*`` functions turn the shared tables
into the shapes the domain operators consume (prices, actions, raw news,
memories, citations, ticks); they are plain DataFrame plans, so their work
grows with the tables.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()

# The three synthetic models of the actions fixture and their offsets.
MODELS = (("m0", 0), ("m1", 1), ("m2", 2))
# Memory layers in routing / priority order.
LAYERS = ("short", "mid", "long", "reflection")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.read(name)
        raise AttributeError(name)

    @cached_property
    def prices(self) -> DataFrame:
        """Daily prices, written once as a stage table: every query uses them in several
        branches (rewards, next price, actions), and the orders scan + join + aggregate
        behind them must not run once per branch."""
        from quantloom.session import cut_lineage
        return cut_lineage(derive_prices(self), "prices")

    def prices_between(self, start=None, end=None, end_inclusive: bool = False) -> DataFrame:
        """Prices of a date window; the range is applied before the stage table is written,
        so it reaches the orders scan as a pushed filter."""
        from quantloom.operators.metrics import restrict_dates
        from quantloom.session import cut_lineage
        return cut_lineage(restrict_dates(derive_prices(self), start, end, end_inclusive), "prices_window")

    @cached_property
    def actions(self) -> DataFrame:
        return derive_actions(self.prices)


def md5_uniform(key: Column, seed: str = "42") -> Column:
    """Reproducible uniform draw in [0,1) from md5 of '<seed>-<key>' (same in DuckDB)."""
    h = F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def derive_prices(t: Tables) -> DataFrame:
    """Daily close per symbol: one symbol per nation, price = max order total of the day."""
    o = t.orders.select("o_custkey", "o_orderdate", "o_totalprice")
    c = t.customer.select("c_custkey", "c_nationkey")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .groupBy(F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("symbol"),
                     F.col("o_orderdate").cast("date").alias("date"))
            .agg(F.max("o_totalprice").alias("price")))


def derive_actions(prices: DataFrame) -> DataFrame:
    """Three deterministic models' directions in {-1,0,1} for every priced day."""
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("k")) for m, k in MODELS])
    p = prices.select("symbol", "date", F.explode(models).alias("m"))
    direction = ((F.dayofmonth("date") * 7 + F.month("date") * 3 + F.length("symbol")
                  + F.col("m.k") * 5) % 3 - 1).cast("int")
    return p.select(F.col("m.model").alias("model"), "symbol", "date", direction.alias("direction"))


def derive_raw_news(t: Tables) -> DataFrame:
    """Vendor-style news rows from ``documents``: times cross 16:00 and weekends."""
    d = t.documents
    dates = F.expr("timestamp_ntz'2024-01-01 00:00:00' + doc_id * interval '37' minute")
    update = F.when(F.col("doc_id") % 3 == 0,
                    F.concat(F.lit("UPDATE "), (F.col("doc_id") % 4).cast("string"), F.lit("-"))
                    ).otherwise(F.lit(""))
    headline = F.concat(update, F.substring(F.regexp_replace("text", "\n", " "), 1, 40))
    body = F.concat(F.when(F.col("doc_id") % 5 == 0, F.lit("CITY, Jan 1 (Reuters) - ")).otherwise(F.lit("")),
                    F.col("text"))
    return d.select(F.col("doc_id").alias("item_id"), F.upper("source").alias("symbol"),
                    dates.alias("dates"), headline.alias("headline"), body.alias("body"),
                    F.col("lang").alias("item_language"))


def derive_memories(t: Tables) -> DataFrame:
    """Memory records (M13) from ``embeddings``: layer by id, scores by rule."""
    e = t.embeddings
    layer = (F.when(F.col("vec_id") % 4 == 0, "short").when(F.col("vec_id") % 4 == 1, "mid")
             .when(F.col("vec_id") % 4 == 2, "long").otherwise("reflection"))
    return e.select(
        layer.alias("layer"),
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("symbol"),
        F.col("vec_id").alias("id"),
        (F.lit(40) + (F.col("vec_id") * 7) % 56).cast("double").alias("importance"),
        F.exp(-((F.col("vec_id") % 9).cast("double") / F.lit(3.0))).alias("recency"),
        (F.col("vec_id") % 9).cast("int").alias("delta"),
        F.lit(0).cast("int").alias("access_counter"),
        F.col("vec_id").alias("seq"),
        F.col("embedding"),
    )


def derive_citations(t: Tables) -> DataFrame:
    """Past decisions' cited memory ids with a feedback sign."""
    e = t.embeddings
    return e.select(
        F.concat(F.lit("L"), (F.col("vec_id") % 10).cast("string")).alias("symbol"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 30).cast("int")).alias("date"),
        F.col("vec_id").alias("cited_id"),
        (F.col("vec_id") % 3 - 1).cast("int").alias("feedback"),
    )


def derive_ticks(t: Tables) -> DataFrame:
    """Short dense daily series per user from ``events``."""
    ev = t.events.select("user_id", "ts", "value")
    return (ev.groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
                       F.col("ts").cast("date").alias("date"))
            .agg(F.max("value").alias("price"), F.count(F.lit(1)).alias("n_ticks")))


def derive_subjects(t: Tables) -> DataFrame:
    """Vendor subject codes per item: a ticker code (RIC-style or perm id) and a topic code."""
    d = t.documents.select("doc_id", "source", "lang")
    num = F.substring("source", 4, 10).try_cast("int")
    code = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("R:"), F.upper("source"), F.lit(".O"))).otherwise(
        F.concat(F.lit("P:"), (F.lit(100000) + num).cast("string")))
    ticker = d.select(F.col("doc_id").alias("item_id"), code.alias("subject"))
    topic = d.select(F.col("doc_id").alias("item_id"), F.concat(F.lit("N:"), F.upper("lang")).alias("subject"))
    return ticker.unionByName(topic)


def derive_ticker_map(t: Tables) -> DataFrame:
    """(ticker, ric_prefix, perm_id) for every source seen in ``documents``."""
    s = t.documents.select("source").distinct()
    num = F.substring("source", 4, 10).try_cast("int")
    return s.select(F.upper("source").alias("ticker"),
                    F.concat(F.lit("R:"), F.upper("source"), F.lit(".")).alias("ric_prefix"),
                    F.concat(F.lit("P:"), (F.lit(100000) + num).cast("string")).alias("perm_id"))


# Fixed value: number of ticker symbols the documents are spread over for the
# environment inputs (the 'U<n>' symbols of the ticks series).
ENV_SYMBOLS = 150


def derive_env_news(t: Tables) -> DataFrame:
    """News items keyed like the ticks series: (symbol, date, seq, headline, body)."""
    n = derive_raw_news(t)
    from quantloom.functions.timefns import after_close_date
    return n.select(F.concat(F.lit("U"), (F.col("item_id") % ENV_SYMBOLS).cast("string")).alias("symbol"),
                    after_close_date("dates").alias("date"), F.col("item_id").alias("seq"), "headline", "body")


def derive_filings(t: Tables) -> DataFrame:
    """Filings from ``documents``: form by id, filed on the news timestamp's date."""
    d = t.documents.select("doc_id", "text")
    form = (F.when(F.col("doc_id") % 3 == 0, "10-K").when(F.col("doc_id") % 3 == 1, "10-Q").otherwise("20-F"))
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00' + doc_id * interval '37' minute")
    return d.select(F.concat(F.lit("U"), (F.col("doc_id") % ENV_SYMBOLS).cast("string")).alias("symbol"),
                    F.to_date(ts).alias("date"), form.alias("form"), F.col("text").alias("content"),
                    F.col("doc_id").alias("seq"))


def register_views(t: Tables, names=TABLE_NAMES) -> None:
    """A4: the shared tables as temp views, so warehouse-style SQL runs unchanged on Spark."""
    for n in names:
        t.read(n).createOrReplaceTempView(n)


def set_constant(df: DataFrame, name: str, value, require_existing: bool = False) -> DataFrame:
    """Overwrite (or add) a constant column; with ``require_existing`` a missing column is
    tolerated and the frame is returned unchanged, as the reference only prints a message."""
    if require_existing and name not in df.columns:
        import logging
        logging.getLogger("quantloom").warning("column %r not found; frame left unchanged", name)
        return df
    return df.withColumn(name, F.lit(value))
