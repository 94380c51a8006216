"""Daily environment records (M10/M12): price, filings and news per (symbol, date).

The reference nests everything under the date (``date -> {price: {sym: p},
news: {sym: [..]}, ...}``); here the physical form is long, one row per
(symbol, date), which partitions by symbol and never builds one huge value.
``to_nested`` gives the per-date map view when a caller wants it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.text import headline_and
from quantloom.operators.ranking import positions_in_groups

K_FORMS = ("10-K",)                  # fixed values: forms stored in the filing_k slot
Q_FORMS = ("10-Q", "20-F")           # fixed values: forms sharing the filing_q slot


def filing_slot(form_col: str = "form"):
    """10-K -> 'k'; 10-Q and 20-F -> 'q'; other forms -> NULL."""
    f = F.col(form_col)
    return F.when(f.isin(*K_FORMS), F.lit("k")).when(f.isin(*Q_FORMS), F.lit("q"))


def non_blank(text) -> "F.Column":
    """B11 for one item: a non-NULL text that is not only spaces."""
    return text.isNotNull() & (F.trim(text) != "")


def keep_non_blank(news_list) -> "F.Column":
    """B11 for a list: blank items removed (a single string is wrapped as a list of one first)."""
    return F.filter(news_list, lambda x: non_blank(x))


def news_items(news: DataFrame, text_cols=("headline", "body"), null_as: str = "") -> DataFrame:
    """H20 + B12: one text per item, 'headline body' trimmed, blank items dropped."""
    a, b = text_cols
    t = news.withColumn("text", headline_and(a, b, null_as))
    return t.where(F.col("text") != "")


def news_by_day(items: DataFrame, keys=("symbol", "date"), seq: str = "seq") -> DataFrame:
    """Ordered list of texts per (symbol, date), input order (``seq``) kept."""
    g = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(seq), F.col("text")))).alias("_n"))
    return g.select(*keys, F.transform("_n", lambda x: x["text"]).alias("news"))


CHUNK_ITEMS = 1_000      # news items of one list of ``news_chunks``


def news_chunks(items: DataFrame, size: int = CHUNK_ITEMS, keys=("symbol", "date"), seq: str = "seq") -> DataFrame:
    """D1 for days of any size: (keys, chunk_no, news), lists of at most ``size`` texts in input order.

    Places come from distributed positions, so a day with any number of items is neither sorted nor held by one
    task; concatenating a day's chunks in order gives ``news_by_day``.
    """
    placed = positions_in_groups(items.select(*keys, seq, "text"), list(keys), [seq, "text"], "_place")
    chunk = ((F.col("_place") - 1) / size).cast("long").alias("chunk_no")
    g = placed.groupBy(*keys, chunk).agg(F.array_sort(F.collect_list(F.struct(seq, "text"))).alias("_n"))
    return g.select(*keys, "chunk_no", F.transform("_n", lambda x: x["text"]).alias("news"))


def filings_by_day(filings: DataFrame, keys=("symbol", "date"), seq: str = "seq") -> DataFrame:
    """D3 + D4: the last filing of each slot per (symbol, date) wins."""
    f = filings.withColumn("_slot", filing_slot()).where(F.col("_slot").isNotNull())
    k = F.max_by(F.when(F.col("_slot") == "k", F.col("content")),
                 F.when(F.col("_slot") == "k", F.col(seq)))
    q = F.max_by(F.when(F.col("_slot") == "q", F.col("content")),
                 F.when(F.col("_slot") == "q", F.col(seq)))
    return f.groupBy(*keys).agg(k.alias("filing_k"), q.alias("filing_q"))


def env_aligned(prices: DataFrame, news_items_df: DataFrame, filings: DataFrame) -> DataFrame:
    """Priced (symbol, date) rows drive; filings default NULL, news default []."""
    p = prices.select("symbol", "date", "price")
    n = news_by_day(news_items_df)
    f = filings_by_day(filings)
    j = p.join(n, ["symbol", "date"], "left").join(f, ["symbol", "date"], "left")
    return j.withColumn("news", F.coalesce(F.col("news"), F.array().cast("array<string>")))


def env_parts(prices: DataFrame, news_items_df: DataFrame, filings: DataFrame,
              size: int = CHUNK_ITEMS) -> tuple[DataFrame, DataFrame]:
    """P5 as two tables for the sink: the days (C4) without their news but with the number of items, and the chunks.

    No value grows with a day's news; ``sources.io.write_env_parts`` writes both per ticker.
    """
    none = news_items_df.limit(0)
    days = env_outer(prices, none, filings).drop("news")
    counts = news_items_df.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n_news"))
    both = days.join(counts, ["symbol", "date"], "full").withColumn("n_news", F.coalesce("n_news", F.lit(0).cast("long")))
    return both, news_chunks(news_items_df, size)


def env_outer(prices: DataFrame, news_items_df: DataFrame, filings: DataFrame) -> DataFrame:
    """P5 / C4: dates from any source, one grouping over tagged rows instead of outer joins.

    ``news`` is NULL for a (symbol, date) without news (the key is absent in
    the reference's map), price is NULL when the day has no price.
    """
    p = prices.select("symbol", "date", F.col("price").cast("double").alias("price"),
                      F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("_slot"),
                      F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("text"))
    f = filings.select("symbol", "date", F.lit(None).cast("double").alias("price"), F.col("seq").cast("long"),
                       filing_slot().alias("_slot"), "content", F.lit(None).cast("string").alias("text"))
    n = news_items_df.select("symbol", "date", F.lit(None).cast("double").alias("price"), F.col("seq").cast("long"),
                             F.lit(None).cast("string").alias("_slot"), F.lit(None).cast("string").alias("content"),
                             "text")
    u = p.unionByName(f).unionByName(n)
    news = F.collect_list(F.when(F.col("text").isNotNull(), F.struct("seq", "text")))
    g = u.groupBy("symbol", "date").agg(
        F.max("price").alias("price"),
        F.max_by(F.when(F.col("_slot") == "k", F.col("content")), F.when(F.col("_slot") == "k", F.col("seq"))).alias("filing_k"),
        F.max_by(F.when(F.col("_slot") == "q", F.col("content")), F.when(F.col("_slot") == "q", F.col("seq"))).alias("filing_q"),
        news.alias("_n"))
    return g.select("symbol", "date", "price", "filing_k", "filing_q",
                    F.when(F.size("_n") > 0, F.transform(F.array_sort("_n"), lambda x: x["text"])).alias("news"))


def restrict_env(env: DataFrame, start=None, end=None) -> DataFrame:
    """B1: closed date range."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        cond = cond & (F.col("date") <= F.lit(end).cast("date"))
    return env.where(cond)


def replay_steps(prices: DataFrame, start=None, end=None) -> DataFrame:
    """(symbol, date, record, done) of every replay step; the windows hold dates and prices only."""
    p = restrict_env(prices.select("symbol", "date", "price"), start, end).where(F.col("price").isNotNull())
    w = Window.partitionBy("symbol").orderBy("date")
    p = p.withColumn("record", F.lead("price").over(w) - F.col("price"))
    p = p.withColumn("done", F.lead("record", 1).over(w).isNull())
    return p.where(F.col("record").isNotNull()).select("symbol", "date", "record", "done")


def replay_rows(env: DataFrame, start=None, end=None, prices: DataFrame | None = None) -> DataFrame:
    """Priced days in range with next-row record and the end flag.

    ``record`` = next priced day's price - price; the last day has none and
    is not emitted (it only closes the replay), ``done`` marks the last step.
    The steps come from ``prices`` (default: the priced days of ``env``) and the texts
    join them by (symbol, date), so no window holds a symbol's texts.
    """
    steps = replay_steps(env if prices is None else prices, start, end)
    e = restrict_env(env, start, end).where(F.col("price").isNotNull())
    return e.join(steps, ["symbol", "date"]).withColumn(
        "news", F.coalesce(F.col("news"), F.array().cast("array<string>")))


def one_symbol_view(env: DataFrame, symbols) -> DataFrame:
    """B16 (+B4): rows of the given symbols, skipping dates without a news entry."""
    return env.where(F.col("symbol").isin(*symbols) & F.col("news").isNotNull())


def with_news_entry(env: DataFrame) -> DataFrame:
    """B16 for every symbol at once: dates lacking the symbol's news entry are skipped."""
    return env.where(F.col("news").isNotNull())


def symbols_by_day(prices: DataFrame) -> DataFrame:
    """The sorted symbols with a price on each date."""
    return prices.groupBy("date").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))


def price_map_by_day(prices: DataFrame) -> DataFrame:
    """Date -> map(symbol -> price), entries sorted by symbol."""
    e = F.array_sort(F.collect_list(F.struct("symbol", "price")))
    return prices.groupBy("date").agg(F.map_from_entries(e).alias("price"))


def to_nested(env: DataFrame) -> DataFrame:
    """M10 view: one row per date with maps keyed by symbol, news texts included.

    A date's value holds all its texts, as the reference's record does; jobs over
    many symbols keep to the long rows.
    """
    def m(c):
        return F.map_from_entries(F.array_sort(F.collect_list(
            F.when(c.isNotNull(), F.struct(F.col("symbol"), c)))))
    return env.groupBy("date").agg(m(F.col("price")).alias("price"), m(F.col("filing_k")).alias("filing_k"),
                                   m(F.col("filing_q")).alias("filing_q"), m(F.col("news")).alias("news"))


def validate_env(env: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A20 in full: (valid, rejected with ``reason``).

    A record needs a symbol, a date and a number above zero as its price where it has one; its date is its key, so
    a (symbol, date) must not repeat.  Values of another type (a date or price that does not parse) are rejected, too.
    """
    date, price = F.col("date").try_cast("date"), F.col("price").try_cast("double")
    repeated = env.groupBy(F.col("symbol").alias("_s"), date.alias("_d")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    joined = env.join(repeated, (F.col("symbol") == F.col("_s")) & (date == F.col("_d")), "left")
    reason = (F.when(F.col("symbol").isNull() | (F.trim(F.col("symbol").cast("string")) == ""), "no symbol")
              .when(date.isNull(), "no date")
              .when(F.col("price").isNotNull() & price.isNull(), "price is no number")
              .when(F.isnan(price) | (price <= 0), "price not above 0")
              .when(F.col("_n").isNotNull(), "date repeats"))
    judged = joined.withColumn("reason", reason).drop("_s", "_d", "_n")
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def validate_prices(env: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split rows into (valid, rejected) on ``price > 0``; ``strict`` raises inside the job."""
    ok = F.col("price").isNotNull() & (F.col("price") > 0)
    if strict:
        checked = env.withColumn("_chk", F.when(ok, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("price must be > 0 for "), F.col("symbol")))))
        return checked.where(F.col("_chk")).drop("_chk"), env.where(F.lit(False))
    return env.where(ok), env.where(~ok | F.col("price").isNull())
