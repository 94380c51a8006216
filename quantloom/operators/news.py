"""News extraction and cleaning.

All steps keep ``symbol`` as a column, so one plan cleans every symbol.
Dedup steps are ``keep_first`` windows (partial top-1 before the shuffle);
the adjacent-similarity pass uses ``previous_in_order`` (time-blocked lag),
so a symbol with a third of all news still spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quantloom.functions import text as T
from quantloom.functions.similarity import similar_above
from quantloom.functions.timefns import after_close_date
from quantloom.operators.ordered import keep_first, keep_first_n, previous_in_order

NEWS_PER_DAY_CAP = 200  # fixed value: the news API returns at most 200 items per request
BODY_RATIO = 0.6        # fixed value: adjacent body similarity threshold
HEADLINE_RATIO = 0.9    # fixed value: adjacent headline similarity threshold
MIN_BODY_CHARS = 300    # fixed value: vendor bodies must be longer than this


# ------------------------------------------------------------------ vendor extraction

def subject_keys(subjects: DataFrame) -> DataFrame:
    """Split a subject code into an equi-join key: ('R', ric root) or ('P', perm id).

    ``subject LIKE 'R:CAT.%'`` is exactly ``ric root = 'CAT'`` for the root
    before the first dot, so the mapping joins on equality.
    """
    kind = F.substring("subject", 1, 1)
    root = F.regexp_extract("subject", r"^R:([^.]+)\.", 1)
    key = F.when(kind == "R", F.nullif(root, F.lit(""))).when(kind == "P", F.col("subject"))
    return subjects.withColumn("key_kind", kind).withColumn("key", key).where(F.col("key").isNotNull())


def mapping_keys(mapping: DataFrame) -> DataFrame:
    """(ticker, ric_prefix like 'R:CAT.', perm_id like 'P:123') -> (ticker, key_kind, key) rows."""
    ric = mapping.select("ticker", F.lit("R").alias("key_kind"),
                         F.regexp_extract("ric_prefix", r"^R:([^.]+)\.", 1).alias("key"))
    perm = mapping.select("ticker", F.lit("P").alias("key_kind"), F.col("perm_id").alias("key"))
    return ric.unionByName(perm).where(F.col("key").isNotNull() & (F.col("key") != "")).distinct()


def vendor_extract(item_data: DataFrame, data_subject: DataFrame, mapping: DataFrame,
                   start=None, end=None, language: str = "en",
                   min_body_chars: int = MIN_BODY_CHARS, tz: str = "UTC") -> DataFrame:
    """Join items to subjects (C1), keep the mapped tickers (B5), the language (B6),
    the time range (B3: bounds are wall-clock times in ``tz``, items are UTC), newest item per
    normalised headline (H3 + E1), bodies longer than ``min_body_chars`` (B7).
    """
    items = item_data.where(F.col("item_language") == language)

    def utc(v):
        return F.convert_timezone(F.lit(tz), F.lit("UTC"), F.lit(v).cast("timestamp_ntz"))
    if start is not None:
        items = items.where(F.col("first_created") >= utc(start))
    if end is not None:
        items = items.where(F.col("first_created") <= utc(end))
    subj = subject_keys(data_subject).join(mapping_keys(mapping), ["key_kind", "key"])
    j = items.join(subj.select("item_id", "subject", "ticker"), "item_id")
    j = j.withColumn("normalized_headline", T.strip_leading_digits("headline"))
    top = keep_first(j, ["ticker", "normalized_headline"],
                     [F.col("first_created").desc(), F.col("item_id").asc()])
    top = top.where(F.col("body").isNotNull() & (F.length("body") > min_body_chars))
    return top.select("item_id", F.col("first_created").alias("dates"), F.col("subject").alias("symbols"),
                      "ticker", "headline", "body")


# ------------------------------------------------------------------ cleaning

def tag_updates(news: DataFrame) -> DataFrame:
    """H1 + H2: update number and the headline without update tags."""
    return (news.withColumn("update_number", T.update_number("headline"))
                .withColumn("new_headline", T.strip_update_tags("headline")))


def content_key(c) -> "F.Column":
    """256-bit digest of a dedup key: long texts are compared and shuffled as 32 bytes."""
    return F.unhex(F.sha2(c, 256))


def _drop_updates(rows: DataFrame, key: str, headline: str, body_key: str, short_headline: str,
                  after=lambda df, step: df) -> DataFrame:
    """D6 chain on any rows that carry its keys; ``after`` sees the rows of each step.

    Highest update per new headline, then newest per space-less body, then newest per space-less headline.
    """
    newest = [F.col("dates").desc(), F.col("item_id").asc()]
    d = after(keep_first(rows, [key, headline], [F.col("update_number").desc(), *newest]), "newest_update")
    d = after(keep_first(d, [key, body_key], newest), "distinct_body")
    return after(keep_first(d, [key, short_headline], newest), "distinct_headline")


def dedup_updates(news: DataFrame, key: str = "symbol") -> DataFrame:
    """D6 chain before text cleaning: highest update per new headline, then newest per
    space-less body, then newest per space-less headline (wire-marker cut in between).

    Whole-body keys are grouped by their SHA-256 digest, so the rows shuffled by
    the second step carry the body once instead of twice.
    """
    d = news.withColumn("body", T.from_wire_marker("body"))
    d = (d.withColumn("_body_key", content_key(T.without_spaces("body")))
          .withColumn("temp_new_headline", T.without_spaces("new_headline")))
    return _drop_updates(d, key, "new_headline", "_body_key", "temp_new_headline").drop("_body_key", "temp_new_headline")


def clean_bodies(news: DataFrame, key: str = "symbol") -> DataFrame:
    """B15 + H7 + H6 + D6: second-precision time, after-close date, cleaned body,
    first (earliest) row per cleaned body."""
    d = _cleaned(news).withColumn("_clean_key", content_key(F.col("cleaned_body")))
    return keep_first(d, [key, "_clean_key"], [F.col("dates").asc(), F.col("item_id").asc()]).drop("_clean_key")


def _cleaned(news: DataFrame) -> DataFrame:
    d = news.withColumn("dates", F.date_trunc("second", F.col("dates")).cast("timestamp_ntz"))
    return d.withColumns({"date": after_close_date("dates"), "cleaned_body": T.clean_text("body")})


def drop_similar_adjacent(news: DataFrame, col: str, r: float, key: str = "symbol",
                          ts_col: str = "dates", tie_col: str = "item_id") -> DataFrame:
    """Drop a row whose ``col`` is more than ``r`` similar to the previous input row's.

    The comparison is with the previous row of the input even when that row is
    itself dropped, exactly one pass.  The previous row is found on (key, time, id) alone;
    its text comes by one join on (key, id), so no window or carry table holds a text.
    ``tie_col`` is unique within ``key``.
    """
    def place(tie):
        return F.struct(F.col(key).alias("k"), F.col(tie).alias("t"))      # a NULL key equals a NULL key
    ids = previous_in_order(news.select(key, ts_col, tie_col), [key], ts_col, tie_col, tie_col, "_prev_id")
    ids = ids.select(place(tie_col).alias("_at"),
                     F.when(F.col("_prev_id").isNotNull(), place("_prev_id")).alias("_before"))
    before = news.select(place(tie_col).alias("_before"), F.col(col).alias("_prev"))
    prev = (news.withColumn("_at", place(tie_col)).join(ids, "_at").join(before, "_before", "left")
            .drop("_at", "_before"))
    # the lengths alone bound the ratio: only the texts of pairs that may exceed r leave the JVM
    la, lb = F.length(col), F.length("_prev")
    open_ = (la + lb == 0) | (2.0 * F.least(la, lb) / (la + lb) > r)
    sim = similar_above(r)(F.when(open_, F.col(col)), F.when(open_, F.col("_prev")))
    return prev.where(F.col("_prev").isNull() | ~sim).drop("_prev")


# The steps of ``clean_news`` whose rows are counted while it runs
CLEAN_STEPS = ("raw", "newest_update", "distinct_body", "distinct_headline", "distinct_cleaned_body", "similar_body",
               "similar_headline")


def clean_news(raw: DataFrame, key: str = "symbol", body_ratio: float = BODY_RATIO,
               headline_ratio: float = HEADLINE_RATIO, counts: dict[str, Observation] | None = None) -> DataFrame:
    """P2 up to the calendar: (date, symbol, headline, body, dates, item_id); ``item_id`` is unique within ``key``.

    Every row's digests and its cleaned body are computed in the one read of the input and written once.  The
    dedup steps decide on narrow rows (ids, times, digests); bodies join the survivors once, by id.  Each
    similarity pass reads its input twice (rows and predecessors), so its input is a written table, too.

    ``counts`` (D16) is filled with an ``Observation`` per step of ``CLEAN_STEPS``: its number of rows (``n``), counted by the jobs
    that run anyway; the last one has its count once the result has been computed.
    """
    from quantloom.session import cut_lineage

    def counted(df: DataFrame, step: str) -> DataFrame:
        if counts is None:
            return df
        counts[step] = Observation(step)
        return df.observe(counts[step], F.count(F.lit(1)).alias("n"))

    src = tag_updates(counted(raw, "raw")).select("item_id", key, "dates", "update_number", "new_headline", "body")
    src = src.withColumn("body", T.from_wire_marker("body")).withColumn("_at", F.col("dates"))
    src = _cleaned(src).withColumns({
        "_headline_key": content_key(F.col("new_headline")), "_body_key": content_key(T.without_spaces("body")),
        "_short_key": content_key(T.without_spaces("new_headline")), "_clean_key": content_key(F.col("cleaned_body"))})
    src = cut_lineage(src.drop("body"), "news_cleaned")
    narrow = src.select("item_id", key, F.col("_at").alias("dates"), F.col("dates").alias("_second"), "update_number",
                        "_headline_key", "_body_key", "_short_key", "_clean_key")
    last = _drop_updates(narrow, key, "_headline_key", "_body_key", "_short_key", counted)
    kept = counted(keep_first(last, [key, "_clean_key"], [F.col("_second").asc(), F.col("item_id").asc()]),
                   "distinct_cleaned_body").select(F.col("item_id").alias("_id"), F.col(key).alias("_key"))
    d = src.join(kept, (src["item_id"] == kept["_id"]) & src[key].eqNullSafe(kept["_key"])).select(
        "item_id", key, "dates", "date", "new_headline", "cleaned_body")
    d = drop_similar_adjacent(cut_lineage(d, "news_distinct"), "cleaned_body", body_ratio, key)
    d = drop_similar_adjacent(cut_lineage(counted(d, "similar_body"), "news_bodies"), "new_headline", headline_ratio, key)
    return counted(d, "similar_headline").select(
        "date", key, F.col("new_headline").alias("headline"), F.col("cleaned_body").alias("body"), "dates", "item_id")


def cap_per_day(news: DataFrame, cap: int = NEWS_PER_DAY_CAP, key: str = "symbol",
                ts_col: str = "dates", tie_col: str = "item_id") -> DataFrame:
    """At most ``cap`` items per (symbol, day), earliest first."""
    d = news.withColumn("_day", F.to_date(ts_col))
    return keep_first_n(d, [key, "_day"], [F.col(ts_col).asc(), F.col(tie_col).asc()], cap).drop("_day")


def count_by_symbol(df: DataFrame, key: str = "symbol", name: str = "n") -> DataFrame:
    """Row counts per symbol (before / after cleaning)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
