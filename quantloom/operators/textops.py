"""Text operators: chat flattening, provider responses, lexicon sentiment, HTML and JSON
landing pages, summaries and profile texts (H19, H29-H35, A7, A9, A10, K2, K3, C15).

Everything is a column expression or a token-level ``explode`` + ``groupBy``;
user models plug in as Arrow batch hooks (``sentiment_hook``, ``summarise_hook``).
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.text import summary_request, truncate_summary  # noqa: F401  (H29, H30)

# Chat template markers of the instruction format.
INST_OPEN, INST_CLOSE = "<s>[INST] ", " [/INST]"
SYS_OPEN, SYS_CLOSE = "<<SYS>>\n", "\n<</SYS>>\n\n"
TURN_CLOSE_OPEN = "</s><s>[INST] "
# JSON paths of the response text, by payload shape.
RESPONSE_PATHS = {"candidates": "$.candidates[0].content.parts[0].text",
                  "generated_text": "$.generated_text",
                  "choices": "$.choices[0].message.content"}
# Sentiment sentences appended to each news item.
SENTIMENT_SENTENCES = ("The positive score for this news is {pos}.",
                       "The neutral score for this news is {neu}.",
                       "The negative score for this news is {neg}.")
# The default lexicon, 20 frequent words of the shared documents with a polarity.
DEFAULT_LEXICON = (
    ("that", 1), ("for", 1), ("with", 1), ("are", 1), ("rewh", 1),
    ("thatin", 1), ("inoran", 1), ("hehely", 1), ("ing", 1), ("tion", 1),
    ("was", -1), ("this", -1), ("from", -1), ("orre", -1), ("ononst", -1),
    ("orantion", -1), ("ble", -1), ("ther", -1), ("thth", -1), ("thon", -1),
)
WORD_SPLIT = r"[^\p{L}\p{N}]+"
SUMMARY_CHARS = 200        # default summariser length (characters)
# Fixed value: the agent profile text (character string) template.
PROFILE_TEMPLATE = ("\nYou accumulate a lot of information of the following sectors so you are especially good "
                    "at trading them:\n{sectors}\n\nYou are an expert of {ticker}.\n")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# ------------------------------------------------------------------ H31 chat flattening

def chat_flatten(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One instruction-format prompt per conversation.

    A system turn at position 0 becomes the system block, user turns are
    stripped, any other role closes the instruction and reopens the next.
    """
    g = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "role", "text"))).alias("_t"))

    def part(x, i):
        return (F.when((x["role"] == "system") & (i == 0), F.concat(F.lit(SYS_OPEN), x["text"], F.lit(SYS_CLOSE)))
                .when(x["role"] == "user", _strip(x["text"]))
                .otherwise(F.concat(F.lit(" [/INST] "), _strip(x["text"]), F.lit(TURN_CLOSE_OPEN))))
    body = F.array_join(F.transform("_t", part), "")
    return g.select(key, F.concat(F.lit(INST_OPEN), body, F.lit(INST_CLOSE)).alias("prompt"))


# ------------------------------------------------------------------ H32 provider responses

def response_text(payload: Column, provider: Column) -> Column:
    """The generated text from a JSON payload of the given shape."""
    out = None
    for name, path in RESPONSE_PATHS.items():
        v = F.get_json_object(payload, path)
        out = F.when(provider == name, v) if out is None else out.when(provider == name, v)
    return out


# ------------------------------------------------------------------ H35 / K3 sentiment

def lexicon_df(spark: SparkSession, lexicon=DEFAULT_LEXICON) -> DataFrame:
    """(word, polarity) as a local relation: the planner knows its size and broadcasts it when it is small."""
    words, polarity = zip(*lexicon)
    return spark.createDataFrame(pa.table({"word": pa.array(words, pa.string()), "polarity": pa.array(polarity, pa.int32())}))


def lexicon_sentiment(texts: DataFrame, key: str, lexicon: DataFrame, text_col: str = "text") -> DataFrame:
    """H35 (default K3): (key, pos, neu, neg) shares of lexicon-positive, neutral and negative words.

    Words are exploded and counted with partial aggregation; the planner
    broadcasts the lexicon when it is small and joins it on the word otherwise.
    Splitting gives every text one part at least (an empty one is no word), so a text
    without words keeps its row and the texts are read once.
    """
    words = texts.select(key, F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), WORD_SPLIT))
                         .alias("word"))
    real = lambda c: F.count(F.when((F.col("word") != "") & c, 1))
    base = words.join(lexicon, "word", "left").groupBy(key).agg(
        real(F.lit(True)).alias("n"), real(F.col("polarity") > 0).alias("n_pos"), real(F.col("polarity") < 0).alias("n_neg"))
    n = F.col("n").cast("double")
    pos = F.when(n > 0, F.round(F.col("n_pos") / n, 3)).otherwise(F.lit(0.0))
    neg = F.when(n > 0, F.round(F.col("n_neg") / n, 3)).otherwise(F.lit(0.0))
    neu = F.when(n > 0, F.round((n - F.col("n_pos") - F.col("n_neg")) / n, 3)).otherwise(F.lit(0.0))
    return base.select(key, pos.alias("pos"), neu.alias("neu"), neg.alias("neg"))


def sentiment_append(text: Column, pos: Column, neu: Column, neg: Column) -> Column:
    """H19: '<news> The positive score ... {pos}. The neutral ... {neu}. The negative ... {neg}.'"""
    s = [F.lit(x.split("{")[0]) for x in SENTIMENT_SENTENCES]
    return F.concat(text, F.lit(" "), s[0], pos.cast("string"), F.lit(". "), s[1], neu.cast("string"),
                    F.lit(". "), s[2], neg.cast("string"), F.lit("."))


def sentiment_hook(texts: DataFrame, scorer: Callable[[pd.Series], pd.DataFrame], text_col: str = "text") -> DataFrame:
    """K3: a user scorer ``pd.Series[str] -> DataFrame(pos, neu, neg)`` applied per Arrow batch."""
    @F.pandas_udf("struct<pos:double,neu:double,neg:double>")
    def score(s: pd.Series) -> pd.DataFrame:
        return scorer(s)[["pos", "neu", "neg"]].astype("float64")
    return texts.withColumn("_s", score(F.col(text_col))).select("*", "_s.pos", "_s.neu", "_s.neg").drop("_s")


# ------------------------------------------------------------------ A10 HTML result pages

def _unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _squash(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def html_extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """A10: title, headline (first h1), first link, body text (paragraphs) else the meta snippet.

    Pages lacking a headline or a link are dropped, as cards lacking them are.
    """
    h = F.col(html_col)
    title = _squash(_unescape(F.regexp_extract(h, r"(?s)<title[^>]*>(.*?)</title>", 1)))
    h1 = _squash(_unescape(F.regexp_replace(F.regexp_extract(h, r"(?s)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]+>", " ")))
    link = F.regexp_extract(h, r"<a [^>]*href=\"([^\"]*)\"", 1)
    no_code = F.regexp_replace(h, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    paras = F.regexp_extract_all(no_code, F.lit(r"(?s)<p[^>]*>(.*?)</p>"), 1)
    body = _squash(_unescape(F.regexp_replace(F.array_join(paras, " "), r"<[^>]+>", " ")))
    snippet = _squash(_unescape(F.regexp_extract(h, r"<meta name=\"description\" content=\"([^\"]*)\"", 1)))
    out = pages.select("*", title.alias("title"), h1.alias("headline"), link.alias("link"),
                       F.coalesce(F.nullif(body, F.lit("")), snippet).alias("body"))
    return out.where((F.col("headline") != "") & (F.col("link") != ""))


# ------------------------------------------------------------------ A7 / A9 landed JSON

NEWS_PAGE_SCHEMA = ("news array<struct<id:long, author:string, content:string, created_at:string, source:string, "
                    "summary:string, headline:string, url:string, symbols:array<string>>>, next_page_token string")
FILING_INDEX_SCHEMA = ("filings array<struct<ticker:string, cik:string, formType:string, filedAt:string, "
                       "documentFormatFiles:array<struct<type:string, documentUrl:string>>>>")


def flatten_news_pages(pages: DataFrame, json_col: str = "payload") -> DataFrame:
    """Explode the ``news`` array of each landed page into rows; ISO time without 'Z'."""
    p = pages.select("*", F.from_json(json_col, NEWS_PAGE_SCHEMA).alias("_p"))
    n = p.select("*", F.explode_outer("_p.news").alias("_n")).where(F.col("_n").isNotNull())
    ts = F.to_timestamp_ntz(F.regexp_replace(F.col("_n.created_at"), "Z$", ""))
    return n.select(F.col("_n.author").alias("author"), F.col("_n.content").alias("content"),
                    ts.alias("datetime"), F.col("_n.source").alias("source"), F.col("_n.summary").alias("summary"),
                    F.col("_n.headline").alias("title"), F.col("_n.url").alias("url"),
                    F.to_date(ts).alias("date"), F.element_at(F.col("_n.symbols"), 1).alias("equity"))


def pick_filing_documents(index_pages: DataFrame, json_col: str = "payload") -> DataFrame:
    """Explode filings; keep the first document whose type equals the form type."""
    p = index_pages.select(F.explode(F.from_json(json_col, FILING_INDEX_SCHEMA)["filings"]).alias("f"))
    doc = F.element_at(F.filter("f.documentFormatFiles", lambda d: d["type"] == F.col("f.formType")), 1)
    return (p.select(F.col("f.ticker").alias("ticker"), F.col("f.cik").alias("cik"),
                     F.col("f.formType").alias("type"), F.col("f.filedAt").alias("filed_at"),
                     doc["documentUrl"].alias("document_url"))
             .where(F.col("document_url").isNotNull()))


# ------------------------------------------------------------------ K2 summaries, H34 profiles

def summarise_hook(df: DataFrame, fn: Callable[[str], str], text_col: str = "text", out_col: str = "summary",
                   attempts: int = 5, wait_s: float = 10.0) -> DataFrame:
    """K2: a user summariser run per Arrow batch with a bounded retry per item; NULL after the last failure."""
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType(list(df.schema.fields) + [StructField(out_col, StringType())])

    def one(t):
        for i in range(attempts):
            try:
                return fn(t)
            except Exception:  # noqa: BLE001 - the summariser is user code
                if i + 1 < attempts:
                    time.sleep(wait_s)
        return None

    def run(batches):
        for pdf in batches:
            pdf[out_col] = [one(t) for t in pdf[text_col]]
            yield pdf
    return df.mapInPandas(run, schema)


def profile_text(symbols: DataFrame, profiles: DataFrame, default_sectors: str, key: str = "symbol") -> DataFrame:
    """C15 + H34: sector lookup with a fallback text, rendered into the profile template."""
    j = symbols.join(profiles.select(key, "sectors"), key, "left")
    sectors = F.coalesce(F.col("sectors"), F.lit(default_sectors))
    fmt = PROFILE_TEMPLATE.replace("{sectors}", "%1$s").replace("{ticker}", "%2$s")
    return j.select(key, F.format_string(fmt, sectors, F.col(key)).alias("profile"))
