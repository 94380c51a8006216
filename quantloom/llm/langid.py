"""Language identification by word-first backoff.

A word seen in training is scored by its log frequency in every language.  An
unseen word falls back to its character n-grams (with ``_`` marking the word's
ends): at each place the longest known n-gram that starts there is taken, from
``MAX_GRAM`` characters down to one.  Every step down costs the same in all
languages, so only the frequencies decide.  A text's score for a language is
the sum over its words; the largest wins, ties go to the smaller language name.
``score`` is the winner's share of exp(sum) over the languages.

``fit`` reads at most about ``sample_docs`` labelled documents of each
language (the documented bound of the model: rows are taken by a hash of their
id, with a rate from the language's row count) and counts their whole texts in
Spark.  The model holds at most ``max_words`` words and ``max_grams`` n-grams, the
most frequent ones; it is what travels to the executors.

Words seen once in the whole sample are not learned (typing errors, names).

Defined cases: text null or without a letter gives ``und`` with score 0; a
model without languages gives ``und`` for every text; repeated rows get equal
predictions; rows with a null language are not learned from.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.batches import ROWS, give_back, small
from quantloom.session import cut_lineage

SAMPLE_DOCS = 1500
MAX_WORDS = 100_000
MAX_GRAMS = 60_000
MAX_GRAM = 4
CACHE_WORDS = 100_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    langs: list          # sorted language names
    words: dict          # word -> row of ``table``
    grams: dict          # n-gram -> row of ``table``
    table: np.ndarray    # log frequencies, one column per language


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; numerals such as ½ or ① are no letters."""
    out = []
    for w in _WORD.findall(text.lower()):
        if w.isalpha():
            out.append(w)
        else:
            out += "".join(c if c.isalpha() else " " for c in w).split()
    return out


def _grams_of(word: str, n: int) -> list[str]:
    marked = f"_{word}_"
    return [marked[k:k + n] for k in range(len(marked) - n + 1)] if n > 1 else list(word)


def _count(batches):
    """Word counts of a task, folded per batch."""
    for batch in small(batches):
        seen: dict = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen.setdefault(lang, Counter()).update(words_of(text or ""))
        rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
        cols = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()),
                                          pa.array(cols[2], pa.int64())], ["lang", "word", "n"])


def _gram_rows(batches):
    for batch in batches:
        seen: dict = {}
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            for size in range(1, MAX_GRAM + 1):
                for g in _grams_of(word, size):
                    seen[lang, g] = seen.get((lang, g), 0) + n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()),
             pa.array(list(seen.values()), pa.int64())], ["lang", "gram", "n"])


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        sample_docs: int = SAMPLE_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Learn from (text, lang) of the rows of ``train``; id is only the sampling key."""
    rows = train.select(train[lang_col].cast("string").alias("lang"), train[text_col].cast("string").alias("text"),
                        F.pmod(F.xxhash64(train[id_col].cast("string")), F.lit(1_000_000)).alias("_draw"))
    rows = rows.where(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], {}, {}, np.zeros((0, 0)))
    share = F.lit(-1)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(int(1_000_000 * min(1.0, sample_docs / n)))).otherwise(share)
    picked = rows.where(F.col("_draw") < share).select("lang", "text")
    counts = (picked.mapInArrow(_count, "lang string, word string, n long")
              .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    counts = cut_lineage(counts, "langid_words")
    grams = (counts.mapInArrow(_gram_rows, "lang string, gram string, n long")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    return _model(sorted(sizes), _most(counts, "word", max_words, 2), _most(grams, "gram", max_grams, 1))


def _most(counts: DataFrame, key: str, limit: int, least: int) -> list:
    """The ``limit`` most frequent keys with their counts by language (bounded, for the driver)."""
    by_key = (counts.groupBy(key).agg(F.sum("n").alias("total"), F.map_from_entries(
        F.collect_list(F.struct("lang", "n"))).alias("by")).where(F.col("total") >= least))
    return [(r[key], r["by"]) for r in by_key.orderBy(F.desc("total"), key).limit(limit).collect()]


def _model(langs: list, words: list, grams: list) -> Model:
    def logs(rows):
        n = np.array([[by.get(lang, 0) for lang in langs] for _, by in rows], float).reshape(len(rows), len(langs))
        total = n.sum(axis=0)
        # a language without words was not learned: it scores below every other
        return np.where(total > 0, np.log((n + 0.5) / (total + 0.5 * (len(rows) + 1))), -30.0)
    w, g = logs(words), logs(grams)
    for size in range(1, MAX_GRAM + 1):     # n-grams of one length share one distribution
        rows = [k for k, (x, _) in enumerate(grams) if len(x) == size]
        if rows:
            g[rows] = logs([grams[k] for k in rows])
    return Model(langs, {x: k for k, (x, _) in enumerate(words)},
                 {x: k + len(words) for k, (x, _) in enumerate(grams)}, np.vstack([w, g]))


class Scorer:
    """Predicts texts; remembers the vectors of unseen words up to ``CACHE_WORDS``, in a table that doubles."""

    def __init__(self, model: Model):
        self.model = model
        self.rows = dict(model.words)
        self.table = model.table.astype(np.float32)
        self.used = len(self.table)

    def _backoff(self, word: str) -> np.ndarray:
        marked, at, total = f"_{word}_", 0, np.zeros(len(self.model.langs))
        while at < len(marked):
            for size in range(min(MAX_GRAM, len(marked) - at), 0, -1):
                row = self.model.grams.get(marked[at:at + size])
                if row is not None:
                    total += self.model.table[row]
                    at += size
                    break
            else:
                at += 1
        return total

    def _learn(self, unseen: list[str]) -> None:
        if self.used + len(unseen) > len(self.table):
            grown = np.zeros((max(2 * len(self.table), self.used + len(unseen)), len(self.model.langs)), np.float32)
            grown[:self.used] = self.table[:self.used]
            self.table = grown
        for w in unseen:
            self.table[self.used] = self._backoff(w)
            self.rows[w] = self.used
            self.used += 1

    def predict_all(self, texts: list) -> list[tuple[str, float]]:
        found = [Counter(words_of(t or "")) for t in texts]
        if not self.model.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self.rows) > len(self.model.words) + CACHE_WORDS:
            self.rows, self.used = dict(self.model.words), len(self.model.table)
        self._learn(list({w for c in found for w in c if w not in self.rows}))
        out = []
        for c in found:
            if not c:
                out.append((UNKNOWN, 0.0))
                continue
            total = np.fromiter(c.values(), float, len(c)) @ self.table[[self.rows[w] for w in c]]
            best = int(total.argmax())
            out.append((self.model.langs[best], float(1.0 / np.exp(total - total[best]).sum())))
        return out


def with_language(docs: DataFrame, model: Model, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``name`` (lang_pred, score) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)   # bounded by max_words and max_grams

    @F.pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        give_back()
        scorer = Scorer(sent.value)
        try:
            for texts in batches:
                found = [x for k in range(0, len(texts), ROWS)
                         for x in scorer.predict_all(list(texts.iloc[k:k + ROWS]))]
                yield pd.DataFrame(found, columns=["lang_pred", "score"])
        finally:
            del scorer
            give_back()
    return docs.withColumn(name, guess(docs[text_col].cast("string")))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text"))
    return with_language(rows, model, "_found", "_text").select("doc_id", "_found.lang_pred", "_found.score")


def held_out(doc_id: Column) -> Column:
    """True for the documents that are never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0
