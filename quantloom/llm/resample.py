"""Importance resampling of a corpus towards a target distribution.

Texts become hashed bags of word n-grams.  A bucket's gain is the smoothed log ratio of
its share in the target texts to its share in the corpus; a document's weight is the mean gain of
its features, and Gumbel noise drawn from its id turns "the highest scores" into a sample without
replacement.

1. *Counts.*  Every task adds its texts' features up per bucket and emits one row per bucket it met.
2. *Array-scored weights.*  The gains are one array of ``buckets`` longs; a text is scored by looking its
   features' buckets up in it.  Scores are written once (``scored``).
3. *Threshold bisection.*  Exact count jobs over the written scores halve the range of the score until the
   cutoff is found, then the range of doc_id among the rows tied at the cutoff, then that of a text hash
   and of the row number of the written table, so exactly the wanted number of rows is drawn whatever the ties.  A job settles
   ``HALVINGS`` halvings at once.  Nothing is sorted for it.
4. *Ranks.*  Only drawn rows are range-partitioned by (score, doc_id, ...) and sorted; a
   partition's rows are counted, and prefix sums of the counts turn places into ranks.

Defined cases: null and empty texts have no words, no features, weight 0 and are never drawn (they have fewer
than ``min_words`` words); a null doc_id draws its noise from an empty id and comes last among ties; rows that
repeat a doc_id are drawn one by one, those that tie in score and id in the order of a hash of their text;
texts of any length are read in pieces of ``PIECE`` bytes; an empty corpus gives an empty result and an empty
target gives every bucket the gain of an absent one; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.batches import small, text_hashes
from quantloom.session import cut_lineage

BUCKETS = 10_000
MAX_GRAM = 2
MIN_WORDS = 20
PERCENT = 25
SEED = 7
PIECE = 1 << 22          # bytes of a text that are cut into words at once
HALVINGS = 4             # of a range, per count job

# bytes of words: digits, a-z and everything outside ASCII; A-Z become a-z, the rest a space
_WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
                    for c in range(256))


def _pieces(text: bytes):
    """Lists of words, in order; a piece ends where a word ends."""
    text = text.translate(_WORD_BYTES)
    at = 0
    while at < len(text):
        end = len(text) if at + PIECE >= len(text) else text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def feature_buckets(text: bytes, buckets: int = BUCKETS, max_gram: int = MAX_GRAM):
    """Bucket arrays of the text's word n-grams, piece by piece, and before each the number of its words.

    The checksum of an n-gram continues that of its first n - 1 words, so no n-gram is ever joined.
    """
    before: list[bytes] = []                     # last words of the pieces before
    for words in _pieces(text):
        if not words:
            continue
        run, fresh = before + words, len(before)
        spaced = [b" " + w for w in run]
        sums, found = list(map(crc32, run)), []
        for n in range(1, max_gram + 1):
            if n > 1:
                sums = list(map(crc32, spaced[n - 1:], sums))        # the n-gram that starts at each word
            # those whose last word is new
            found.append(np.array(sums[max(0, fresh - n + 1):], np.int64))
        before = run[len(run) - max_gram + 1:] if max_gram > 1 else []
        yield len(words), np.concatenate(found) % buckets


def _counts(buckets: int, max_gram: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in small(batches):
            for text in batch.column(0):
                if text.is_valid:
                    for _, found in feature_buckets(text.as_buffer().to_pybytes(), buckets, max_gram):
                        total += np.bincount(found, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])
    return run


def _binary(text):
    return text.cast("string").cast("binary").alias("text")


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS,
                  max_gram: int = MAX_GRAM) -> np.ndarray:
    """Features per bucket over all texts: an array of ``buckets`` longs."""
    rows = (texts.select(_binary(texts[text_col])).mapInArrow(_counts(buckets, max_gram), "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas())           # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of target share to corpus share, per bucket."""
    k = len(corpus)
    s_all, t_all = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise of a document, in thousandths, floored."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scores(gain: np.ndarray, max_gram: int, seed: int):
    def run(batches):
        for batch in small(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = n = total = 0
                if text.is_valid:
                    for more, found in feature_buckets(text.as_buffer().to_pybytes(), len(gain), max_gram):
                        words, n, total = words + more, n + len(found), total + int(gain[found].sum())
                weight = total // n if n else 0
                out.append((words, n, weight, weight + noise(doc_id, seed)))
            cols = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), *cols],
                                             ["doc_id", "tie", "n_words", "n_features", "weight", "score"])
    return run


def scored(docs: DataFrame, gain: np.ndarray, max_gram: int = MAX_GRAM, seed: int = SEED, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One written row per document: doc_id, n_words, n_features, weight, score, and the tie keys ``tie``, ``row``."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_hashes(docs[text_col])[1].alias("tie"),
                       _binary(docs[text_col]))
    rows = rows.mapInArrow(_scores(gain, max_gram, seed),
                           "doc_id long, tie long, n_words long, n_features long, weight long, score long")
    return cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()), "resample_scored")


# order of drawing, every key rising; null ids last
_NULL_LAST = (1 << 63) - 1
_KEYS = {"down": "-score", "id": f"coalesce(doc_id, {_NULL_LAST})", "tie": "tie", "row": "row"}


def _least(rows: DataFrame, key: str, wanted: int) -> tuple[int, int]:
    """The smallest value v of the integer column with at least ``wanted`` rows <= v, and the rows < v."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    below = 0
    while low < high:
        cuts = sorted({low + (high - low) * k // (1 << HALVINGS) for k in range(1, 1 << HALVINGS)} - {high})
        inside = rows.where((F.col(key) >= low) & (F.col(key) <= high))
        counts = inside.agg(*[F.count(F.when(F.col(key) <= c, 1)) for c in cuts]).first()
        at_least = [k for k, n in enumerate(counts) if below + n >= wanted]
        k = at_least[0] if at_least else len(cuts)
        below += counts[k - 1] if k else 0
        low, high = (cuts[k - 1] + 1 if k else low), (cuts[k] if k < len(cuts) else high)
    return low, below


def drawn_condition(rows: DataFrame, wanted: int):
    """Condition that holds for exactly the first ``wanted`` rows in the order of the keys (all keys: unique)."""
    found, same = F.lit(False), F.lit(True)
    for name in _KEYS:
        if wanted <= 0:
            break
        cut, below = _least(rows.where(same), name, wanted)
        found = found | (same & (F.col(name) < cut))
        same, wanted = same & (F.col(name) == cut), wanted - below
    return (found | same) if wanted > 0 else found


def ranked(drawn: DataFrame) -> DataFrame:
    """``drawn`` with ``rank`` (1, 2, 3... in the order of the keys), by range partitions and prefix sums."""
    placed = (drawn.repartitionByRange(*_KEYS).sortWithinPartitions(*_KEYS)
              .withColumn("_place", F.monotonically_increasing_id()))
    placed = cut_lineage(placed.withColumns({"_part": F.shiftright("_place", 33),
                                             "_place": F.col("_place").bitwiseAND((1 << 33) - 1)}), "resample_ranked")
    before, sums = 0, {}
    for part, n in sorted(map(tuple, placed.groupBy("_part").count().collect())):     # one row per partition
        sums[part], before = before, before + n
    if not sums:
        return placed.withColumn("rank", F.lit(None).cast("long")).drop("_part", "_place")
    offset = placed.sparkSession.createDataFrame(list(sums.items()), "_p long, _offset long")
    out = placed.join(F.broadcast(offset), F.col("_part") == F.col("_p"))
    return out.withColumn("rank", F.col("_offset") + F.col("_place") + 1).drop("_part", "_place", "_p", "_offset")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
             buckets: int = BUCKETS, max_gram: int = MAX_GRAM, seed: int = SEED, id_col: str = "doc_id",
             text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null unless drawn), n_words.

    Drawn are floor(percent * N / 100) of the N documents with at least ``min_words`` words.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, max_gram),
                 bucket_counts(target, target_col, buckets, max_gram))
    rows = scored(docs, gain, max_gram, seed, id_col, text_col)
    rows = rows.withColumns({"down": F.expr(_KEYS["down"]), "id": F.expr(_KEYS["id"])})
    able = rows.where(F.col("n_words") >= min_words)
    takes = (F.col("n_words") >= min_words) & drawn_condition(able, percent * able.count() // 100)
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    rest = rows.where(~takes).withColumn("rank", F.lit(None).cast("long"))
    return ranked(rows.where(takes)).select(*columns).unionByName(rest.select(*columns))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, with all their columns (documents are told apart by their id)."""
    id_col = options.get("id_col", "doc_id")
    chosen = (resample(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn"))
              .distinct())
    return docs.join(chosen, docs[id_col].cast("long").eqNullSafe(chosen["_drawn"]), "left_semi")
