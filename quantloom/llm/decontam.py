"""Benchmark decontamination: a BM25 index of the test items, queried by every training passage.

Documents are cut into passages of ``2 * stride`` words every ``stride`` words,
``stride`` being the longest item's word count, so an item that a document
holds lies whole in one passage.  Each passage is a query; block-max WAND
retrieves every item whose BM25 score is at least ``threshold`` of the item's own
full score.  Retrieved pairs are verified: the share of the question's
five-word shingles and the share of the answer's words that the passage holds must both reach
their limits.  The answer is an item's last sentence, the question what stands before it.  For an answer
below five words the share of the whole item's shingles counts where it is higher.

Before WAND a bound is taken over all passages of a batch at once: the terms of
highest document frequency can give an item at most a fixed sum, so a passage whose exact sum over the
other terms stays below the rest of the threshold for every item cannot
reach it.  The bound drops no pair that WAND would return.

The index holds the test items, a table of its own that does not grow with the
documents.  Up to ``max_index_words`` words (checked by a count) it goes to the executors
in one piece; larger benchmarks are indexed and queried in parts of that size, one after
another, each over all passages, with the document frequencies, mean length and longest item of all
items, so scores and passages do not depend on the number of parts.

Defined cases: null and empty texts hold no passage; items without words
are never matched; equal items all match; repeated rows give equal rows; an empty
benchmark or table gives no rows; items with a null item_id are matched like any other and reported with it; a
document to remove is a doc_id (null or not) with a text, so other rows of its id stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.batches import small, text_hashes
from quantloom.session import cut_lineage

THRESHOLD = 0.6
QUESTION_OVERLAP = 0.5
ANSWER_OVERLAP = 0.8
SHINGLE = 5
BLOCK = 16
K1, B = 1.2, 0.75
COMMON_SHARE = 0.5       # of the threshold that the common terms together may give an item
MAX_INDEX_WORDS = 2_000_000
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.?!\n]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words before the last sentence, and its words; a single sentence gives up its last quarter."""
    parts = [w for w in (words_of(s) for s in _SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - max(1, len(words) // 4) if words else 0
    return words[:cut], words[cut:]


def shingles(words: list[str], size: int = SHINGLE) -> set:
    """All runs of ``size`` words; a shorter text is one run."""
    size = min(size, len(words))
    return set(zip(*(words[k:] for k in range(size)))) if size else set()


class BlockMaxIndex:
    """Postings with the largest impact of every block; impacts are shares of an item's own full score."""

    def __init__(self, items: list[tuple[int, str]], block: int = BLOCK, threshold: float = THRESHOLD,
                 whole: tuple | None = None):
        """``whole``: number, mean length and longest length of all items, and document frequencies, where ``items`` are a part."""
        self.items = [(i, t) for i, t in items if words_of(t or "")]
        self.threshold = threshold
        bags = [Counter(words_of(t)) for _, t in self.items]
        lengths = [sum(b.values()) for b in bags]
        n, mean, self.longest, df = whole or (
            len(bags), sum(lengths) / max(1, len(bags)), max(lengths, default=0), Counter(w for b in bags for w in b))
        idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
        self.postings: dict[str, list] = {}
        for k, bag in enumerate(bags):
            own = {w: idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[k] / mean)) for w, tf in bag.items()}
            full = sum(own.values())
            for w, x in own.items():
                self.postings.setdefault(w, []).append((k, x / full))
        self.blocks = {w: [(p[min(len(p), s + block) - 1][0], max(x for _, x in p[s:s + block]))
                           for s in range(0, len(p), block)] for w, p in self.postings.items()}
        self.block = block
        self.tops = {w: max(x for _, x in p) for w, p in self.postings.items()}
        self._split_common(len(self.items))
        self.qa = [question_and_answer(t) for _, t in self.items]
        self.q_shingles = [shingles(q) for q, _ in self.qa]
        self.answers = [set(a) for _, a in self.qa]
        self.all_shingles = [shingles(q + a) if len(a) < SHINGLE else set() for q, a in self.qa]

    def _split_common(self, n: int) -> None:
        """Terms by falling document frequency are common while no item gets over the set share from them."""
        given = np.zeros(n)
        order = sorted(self.postings, key=lambda w: (-len(self.postings[w]), w))
        rare = []
        for k, w in enumerate(order):
            after = given.copy()
            for item, x in self.postings[w]:
                after[item] += x
            if after.max() > COMMON_SHARE * self.threshold:
                rare = order[k:]
                break
            given = after
        self.common_part = given
        self.rare = {w: k for k, w in enumerate(rare)}
        sizes = [len(self.postings[w]) for w in rare]
        self.rare_first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flat = [p for w in rare for p in self.postings[w]]
        self.rare_item = np.array([p[0] for p in flat], np.int64)
        self.rare_impact = np.array([p[1] for p in flat], float)

    def may_reach(self, term: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """Passages (numbers) that can reach the threshold, from their rare terms."""
        n_terms, n_items = len(self.rare), len(self.items)
        key = np.unique(passage * n_terms + term)
        passage, term = key // n_terms, key % n_terms
        first, size = self.rare_first[term], self.rare_first[term + 1] - self.rare_first[term]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        pair = np.repeat(passage, size) * n_items + self.rare_item[at]
        pairs, where = np.unique(pair, return_inverse=True)
        total = np.bincount(where, self.rare_impact[at]) + self.common_part[pairs % n_items]
        return np.unique(pairs[total >= self.threshold - 1e-9] // n_items)

    def retrieve(self, terms: set) -> list[tuple[int, float]]:
        """Block-max WAND: every (item number, score) with score >= threshold."""
        least, found = self.threshold - 1e-9, []
        cursors = [[self.postings[w], 0, w] for w in terms if w in self.postings]
        here = lambda c: c[0][c[1]][0]
        cursors.sort(key=here)

        def move(c, item):
            """To the first posting at or behind ``item``, skipping whole blocks."""
            p, blocks = c[0], self.blocks[c[2]]
            b = c[1] // self.block
            while b < len(blocks) and blocks[b][0] < item:
                b += 1
            c[1] = max(c[1], b * self.block)
            while c[1] < len(p) and p[c[1]][0] < item:
                c[1] += 1

        while cursors:
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += self.tops[c[2]]
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                break
            item = here(cursors[pivot])
            while pivot + 1 < len(cursors) and here(cursors[pivot + 1]) == item:
                pivot += 1
            ahead = cursors[:pivot + 1]
            block_bound, ends = 0.0, []
            for c in ahead:
                blocks, b = self.blocks[c[2]], c[1] // self.block
                while b < len(blocks) and blocks[b][0] < item:
                    b += 1
                if b < len(blocks):
                    block_bound += blocks[b][1]
                    ends.append(blocks[b][0])
            if block_bound < least:
                # nothing up to the nearest block end, or the next cursor, can reach the threshold
                to = min(ends) + 1
                if pivot + 1 < len(cursors):
                    to = min(to, here(cursors[pivot + 1]))
                to = max(to, item + 1)
                moved = ahead
            elif here(cursors[0]) == item:
                score = sum(c[0][c[1]][1] for c in ahead)
                if score >= least:
                    found.append((item, score))
                to, moved = item + 1, ahead
            else:
                to, moved = item, [c for c in ahead if here(c) < item]
            for c in moved:
                move(c, to)
            cursors = sorted((c for c in cursors if c[1] < len(c[0])), key=here)
        return found

    def verify(self, item: int, words: list[str]) -> tuple[float, float]:
        """Shares of the question's shingles and of the answer that ``words`` hold (``answer_overlap``: of its words or,
        for answers of fewer words than a shingle, of the whole item's shingles, whichever is higher)."""
        q, a = self.q_shingles[item], self.answers[item]
        held = shingles(words, min(SHINGLE, len(self.qa[item][0])))
        answer = len(a & set(words)) / len(a) if a else 1.0
        every = self.all_shingles[item]
        if every and answer < 1:
            answer = max(answer, len(every & shingles(words, len(next(iter(every))))) / len(every))
        return (len(q & held) / len(q) if q else 1.0), answer


def _search(index: BlockMaxIndex, doc_ids: list, texts: list) -> list[tuple]:
    stride = index.longest
    docs = [words_of(t or "") for t in texts]
    passages, where, term = [], [], []     # passage number -> (document, first word)
    for d, words in enumerate(docs):
        if not words:
            continue
        hit = np.fromiter(map(index.rare.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(hit >= 0)
        first, last = len(passages), max(0, -(-len(words) // stride) - 2)
        passages += [(d, k * stride) for k in range(last + 1)]
        slot = at // stride
        for s in (slot, slot - 1):
            ok = (s >= 0) & (s <= last)
            where.append(first + s[ok])
            term.append(hit[at[ok]])
    if not where:
        return []
    best: dict = {}
    for p in index.may_reach(np.concatenate(term), np.concatenate(where)):
        d, at = passages[p]
        words = docs[d][at:at + 2 * stride]
        for item, score in index.retrieve(set(words)):
            q, a = index.verify(item, words)
            if q >= QUESTION_OVERLAP and a >= ANSWER_OVERLAP:
                key = d, item
                n, s, bq, ba = best.get(key, (0, 0.0, 0.0, 0.0))
                best[key] = n + 1, max(s, score), max(bq, q), max(ba, a)
    return [(doc_ids[d], index.items[i][0], min(1.0, s), q, a, n) for (d, i), (n, s, q, a) in best.items()]


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, n_passages long"
KEYS = "_h1 long, _h2 long"     # of the document's text, behind SCHEMA


def _match(sent):
    def run(batches):
        index = BlockMaxIndex(*sent.value)
        names = [c.split()[0] for c in f"{SCHEMA}, {KEYS}".split(", ")]
        kinds = [pa.int64()] * 2 + [pa.float64()] * 3 + [pa.int64()] * 3
        for batch in small(batches):
            ids, h1, h2, texts = (c.to_pylist() for c in batch.columns)
            rows = [(ids[d], *found, h1[d], h2[d]) for d, *found in _search(index, range(len(ids)), texts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
    return run


def _item_lengths(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(words_of(t or "")) for t in batch.column(0).to_pylist()], pa.int64())], ["n"])


def _item_words(batches):
    """Items that hold a word, by part."""
    for batch in small(batches):
        seen = Counter((p, w) for p, t in zip(*(c.to_pylist() for c in batch.columns)) for w in set(words_of(t or "")))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in seen], pa.int64()), pa.array([w for _, w in seen], pa.string()),
             pa.array(seen.values(), pa.int64())], ["_part", "word", "n"])


def _leaks(docs: DataFrame, benchmark: DataFrame, threshold: float, id_col: str, text_col: str,
           max_index_words: int) -> DataFrame:
    """The rows of ``find_leaks`` with the hashes of the document's text."""
    spark = docs.sparkSession
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"),
                             benchmark["text"].cast("string").alias("text"))
    n_items, n_words, longest = (items.select("text").mapInArrow(_item_lengths, "n long").where("n > 0")
                                 .agg(F.count("n"), F.sum("n"), F.max("n")).first())
    if not n_items:
        return spark.createDataFrame([], f"{SCHEMA}, {KEYS}")
    parts = math.ceil(n_words / max_index_words)
    dealt = items.withColumn("_part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    h1, h2 = text_hashes(docs[text_col])
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), h1, h2, docs[text_col].cast("string").alias("text"))
    shape = f"{SCHEMA}, {KEYS}"
    if parts > 1:
        counts = cut_lineage(dealt.select("_part", "text").mapInArrow(_item_words, "_part long, word string, n long")
                             .groupBy("_part", "word").agg(F.sum("n").alias("n")), "item_words")
        freqs = cut_lineage(counts.join(counts.groupBy("word").agg(F.sum("n").alias("df")), "word")
                            .select("_part", "word", "df"), "item_freqs")
    found = []
    for part in range(parts):
        one = sorted(((r["item_id"], r["text"]) for r in dealt.where(F.col("_part") == part).collect() if r["text"]),
                     key=lambda item: (item[0] is None, item[0] or 0, item[1]))
        if not any(words_of(t) for _, t in one):
            continue
        whole = None
        if parts > 1:
            df = dict(freqs.where(F.col("_part") == part).select("word", "df").collect())     # the part's words
            whole = n_items, n_words / n_items, longest, df
        sent = spark.sparkContext.broadcast((one, BLOCK, threshold, whole))     # at most about max_index_words words
        found.append(rows.mapInArrow(_match(sent), shape))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], shape)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
               text_col: str = "text", max_index_words: int = MAX_INDEX_WORDS) -> DataFrame:
    """One row per (document, test item) that a passage of the document gives away."""
    return _leaks(docs, benchmark, threshold, id_col, text_col, max_index_words).drop("_h1", "_h2")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                 text_col: str = "text", max_index_words: int = MAX_INDEX_WORDS) -> DataFrame:
    """The documents, with all their columns, that give no test item away."""
    leaks = _leaks(docs, benchmark, threshold, id_col, text_col, max_index_words).select(
        F.col("doc_id").alias("_leak"), F.col("_h1").alias("_l1"), F.col("_h2").alias("_l2")).distinct()
    leaks = cut_lineage(leaks, "leaks")      # a table of known size: the planner broadcasts it only when it is small
    h1, h2 = text_hashes(docs[text_col])
    return docs.join(leaks, docs[id_col].cast("long").eqNullSafe(leaks["_leak"]) & (h1 == leaks["_l1"]) & (h2 == leaks["_l2"]),
                     "left_anti")
