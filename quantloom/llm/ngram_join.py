"""Jaccard join of documents on their word n-grams, by rare-first prefix filtering.

A document is the set of its distinct word n-grams (64-bit hashes).  Two documents link when
their sets' Jaccard similarity reaches ``percent`` / 100, compared in whole numbers.

1. *Rare first.*  Documents' n-grams are counted in ``SLOTS`` hash slots, over all documents (a table of
   fixed size; a slot's count is never below that of an n-gram in it).  An n-gram's id is its hash with the
   slot replaced by the slot's place in the order of rising counts, so sorting ids puts rare n-grams first.
2. *Equal sets* (equal 128-bit hash of their ids) fold into one set with its number of copies.
3. *Prefix filter.*  Sets that link share one of their ``n - ceil(t n) + 1`` rarest n-grams.  Prefix n-grams
   are counted first (combined before the shuffle); those that one set alone holds go.
4. *Length and positional filters* are conditions of the join of the prefixes on their n-gram; a pair that
   meets in several n-grams becomes one row with the places of the first.
5. *Suffix filter.*  What follows the common n-gram is cut by fixed pivots into ``REGIONS`` regions; the smaller
   counts, region by region, bound what the two can still have in common.
6. *Hot n-grams*, in more than ``HOT`` prefixes, are never joined with themselves: their sets meet in blocks of bounded
   size, a task applies the same filters to all pairs of two blocks and emits one tie per set, never a pair.
7. *Verification, once per pair.*  Pairs and ties make clusters.  A cluster's sets, read again from their texts, meet
   in one task; a large cluster is cut into bands of size (sets that link are in the same or in adjoining
   bands) and these into blocks of bounded size, and every two blocks that can hold a link meet in a task.  A task
   compares all pairs by the bits of their sets and emits, per set, its links' number and one edge to the
   smallest set it reaches there: never a pair.
8. The edges' components give every document its class.

Sets and verification run in Arrow batches; candidates, counting, joins and components are Spark's.

Defined cases: null, empty and blank texts have no n-grams and link with nothing, not even with each other; a text
of fewer words than ``size`` is one n-gram; rows that repeat a doc_id are documents of their own; a null
doc_id is carried and never chosen as component_id unless its component holds no other; texts of any length are
cut into words in pieces; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.batches import small, text_hashes
from quantloom.llm.filters import probably_among
from quantloom.llm.graph import components
from quantloom.session import cut_lineage

SIZE = 3
PERCENT = 90
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
REGIONS = 64
HOT = 64                  # prefixes that may share an n-gram and still meet pair by pair
TIE_SETS = 2_048          # sets of a block of a hot n-gram
BLOCK_SETS = 512          # sets and n-grams of a block of a large cluster
BLOCK_GRAMS = 1 << 20
COLUMNS = 8_192           # n-grams whose bits a task holds at once
PIECE = 1 << 22           # bytes of a text that are cut into words at once
CACHE_WORDS = 150_000

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    """word -> 64-bit hash; forgets everything when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (state ^ (state >> np.uint64(29))) * _MIX1 + word
    return (x ^ (x >> np.uint64(32))) * _MIX2


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    state = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        state = _mixed(state, words[k:len(words) - size + 1 + k])
    return state ^ (state >> np.uint64(31))


def gram_hashes(text: bytes, size: int = SIZE, cache: _WordHashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams (A-Z lower-cased, words between ASCII white space)."""
    cache = _WordHashes() if cache is None else cache
    found, before, at = [], np.empty(0, np.uint64), 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        words = text[at:end].lower().split()
        run = np.concatenate([before, np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))])
        if len(run) >= size:
            found.append(np.unique(_grams(run, size)))
            before = run[len(run) - size + 1:] if size > 1 else run[:0]
        else:
            before = run
        at = end
    if not found:
        return _grams(before, len(before)) if len(before) else before
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _slot_counts(size: int):
    def run(batches):
        counts, cache = np.zeros(SLOTS, np.int64), _WordHashes()
        for batch in small(batches):
            for text in batch.column(0):
                if text.is_valid:
                    grams = gram_hashes(text.as_buffer().to_pybytes(), size, cache)
                    counts += np.bincount((grams & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(counts[there])], ["slot", "n"])
    return run


def rarity_order(texts: DataFrame, size: int = SIZE) -> np.ndarray:
    """Place of every slot in the order of rising counts."""
    rows = (texts.select("text").mapInArrow(_slot_counts(size), "slot int, n long")
            .groupBy("slot").agg(F.sum("n").alias("n")).toArrow())              # at most SLOTS rows
    n = np.zeros(SLOTS, np.int64)
    n[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    place = np.empty(SLOTS, np.uint32)
    place[np.argsort(n, kind="stable")] = np.arange(SLOTS, dtype=np.uint32)
    return place


def _ids(grams: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Sorted ids; as distinct as the hashes."""
    top = place[(grams & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64)
    return np.sort((top << np.uint64(64 - SLOT_BITS)) | (grams >> np.uint64(SLOT_BITS)))


def _key(ids: np.ndarray) -> tuple[int, int]:
    k = xxhash.xxh3_128_intdigest(memoryview(ids.tobytes()))
    return (k >> 64) - (1 << 63), (k & (1 << 64) - 1) - (1 << 63)


def _regions(ids: np.ndarray) -> np.ndarray:
    return np.bincount((ids & np.uint64(REGIONS - 1)).astype(np.int64), minlength=REGIONS).astype(np.int32)


def _sets(place: np.ndarray, size: int, percent: int):
    """Set key, size, prefix and region counts of what follows the prefix."""
    def run(batches):
        cache = _WordHashes()
        for batch in small(batches):
            keys, n, prefixes, regions = [], [], [], []
            for text in batch.column("text"):
                ids = _ids(gram_hashes(text.as_buffer().to_pybytes(), size, cache), place) if text.is_valid else ()
                m = len(ids)
                # sets too small to link with any other have no prefix
                p = m - -(-percent * m // 100) + 1 if m * (100 - percent) >= percent else 0
                keys.append(_key(ids) if m else (0, 0))
                n.append(m)
                prefixes.append(ids[:p].view(np.int64) if p else np.empty(0, np.int64))
                regions.append(_regions(ids[p:]).tobytes() if p else b"")
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes], dtype=np.int64)]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            k1, k2 = zip(*keys) if keys else ((), ())
            own = [batch.column(c) for c in ("doc_id", "doc", "h")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(regions, pa.binary())],
                ["doc_id", "doc", "h", "k1", "k2", "n", "prefix", "regions"])
    return run


def _suffix(at: int, prefix: np.ndarray, regions: bytes) -> np.ndarray:
    """Region counts of what follows a prefix n-gram."""
    return np.frombuffer(regions, np.int32) + _regions(prefix[at + 1:].view(np.uint64))


def _suffix_filter(percent: int):
    """Pairs that may still reach the similarity, by what follows their first common n-gram."""
    def run(batches):
        for batch in batches:
            ok = []
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in
                    ("na", "nb", "ia", "ib", "prefix_a", "prefix_b", "regions_a", "regions_b")]
            for na, nb, ia, ib, pa_, pb_, ra, rb in zip(*cols):
                most = min(ia, ib) + 1 + int(np.minimum(_suffix(ia, pa_, ra), _suffix(ib, pb_, rb)).sum())
                ok.append(most * (100 + percent) >= percent * (int(na) + int(nb)))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _suffixes(batches):
    """Rows of hot n-grams with the region counts of what follows."""
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "prefix", "regions")]
        found = [_suffix(i, p, r).astype(np.int32).tobytes() for i, p, r in zip(*cols)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cluster", "sid", "n", "i")),
                                          pa.array(found, pa.binary())], ["cluster", "sid", "n", "i", "suffix"])


def _union(root: np.ndarray, members: np.ndarray) -> None:
    merged = np.unique(root[members])
    if len(merged) > 1:
        root[np.isin(root, merged)] = merged[0]


def _tie(percent: int):
    """Of the rows of a hot n-gram in one pair of blocks: every set and the smallest one it reaches through pairs that pass
    the length, positional and suffix filters."""
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["n"].to_numpy(), kind="stable")
        sid, n, at = (table[c].to_numpy()[order].astype(np.int64) for c in ("sid", "n", "i"))
        after = np.frombuffer(b"".join(table["suffix"].take(pa.array(order)).to_pylist()), np.int32).reshape(len(n), -1)
        side = None if table["whole"][0].as_py() else table["on_left"].to_numpy()[order]
        root = np.arange(len(n))
        for k in range(len(n) - 1):
            js = np.arange(k + 1, np.searchsorted(n, 100 * n[k] // percent, "right"))
            js = js[root[js] != root[k]]
            if side is not None:
                js = js[side[js] != side[k]]
            need, before = percent * (n[k] + n[js]), np.minimum(at[k], at[js])
            js = js[(before + np.minimum(n[k] - at[k], n[js] - at[js])) * (100 + percent) >= need]
            most = np.minimum(at[k], at[js]) + 1 + np.minimum(after[js], after[k]).sum(axis=1)
            js = js[most * (100 + percent) >= percent * (n[k] + n[js])]
            if len(js):
                _union(root, np.append(js, k))
        least = np.full(len(n), np.iinfo(np.int64).max)
        np.minimum.at(least, root, sid)
        tied = least[root] < sid
        return pa.table({"a": pa.array(least[root][tied]), "b": pa.array(sid[tied])})
    return run


def linked(sets: list[np.ndarray], side: np.ndarray | None, percent: int):
    """(i, array of j): links of set i to sets after it in the order of rising size; with ``side``, across sides only.

    Common n-grams are counted from bits, ``COLUMNS`` n-grams that several of the sets hold at a time.
    """
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    n = n[order]
    _, column, count = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(n)), n)
    several = (count > 1)[column]
    owner, column = owner[several], (np.cumsum(count > 1) - 1)[column[several]]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    last = np.searchsorted(n, 100 * n // percent, "right")              # length filter
    common = np.zeros((len(n), len(n)), np.int32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        held = np.zeros((len(n), COLUMNS), bool)
        held[owner[part], column[part] - low] = True
        bits = np.packbits(held, axis=1).view(np.uint64)
        for i in range(len(n) - 1):
            js = slice(i + 1, last[i])
            common[i, js] += np.bitwise_count(bits[js] & bits[i]).sum(axis=1, dtype=np.int32)
    for i in range(len(n) - 1):
        js = np.arange(i + 1, last[i])
        if side is not None:
            js = js[side[order[js]] != side[order[i]]]
        js = js[100 * common[i, js] >= percent * (n[i] + n[js] - common[i, js])]
        if len(js):
            yield order[i], order[js]


def _verify(size: int, percent: int):
    """Of the sets of one pair of blocks: sid, the smallest sid it reaches by links there, copies linked with it."""
    cache = _WordHashes()

    def run(table: pa.Table) -> pa.Table:
        sid = table["sid"].to_numpy()
        copies = table["copies"].to_numpy()
        sets = [gram_hashes(t.as_buffer().to_pybytes(), size, cache) for t in table["text"]]
        side = None if table["whole"][0].as_py() else table["on_left"].to_numpy()
        root, links = np.arange(len(sid)), np.zeros(len(sid), np.int64)
        for i, js in linked(sets, side, percent):
            links[i] += copies[js].sum()
            links[js] += copies[i]
            _union(root, np.append(js, i))
        least = np.full(len(sid), np.iinfo(np.int64).max)
        np.minimum.at(least, root, sid)
        there = links > 0
        return pa.table({"a": pa.array(sid[there]), "b": pa.array(least[root][there]), "links": pa.array(links[there])})
    return run


def _blocks(members: DataFrame, percent: int, most_sets: int, most_grams: int) -> DataFrame:
    """``members`` (cluster, sid, n, ...) with ``met``, a row for every pair of blocks that a set belongs to.

    A cluster is cut into bands of size and these into blocks; small clusters are one block.
    """
    step = np.log(100 / percent) if percent < 100 else 1.0
    # a little wider than the length filter's ratio, so that linked sets are never two bands apart
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(step * 1.000001))).cast("int")
    whole = members.groupBy("cluster").agg(
        ((F.sum("n") <= most_grams) & (F.count("*") <= most_sets)).alias("tiny"))
    banded = members.join(whole, "cluster").withColumn("band", F.when(F.col("tiny"), F.lit(0)).otherwise(band))
    sizes = banded.groupBy("cluster", "band").agg(
        F.greatest(F.ceil(F.sum("n") / most_grams), F.ceil(F.count("*") / most_sets)).cast("int").alias("blocks"))
    near = [sizes.select("cluster", (F.col("band") + d).alias("band"), F.col("blocks").alias(name))
            for d, name in ((-1, "above"), (1, "below"))]
    around = sizes.join(near[0], ["cluster", "band"], "left").join(near[1], ["cluster", "band"], "left")
    placed = banded.join(around, ["cluster", "band"])
    placed = placed.withColumn("block", F.expr("cast(pmod(xxhash64(sid), blocks) as int)"))
    return placed.withColumn("met", F.explode(F.expr(_MEETINGS))).select(*members.columns, "met.*")


# the pairs of blocks that a set belongs to: own band, the band above, the band below
_MEETINGS = """flatten(array(
  transform(sequence(0, blocks - 1), k -> struct(band as b1, least(block, k) as i1, band as b2, greatest(block, k) as i2,
                                                 block <= k as on_left, k = block as whole)),
  if(above is null, array(), transform(sequence(0, above - 1), k -> struct(band as b1, block as i1, band + 1 as b2, k as i2,
                                                                          true as on_left, false as whole))),
  if(below is null, array(), transform(sequence(0, below - 1), k -> struct(band - 1 as b1, k as i1, band as b2, block as i2,
                                                                          false as on_left, false as whole)))))"""


_MET = ["b1", "i1", "b2", "i2"]
_NO_LIMIT = 1 << 62


class _Join:
    """The steps of one join over ``docs`` (doc_id, doc, h, text): ``doc`` is the id with a value for null."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.docs, self.size, self.percent = docs, size, percent
        self.place = rarity_order(docs, size)
        self.rows = cut_lineage(docs.mapInArrow(
            _sets(self.place, size, percent),
            "doc_id long, doc long, h long, k1 long, k2 long, n int, prefix array<long>, regions binary"), "ngram_rows")
        # (doc, h) in one value of fixed width, for hash aggregates: the copy whose text is read again
        at = F.expr(f"cast(cast(doc as decimal(38,0)) * {1 << 62} + h as decimal(38,0))")
        folded = (self.rows.where("n > 0").withColumn("at", at).groupBy("k1", "k2", "n", "prefix", "regions")
                  .agg(F.min_by("doc", "at").alias("doc"), F.min_by("h", "at").alias("h"),
                       F.count("*").alias("copies"), F.min("doc_id").alias("least")))
        self.sets = cut_lineage(folded.withColumn("sid", F.monotonically_increasing_id()), "ngram_sets", drop_shuffles=True)

    def candidates(self) -> DataFrame:
        """(a, b): candidate pairs, and a tie of every set with a hot n-gram to the smallest such set."""
        prefixes = self.sets.select("sid", "n", F.posexplode("prefix").alias("i", "gram"))
        shared = cut_lineage(prefixes.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1"), "ngram_shared", drop_shuffles=True)
        post = cut_lineage(prefixes.join(shared, "gram"), "ngram_postings", drop_shuffles=True)
        cold = post.where(F.col("m") <= HOT)
        a, b = (cold.select("gram", F.col("sid").alias(s), F.col("n").alias(f"n{s}"), F.col("i").alias(f"i{s}"))
                for s in "ab")
        t = self.percent
        pairs = a.join(b, "gram").where(
            F.expr("a < b")
            & F.expr(f"100 * least(na, nb) >= {t} * greatest(na, nb)")
            & F.expr(f"(least(ia, ib) + least(na - ia, nb - ib)) * {100 + t} >= {t} * (na + nb)"))
        pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.min("ia").alias("ia"), F.min("ib").alias("ib"))
        for s in "ab":
            own = self.sets.select(F.col("sid").alias(s), F.col("prefix").alias(f"prefix_{s}"),
                                   F.col("regions").alias(f"regions_{s}"))
            pairs = pairs.join(own, s)
        near = pairs.mapInArrow(_suffix_filter(t), "a long, b long")
        hot = post.where(F.col("m") > HOT).select(F.col("gram").alias("cluster"), "sid", "n", "i")
        hot = hot.join(self.sets.select("sid", "prefix", "regions"), "sid").mapInArrow(
            _suffixes, "cluster long, sid long, n int, i int, suffix binary")
        hot = cut_lineage(hot, "ngram_hot", drop_shuffles=True)
        ties = _blocks(hot, t, TIE_SETS, _NO_LIMIT).groupBy("cluster", *_MET).applyInArrow(_tie(t), "a long, b long")
        return near.unionByName(ties).distinct()

    def links(self) -> DataFrame:
        """(a, b, links): of every set with links, edges that keep its component together and the documents it links."""
        clusters = components(self.candidates(), "ngram_clusters")
        members = cut_lineage(clusters.join(self.sets, clusters.node == self.sets.sid).select(
            F.col("root").alias("cluster"), "sid", "n", "copies", "doc", "h"), "ngram_members", drop_shuffles=True)
        texts = probably_among(self.docs.where("text IS NOT NULL"), "doc, h", members)
        texts = texts.groupBy("doc", "h").agg(F.first("text").alias("text"))        # of rows that repeat both, one
        met = _blocks(members, self.percent, BLOCK_SETS, BLOCK_GRAMS)
        met = met.select("cluster", "sid", "copies", "doc", "h", *_MET, "on_left", "whole").join(texts, ["doc", "h"])
        found = met.drop("doc", "h").groupBy("cluster", *_MET).applyInArrow(
            _verify(self.size, self.percent), "a long, b long, links long")
        return cut_lineage(found, "ngram_links", drop_shuffles=True)

    def classes(self) -> DataFrame:
        """One row per document: doc_id, n_shingles, component_id, n_links."""
        links = self.links()
        roots = components(links.select("a", "b"), "ngram_classes")
        counts = links.groupBy("a").agg(F.sum("links").alias("links"))
        sets = (self.sets.join(roots, F.col("sid") == F.col("node"), "left")
                .join(counts, F.col("sid") == F.col("a"), "left")
                .select("k1", "k2", "n", "least", F.coalesce("root", "sid").alias("root"),
                        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
        least = sets.groupBy("root").agg(F.min("least").alias("component_id"))
        named = sets.join(least, "root").select("k1", "k2", "component_id", "n_links")
        some = (self.rows.where("n > 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "k1", "k2")
                .join(named, ["k1", "k2"]).drop("k1", "k2"))
        none = self.rows.where("n = 0").select(
            "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"),
            F.lit(0).cast("long").alias("n_links"))
        return some.unionByName(none)


_LOWEST = -(1 << 63)


def near_classes(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles (set size), component_id (smallest doc_id reachable by
    links, itself included), n_links (documents linked with it)."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"),
                      F.coalesce(docs[id_col].cast("long"), F.lit(_LOWEST)).alias("doc"),
                      text_hashes(docs[text_col])[0].alias("h"),
                      docs[text_col].cast("string").cast("binary").alias("text"))
    return _Join(own, size, percent).classes()
