"""SimHash near-dedup by meet-in-the-middle ball hashing.

A text's fingerprint has a bit for every bit position of the 64-bit hashes of
its word shingles, set when over half of the hashes have it.  To link all
fingerprints within ``max_bits`` differing bits, every distinct fingerprint
emits all its variants within half that radius; two linked fingerprints always
share a variant.  The variants are shuffled, each variant's members (at most
one ball of them, whatever the data) are chained in order instead of paired, and every
link is checked by its bit count.  Links join into components by repeated
exchange of the smallest label with pointer jumping, each round a table in the
shared folder.  Everything works on distinct fingerprints; copies only
join at the end through their fingerprint.

With an even ``max_bits`` all members of a variant are within ``max_bits`` of each
other, so the chain of a variant loses no link.  With an odd one the members at the full
half radius (rounded down) are chained and each of them is also met with the
members one bit further out.

Defined cases: null, empty and blank texts have fingerprint 0 and are linked
like any other; a text of fewer words than the shingle length is one shingle;
repeated rows share a component; a null doc_id is carried and never chosen as component_id unless
its component holds no other; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.batches import small, text_hashes
from quantloom.session import cut_lineage

SHINGLE = 3
MAX_BITS = 2
SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of UTF-8 text (A-Z lower-cased, words between ASCII white space)."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))
    n, ones = len(parts), np.zeros(64, np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), "<u8", n)
    for k in range(0, n, 65536):
        bits = np.unpackbits(hashes[k:k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in small(batches):
            *keys, texts = batch.columns
            found = [fingerprint(t.as_buffer().to_pybytes(), shingle) if t.is_valid else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())],
                [*batch.schema.names[:-1], "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"),
                       docs[text_col].cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _ball(radius: int) -> list[int]:
    """All 64-bit masks (signed) with at most ``radius`` bits."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _variants(fps: DataFrame, radius: int) -> DataFrame:
    masks = _ball(radius)
    return fps.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("_mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("_mask")).alias("variant"))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) with a < b: links between distinct fingerprints that keep every component together."""
    inner = _variants(fps, max_bits // 2)
    order = Window.partitionBy("variant").orderBy("fp")
    pairs = inner.select(F.lag("fp").over(order).alias("a"), F.col("fp").alias("b")).where("a IS NOT NULL")
    if max_bits % 2:
        outer = _variants(fps, max_bits // 2 + 1)
        met = inner.select(F.col("fp").alias("a"), "variant").join(outer.select(F.col("fp").alias("b"), "variant"),
                                                                   "variant").where("a <> b")
        pairs = pairs.unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return pairs.where(near).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges``, for every node that has one.

    Each round lets a node take the smallest root among its neighbours' roots
    and jumps to that root's root; the number of rounds follows the logarithm of the
    longest chain.
    """
    edges = cut_lineage(edges, "cc_edges")
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    both = cut_lineage(both, "cc_both")
    roots = cut_lineage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root"))
                        .withColumnRenamed("u", "node"), "cc_roots")
    while True:
        offered = (both.join(roots, both.v == roots.node).groupBy("u").agg(F.min("root").alias("offer")))
        # a node's old root learns the offer too: whole trees hook onto the smaller one
        met = roots.join(offered, roots.node == offered.u).select(
            "node", "root", F.least("root", "offer").alias("new"))
        hooks = (met.where("new < root").groupBy(F.col("root").alias("h")).agg(F.min("new").alias("hook")))
        pulled = met.join(hooks, met.node == hooks.h, "left").select(
            "node", "root", F.least("new", F.coalesce("hook", "new")).alias("new"))
        parent = pulled.select(F.col("node").alias("p"), F.col("new").alias("grand"))
        jumped = pulled.join(parent, pulled.new == parent.p, "left").select(
            "node", "root", F.least("new", F.coalesce("grand", "new")).alias("new"))
        after = cut_lineage(jumped, "cc_roots")
        if after.where("new <> root").isEmpty():
            return after.select("node", F.col("new").alias("root"))
        roots = after.select("node", F.col("new").alias("root"))


def _with_least(docs_fp: DataFrame, what: str, name: str, max_bits: int) -> DataFrame:
    """``docs_fp`` with ``name``: the least ``what`` of the component of its ``fp``."""
    least = docs_fp.groupBy("fp").agg(F.min(what).alias("least"))
    edges = links(docs_fp.select("fp").distinct(), max_bits)
    roots = components(edges)
    rooted = least.join(roots, least.fp == roots.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = rooted.groupBy("root").agg(F.min("least").alias(name))
    by_fp = rooted.join(ids, "root").select(F.col("fp").alias("_fp"), name)
    return docs_fp.join(by_fp, docs_fp.fp == by_fp._fp)


def near_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    named = _with_least(cut_lineage(fingerprints(docs, shingle, id_col, text_col), "simhash_fp"), "doc_id",
                        "component_id", max_bits)
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, one row of every component.

    A document is a doc_id with a text.  The smallest id of the component stays (a null id only
    where the component holds no other); of several texts under that id, the one of the smallest
    hashes; of rows that repeat both, any one.
    """
    h1, h2 = text_hashes(docs[text_col])
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), h1.alias("_h1"), h2.alias("_h2"),
                      docs[text_col].cast("string").cast("binary").alias("text"))
    docs_fp = cut_lineage(own.mapInArrow(_fingerprints(shingle), "doc_id long, _h1 long, _h2 long, fp long"),
                          "simhash_fp").withColumn("own", F.expr("struct(doc_id IS NULL AS none, doc_id, _h1, _h2)"))
    groups = cut_lineage(_with_least(docs_fp, "own", "winner", max_bits).select("own", "winner"), "simhash_groups")
    gone = cut_lineage(groups.where("NOT own <=> winner").select(
        F.col("own.doc_id").alias("_gone"), F.col("own._h1").alias("_g1"), F.col("own._h2").alias("_g2")).distinct(),
        "simhash_gone")
    kept = docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["_gone"]) & (h1 == gone["_g1"])
                     & (h2 == gone["_g2"]), "left_anti")
    if groups.where("own <=> winner").groupBy("own").count().where("count > 1").isEmpty():
        return kept
    # the documents' own columns may have any name
    g1, g2 = text_hashes(F.col(f"`{text_col}`"))
    return kept.withColumns({"_text_h1": g1, "_text_h2": g2}).dropDuplicates([id_col, "_text_h1", "_text_h2"]).select(
        *[F.col(f"`{c}`") for c in docs.columns])
