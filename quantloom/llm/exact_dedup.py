"""Exact dedup by skew-safe combining (DataFrame operations only).

Texts are equal when identical after deleting ASCII white space.  Equal texts
are combined in three steps, each of which groups by the *content* and not
only by its digest:

1. local: the partial aggregate of every map task folds its own copies;
2. salted: ``(digest, salt, content)`` groups, so the copies of one text are
   spread over ``salts`` reducers;
3. global: the at most ``salts`` winners of a text meet under its digest.

Every row then learns its winner through a join on the digest alone, which
moves no text.  A digest shared by different contents (impossible in practice
with SHA-256, and tested with a truncated digest) goes through a join on the
content instead.

Defined cases: a null text is empty; all empty texts are equal; of equal texts
the longest original stays, then the smallest doc_id; a null doc_id ranks
after every other.  Rows that repeat a doc_id with an equal text are one
document given twice and carry the same decision (``exact_dedup`` returns it
once).  An empty table gives an empty result; other columns are carried
through by ``exact_dedup`` and never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.session import cut_lineage

WHITE = " \t\n\x0b\x0c\r"
DEFAULT_SALTS = 32
_HALF = "9223372036854775807"     # 2^63 - 1
_SPAN = "18446744073709551616"    # 2^64


def normalise(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def sha256_hex(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """One fixed-width number that orders by (most characters, smallest doc_id, null last)."""
    dec = "decimal(38,0)"
    back = F.coalesce(F.lit(_HALF).cast(dec) - doc_id.cast(dec), F.lit(-1).cast(dec))
    return (n_chars.cast(dec) * F.lit(_SPAN).cast("decimal(20,0)") + back).cast(dec)


def _winner(rank: Column) -> Column:
    dec = "decimal(38,0)"
    back = F.pmod(rank + F.lit(1).cast(dec), F.lit(_SPAN).cast("decimal(20,0)")) - F.lit(1).cast(dec)
    return F.when(back >= 0, (F.lit(_HALF).cast(dec) - back).cast("long"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 salts: int = DEFAULT_SALTS, digest=sha256_hex) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text"))
    rows = rows.select("doc_id", F.length(F.coalesce("_text", F.lit(""))).alias("_len"),
                       normalise(F.col("_text")).alias("_content"))
    rows = rows.withColumn("_digest", digest(F.col("_content")))

    salted = (rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
              .groupBy("_digest", "_salt", "_content")
              .agg(F.max(_rank(F.col("_len"), F.col("doc_id"))).alias("_rank"), F.count(F.lit(1)).alias("_n")))
    # dealt by digest alone: the count of contents per digest then needs no second shuffle
    merged = (salted.repartition("_digest").groupBy("_digest", "_content")
              .agg(F.max("_rank").alias("_rank"), F.sum("_n").alias("group_size")))
    # the content leaves the plan here unless its digest is shared by another content
    shared = F.count(F.lit(1)).over(Window.partitionBy("_digest")) > 1
    classes = cut_lineage(merged.select(
        F.col("_digest").alias("_key"), _winner(F.col("_rank")).alias("keep_id"), "group_size",
        F.when(shared, F.col("_content")).alias("_only")), "exact_classes")

    members = rows.select("doc_id", "_digest")
    found = members.join(classes.where(F.col("_only").isNull()), F.col("_digest") == F.col("_key"))
    out = found.select("doc_id", "keep_id", "group_size", "_digest")
    collided = classes.where(F.col("_only").isNotNull())
    if not collided.isEmpty():
        exact = rows.join(collided, (F.col("_digest") == F.col("_key")) & (F.col("_content") == F.col("_only")))
        out = out.unionByName(exact.select("doc_id", "keep_id", "group_size", "_digest"))
    return out.select("doc_id", "keep_id", "group_size",
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.col("_digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                salts: int = DEFAULT_SALTS) -> DataFrame:
    """The documents that stay, with all their columns; a repeated row stays once."""
    keep = (exact_groups(docs, id_col, text_col, salts).where("kept")
            .select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha")))
    keep = keep.groupBy("_keep", "_sha").agg(F.count(F.lit(1)).alias("_copies"))
    own = sha256_hex(normalise(docs[text_col]))
    kept = (docs.withColumn("_own", own)
            .join(keep, docs[id_col].eqNullSafe(F.col("_keep")) & (F.col("_own") == F.col("_sha"))))
    order = Window.partitionBy("_keep", "_sha").orderBy(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    kept = kept.withColumn("_row", F.row_number().over(order)).where("_row = 1")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
