"""Filing tables (P3: A9, D5, C12, C2, B8, G1, B14, B15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Extractor section codes requested per form (10-K item 7, 10-Q part 1 item 2).
SECTIONS = {"10-K": ("7",), "10-Q": ("part1item2",)}
# The content field used per form in the free variant.
CONTENT_FIELD = {"10-K": "management_discussion", "10-Q": "mda", "20-F": "item_5"}


def with_sections(filings: DataFrame, form_col: str = "form") -> DataFrame:
    """Each filing times the sections of its form, as an explode of a fixed per-form list."""
    secs = None
    for form, codes in SECTIONS.items():
        arr = F.array(*[F.lit(c) for c in codes])
        secs = F.when(F.col(form_col) == form, arr) if secs is None else secs.when(F.col(form_col) == form, arr)
    return filings.select("*", F.explode(secs).alias("section"))


def unique_documents(index: DataFrame, key: str = "document_url", order_col: str | None = None) -> DataFrame:
    """One row per document url (deterministic: the first by ``order_col`` when given)."""
    if order_col is None:
        return index.dropDuplicates([key])
    from quantloom.operators.ordered import keep_first
    return keep_first(index, [key], [F.col(order_col).asc()])


def filing_table(index: DataFrame, contents: DataFrame, key: str = "document_url") -> DataFrame:
    """C2 + B8: index joined to fetched contents on the url; rows with any NULL dropped."""
    return index.join(contents, key).na.drop("any")


def union_forms(*frames: DataFrame) -> DataFrame:
    """G1: concatenate per-form frames, skipping empty ones (by schema, not by a count)."""
    frames = [f for f in frames if f is not None]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def content_by_form(wide: DataFrame, form_col: str = "form", max_chars: int | None = None) -> DataFrame:
    """B14 (+B15): the content field of the form; empty contents skipped.

    ``max_chars`` reproduces the reference's stored cut (10,000 characters);
    by default contents are kept whole.
    """
    c = None
    for form, field in CONTENT_FIELD.items():
        c = F.when(F.col(form_col) == form, F.col(field)) if c is None else c.when(F.col(form_col) == form, F.col(field))
    if max_chars is not None:
        c = F.substring(c, 1, max_chars)
    out = wide.withColumn("content", c)
    return out.where(F.col("content").isNotNull() & (F.col("content") != ""))
