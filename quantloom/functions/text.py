"""Scalar text functions (H1-H6, H20, H21, H29, H30) as Spark column expressions."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns of the news-cleaning rules.
UPDATE_PREFIX = r"^UPDATE (\d+)"      # H1: leading update number
UPDATE_TAG = r"UPDATE \d+-"           # H2: every update tag, not anchored
LEADING_DIGITS = r"^\d+"              # H3: digits stripped before headline dedup
WIRE_MARKER = "(Reuters)"             # H4: body starts at the wire marker

# Placeholder tokens and patterns of the text cleaner (H6).
URL_TOKEN, EMAIL_TOKEN, PHONE_TOKEN = "<url>", "<email>", "<phone>"
# they run on lower-cased text; the lookaheads and the possessive run only end hopeless attempts sooner
URL_RE = r"(?=[hfw])\b(?:https?://|ftp://|www\.)[^\s<>\"]+"
EMAIL_RE = r"\b[a-z0-9._%+-]++@[a-z0-9.-]+\.[a-z]{2,}\b"
PHONE_RE = r"(?=[+(\d])(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}\b"

NON_ASCII = r"[^\x00-\x7F]"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def update_number(headline) -> Column:
    """H1: number after a leading 'UPDATE n', else 0."""
    g = F.regexp_extract(_c(headline), UPDATE_PREFIX, 1)
    return F.coalesce(g.try_cast("int"), F.lit(0))


def strip_update_tags(headline) -> Column:
    """H2: remove every 'UPDATE n-' tag."""
    return F.regexp_replace(_c(headline), UPDATE_TAG, "")


def strip_leading_digits(headline) -> Column:
    """H3."""
    return F.regexp_replace(_c(headline), LEADING_DIGITS, "")


def from_wire_marker(body) -> Column:
    """H4: cut the body so it starts at '(Reuters)' when present; other values untouched."""
    b = _c(body)
    pos = F.instr(b, WIRE_MARKER)
    return F.when(pos > 0, b.substr(pos, F.length(b))).otherwise(b)


def without_spaces(c) -> Column:
    """H5: dedup key with every space removed."""
    return F.replace(_c(c), F.lit(" "), F.lit(""))


def clean_text_regex(text) -> Column:
    """H6, the JVM part: lower, URL / e-mail / phone to tokens, whitespace and line breaks to one space.

    NULL becomes ''.  ASCII folding of accents is ``ascii_fold`` (Arrow UDF).
    """
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    # a linear chain: every step reads the previous one once (no conditional copies)
    t = F.regexp_replace(t, URL_RE, URL_TOKEN)
    t = F.regexp_replace(t, EMAIL_RE, EMAIL_TOKEN)
    t = F.regexp_replace(t, PHONE_RE, PHONE_TOKEN)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def _fold(s: str | None) -> str | None:
    if s is None:
        return None
    if s.isascii():
        return s
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")


@F.pandas_udf(StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """H6 ASCII folding: NFKD decomposition, non-ASCII code points dropped."""
    return s.map(_fold)


@functools.lru_cache(maxsize=1)
def _fold_tables():
    """Per-character NFKD-to-ASCII table, built by rule from the Unicode database.

    NFKD decomposes each character on its own and only reorders combining marks
    (never ASCII), so folding a text equals folding each character.  Returns the
    characters that fold to one ASCII character (for ``translate``) and those that
    fold to several (for literal replacement); all others fold to nothing.
    """
    src, dst, multi = [], [], []
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        c = chr(cp)
        d = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode("ascii")
        if len(d) == 1:
            src.append(c)
            dst.append(d)
        elif d:
            multi.append((c, d))
    return "".join(src), "".join(dst), tuple(multi)


def ascii_fold_jvm(text) -> Column:
    """H6 ASCII folding as JVM expressions.

    Texts holding a character that folds to several letters (ligatures, fractions,
    ...; rare) are rewritten character by character through a literal map; then one
    ``translate`` folds the characters that map to a single letter and every remaining
    non-ASCII character is dropped.  ASCII texts pass untouched.
    """
    t = _c(text)
    src, dst, multi = _fold_tables()
    expand = F.create_map(*[F.lit(x) for pair in multi for x in pair])
    chars = F.regexp_extract_all(t, F.lit("(?s)."), 0)
    expanded = F.array_join(F.transform(chars, lambda ch: F.coalesce(F.try_element_at(expand, ch), ch)), "")
    # a text holds such a character when deleting them all changes its length (a map lookup
    # per character; a regex class of several hundred characters is far slower)
    has_multi = F.length(F.translate(t, "".join(c for c, _ in multi), "")) != F.length(t)
    folded = F.regexp_replace(F.translate(F.when(has_multi, expanded).otherwise(t), src, dst), NON_ASCII, "")
    return F.when(t.rlike(NON_ASCII), folded).otherwise(t)


# typographic quotes and the straight ones they become before folding
CURLY_QUOTES = "\u02bc\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u201f"
STRAIGHT_QUOTES = "'" * 5 + '"' * 4


def straight_quotes(text) -> Column:
    return F.translate(_c(text), CURLY_QUOTES, STRAIGHT_QUOTES)


def clean_text(text) -> Column:
    """H6 in full: straight quotes, ASCII fold, then the regex chain.

    ASCII texts pass the first two untouched; for others the straightened text is bound once (the fold reads
    it several times).
    """
    t = _c(text)
    folded = F.transform(F.array(straight_quotes(t)), ascii_fold_jvm)[0]
    return clean_text_regex(F.when(t.rlike(NON_ASCII), folded).otherwise(t))


def headline_and(headline, other, null_as: str = "") -> Column:
    """H20: 'headline other' trimmed.  NULL parts read as ``null_as``: '' for the API
    variant, 'nan' reproduces the CSV variant (it stringifies missing values)."""
    return F.trim(F.concat(F.coalesce(_c(headline), F.lit(null_as)), F.lit(" "),
                           F.coalesce(_c(other), F.lit(null_as))))


def file_safe(symbol) -> Column:
    """H21: '.' and '/' become '_'."""
    return F.translate(_c(symbol), "/.", "__")


def summary_request(text, budget: int = 200) -> Column:
    """Summary request text for a user-supplied summariser (fixed value; a NULL text reads as empty)."""
    return F.concat(F.lit(f"Summarize the following news within {budget} tokens:\n"), F.coalesce(_c(text), F.lit("")),
                    F.lit("\nSummary:"))


def truncate_summary(text, n: int) -> Column:
    """Default summariser, the first n characters."""
    return F.substring(_c(text), 1, n)
