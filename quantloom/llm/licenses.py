"""License scan: Aho-Corasick over words, shunting-yard over licence expressions.

The text is lower-cased (A-Z), cut into words of ASCII letters, digits and
non-ASCII characters, and put together again with single spaces.  One
Aho-Corasick pass finds every place of the notice phrases and of the
identifier tag ``spdx license identifier``.  A place of a phrase is a run of
consecutive words.  For texts that hold the tag, the expression behind each
tag is read from the original text and evaluated by a shunting-yard parser
(``with`` binds tighter than ``and``, ``and`` tighter than ``or``).

Result: ``base`` labels come from ``BASE`` alone, ``labels`` add those of
``NOTICES`` and of the identifiers in expressions.  ``score`` is the strength
of the evidence, 1 - product(1 - w) over the labels, w being 0.7 for a phrase
and 1.0 for an identifier in a tag.  ``reuse`` is the value of the
evaluated expressions: permissive 1, weak copyleft 0.6, strong copyleft 0.3,
unknown 0; ``or`` takes the larger, ``and`` the smaller, an exception behind
``with`` lifts a copyleft licence halfway to 1; several tags are joined by
``and``.  A malformed expression counts as 0 and its identifiers still give labels.

Defined cases: null and empty texts have no words, no labels and score 0;
repeated rows and ties each get their own equal row; extra columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from quantloom.llm.batches import small

# fixed values: the phrases and labels that every scan reports
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# fixed values: further notice phrases
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
    "mozilla public license": "mpl", "eclipse public license": "epl", "bsd license": "bsd",
    "isc license": "isc", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc0": "cc0", "unlicense": "unlicense",
    "creative commons attribution": "cc-by", "public domain": "public-domain",
    "all rights reserved": "proprietary"}
TAG = "spdx license identifier"
# fixed values: licence families by the start of an identifier, and how freely each may be reused
FAMILIES = ("agpl", "apache", "bsd", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by",
            "cc0", "epl", "gpl", "isc", "lgpl", "mit", "mpl", "unlicense")
REUSE = {"apache": 1.0, "bsd": 1.0, "cc-by": 1.0, "cc0": 1.0, "isc": 1.0, "mit": 1.0, "unlicense": 1.0,
         "epl": 0.6, "lgpl": 0.6, "mpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.3, "agpl": 0.3}
PHRASE_WEIGHT, TAG_WEIGHT = 0.7, 1.0

# A-Z lower-cased, other ASCII that is no letter or digit becomes a space, bytes of non-ASCII characters stay
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32)
              for b in range(256))
_EXPRESSION = re.compile(r"(?i)spdx[-_ ]license[-_ ]identifier\s*:\s*([^\n\r]*)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:_-]*|\S")
_BINDS = {"or": 1, "and": 2, "with": 3}
_AUTOMATON = None


def family(identifier: str) -> str:
    """'GPL-2.0-only' -> 'gpl'; an identifier of no known family is its own label."""
    low = identifier.lower()
    return next((f for f in FAMILIES if low == f or low.startswith(f + "-")), low)


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: infix tokens to postfix, or None when they form no expression."""
    out, ops, want = [], [], True
    for t in tokens:
        low = t.lower()
        if low in _BINDS:
            if want:
                return None
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[low]:
                out.append(ops.pop())
            ops.append(low)
            want = True
        elif t == "(":
            if not want:
                return None
            ops.append(t)
        elif t == ")":
            if want:
                return None
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return None
            ops.pop()
        else:
            if not want or not t[0].isalnum():
                return None
            out.append(t)
            want = False
    while ops:
        if ops[-1] == "(":
            return None
        out.append(ops.pop())
    return out if not want else None


def expression_tokens(text: str) -> list[str]:
    """The longest start of ``text`` that can be an expression: operands and operators take turns."""
    out, want, depth = [], True, 0
    for t in _TOKEN.findall(text):
        word = t[0].isalnum()
        if t == "(" and want:
            depth += 1
        elif t == ")" and not want and depth:
            depth -= 1
        elif not word or (t.lower() in _BINDS) == want:
            break
        else:
            want = t.lower() in _BINDS
        out.append(t.rstrip(".:") if word else t)
    return out


def evaluate(tokens: list[str]) -> tuple[float | None, list[str]]:
    """(reuse value or None when malformed, licence identifiers)."""
    rpn = postfix(tokens)
    exception = {k + 1 for k, t in enumerate(tokens) if t.lower() == "with"}
    names = [t for k, t in enumerate(tokens) if t not in "()" and t.lower() not in _BINDS and k not in exception]
    if rpn is None:
        return None, names
    stack: list[float] = []
    for t in rpn:
        if t in _BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append(max(a, b) if t == "or" else min(a, b) if t == "and" else a + (1 - a) / 2 if a else 0.0)
        else:
            stack.append(REUSE.get(family(t), 0.0))
    return stack[0], names


def automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick
        _AUTOMATON = ahocorasick.Automaton()
        for phrase in (*BASE, *NOTICES, TAG):
            _AUTOMATON.add_word(f" {phrase} ", phrase)
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def scan(text: str) -> dict:
    """All findings of one text."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    n_base, first, last, base, labels, tagged = 0, None, None, set(), set(), False
    for end, phrase in automaton().iter(joined):
        if phrase == TAG:
            tagged = True
        elif phrase in BASE:
            n_base += 1
            start = end - len(phrase) - 1
            first = start if first is None else min(first, start)
            last = start if last is None else max(last, start)
            base.add(BASE[phrase])
        else:
            labels.add(NOTICES[phrase])
    evidence = dict.fromkeys(base | labels, PHRASE_WEIGHT)
    expressions, reuse = [], None
    for found in _EXPRESSION.findall(text) if tagged else ():
        tokens = expression_tokens(found)
        value, names = evaluate(tokens)
        expressions.append(" ".join(tokens))
        reuse = min(value or 0.0, 1.0 if reuse is None else reuse)
        evidence.update((family(n), TAG_WEIGHT) for n in names)
    miss = 1.0
    for w in evidence.values():
        miss *= 1.0 - w
    place = lambda at: None if at is None else joined.count(" ", 0, at)
    return {"n_words": len(words), "n_base": n_base, "first_word": place(first), "last_word": place(last),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(evidence)), "score": 1.0 - miss,
            "expressions": " AND ".join(f"({e})" for e in expressions), "reuse": reuse}


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, expressions string, reuse double")


def _run(batches):
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.float64()]
    for batch in small(batches):
        found = [scan(t or "") for t in batch.column(1).to_pylist()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0)] + [pa.array([f[n] for f in found], k) for n, k in zip(names[1:], kinds)], names)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word and phrase counts, places, labels, score, expressions and reuse value."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(_run, SCHEMA)
