"""Main-text extraction by a maximum-scoring subsequence.

A page is read once as a line of tokens: words and tags.  A word scores by the
log odds, learned from labelled pages, that a word of its element (tag and
class names, inside a link or not) belongs to the article; a tag
scores a negative weight, larger for tags that mostly stand outside articles.
One linear scan finds the contiguous token range of the highest total: the
content region.  Its blocks are returned in page order, without the elements
that are no article text wherever they stand (menus, adverts, forms, scripts,
reader comments; ``SKIP_TAGS``, ``SKIP_NAMES``); these score nothing, so an article
goes on behind them however long they are.

Labelled pages are those that mark their article (``article``, ``main``,
``role=main``, ``itemprop=articleBody``): words inside are content, words outside are not, skipped elements count as neither.
``fit`` reads at most about ``sample_pages`` of all pages, taken by a hash of the id (the
documented bound of the model), and keeps the ``MAX_KEYS`` most frequent element kinds.
Kinds that the sample does not hold fall back to the tag's kind, then to a prior.

Text rules: character references are decoded, white space inside a block
becomes one space, blocks are trimmed and joined by one newline; ``br`` counts as white space.

Class and id words never skip ``html``, ``body``, ``main``, ``article``, nor an element that holds a marked
article without such words of its own (an ``article class=comment`` among reader comments stays skipped); inside a
marked article they count as whole names or as first or last part (``_names_skip``).

Defined cases: null or empty html gives an empty text; a page without words
gives an empty text; of equal totals the first range wins; unclosed tags,
comments and raw text elements end with the page; repeated rows give equal rows.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.batches import small

SAMPLE_PAGES = 2000
MAX_KEYS = 2000
LEAST = 20            # words of a kind before its own weight is used
CLIP = 4.0

# fixed values: element names of HTML
RAW = frozenset("script style title textarea noscript template iframe object svg math select xmp noframes".split())
SKIP_TAGS = frozenset("nav footer aside form button head menu dialog fieldset label audio video canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody "
    "td tfoot th thead tr ul".split())
CLOSED_BY_OPEN = {"p": BLOCKS, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th", "tr"},
                  "th": {"td", "th", "tr"}, "tr": {"tr"}}
SKIP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar aside footer masthead comment comments disqus respond reply replies discussion share sharing social "
    "related recommended newsletter subscribe subscription signup login search pagination pager widget toolbar "
    "copyright skip".split())
# names that also title the parts of an article: a ``section`` with such an id stays in it, and as the first part
# of a longer name they say nothing
COMMON_NAMES = frozenset("discussion search notice notices alert menu social reply respond skip".split())
# class names that mark even a paragraph or heading as no article text
STRICT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo cookie cookies newsletter".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
PRIOR = {"p": 2.0, "blockquote": 1.5, "pre": 1.5, "article": 2.0, "main": 1.5, "h1": 1.5, "h2": 1.0, "h3": 1.0,
         "td": 0.5, "li": 0.3, "section": 0.7, "div": 0.5, "body": 0.3}
LINK_WORD, PLAIN_WORD, TAG_COST = -1.0, 0.3, 0.2

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")      # name=value pairs in order
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PLACES = frozenset({"article", "main"})
NEVER_BY_NAME = _PLACES | {"html", "body"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _parts(name: str) -> list[str]:
    return [x.lower() for x in _NAME.findall(name)]


def _names_skip(tag: str, classes: list[str], ids: list[str], within: bool) -> bool:
    """Whether class and id names say that an element is no article text.

    Outside a marked article any part of a name counts.  In an article a whole name counts, or its first or last
    part (``share-buttons``, ``cookie-notice``), but not common words there (``social-science``, ``search-results-table``)
    nor ids that title a section; paragraphs and headings go by whole strict class names only.
    """
    if tag in HEADINGS:
        return any(c.lower() in STRICT_NAMES for c in classes)
    if not within:
        return any(x in SKIP_NAMES for name in (*classes, *ids) for x in _parts(name))
    for name, is_id in (*((c, False) for c in classes), *((i, True) for i in ids)):
        parts = _parts(name)
        if not parts:
            continue
        whole = len(parts) == 1 and parts[0] in SKIP_NAMES
        if whole and not (is_id and tag == "section" and parts[0] in COMMON_NAMES):
            return True
        if len(parts) > 1 and not (is_id and tag == "section"):
            if parts[0] in SKIP_NAMES - COMMON_NAMES or parts[-1] in SKIP_NAMES:
                return True
    return False


def _attributes(text: str) -> tuple[list[str], list[str], bool, bool]:
    """(class names, id names, is no article text, marks the article)."""
    if not text or text.isspace():
        return [], [], False, False
    classes, ids, skip, marks = [], [], False, False
    for key, value in _ATTR.findall(text):
        key, value = key.lower(), value.strip("\"'")
        if key == "class":
            classes += value.split()
        elif key == "id":
            ids.append(value)
        elif key == "role":
            skip = skip or value.lower() in SKIP_ROLES
            marks = marks or value.lower() == "main"
        elif key == "itemprop":
            marks = marks or value.lower() == "articlebody"
        elif key == "style":
            skip = skip or re.search(r"display\s*:\s*none", value, re.I) is not None
        elif key in ("hidden", "aria-hidden"):
            skip = skip or key == "hidden" or value.lower() == "true"
    return classes, ids, skip, marks


class Token:
    """A run of words of one block, or a tag (``words`` 0)."""
    __slots__ = ("kind", "text", "words", "block", "skip", "inside")

    def __init__(self, kind, text, words, block, skip, inside):
        self.kind, self.text, self.words, self.block, self.skip, self.inside = kind, text, words, block, skip, inside


def tokens(page: str, holders: frozenset = frozenset()) -> list[Token]:
    """The page as runs of words and tags, in order; ``holders``: places of elements whose names do not skip them."""
    out: list[Token] = []
    stack: list[tuple] = []      # (tag, kind, skip, inside an article)
    pos, block, link = 0, 0, False
    found = set()                # places of elements that their names skip although they hold a marked article
    open_names: Counter = Counter()      # of the stack, so that no end tag searches it
    blocks_at: list[int] = []            # stack positions of blocks
    by_names: list[tuple] = []           # (stack position, place) of elements that only their names skip

    def top():
        return stack[-1] if stack else ("", "body", False, False)

    def cut(size):
        """Close everything from a stack position on."""
        while len(stack) > size:
            open_names[stack.pop()[0]] -= 1
        while blocks_at and blocks_at[-1] >= size:
            blocks_at.pop()
        while by_names and by_names[-1][0] >= size:
            by_names.pop()

    def opened(name, attrs, at):
        classes, ids, drop, marks = _attributes(attrs)
        _, _, skip, within = top()
        drop = drop or name in SKIP_TAGS or (name == "header" and not within)
        by_name = not drop and (classes or ids) and _names_skip(name, classes, ids, within)
        if (marks or name in _PLACES) and not by_name and not drop and by_names:
            found.update(place for _, place in by_names)
            by_names.clear()
        by_name = by_name and name not in NEVER_BY_NAME and at not in holders
        skip = skip or drop or by_name
        # inline elements matter only where they skip or mark, and to find the ends of those
        if name in BLOCKS or drop or by_name or marks or open_names[name]:
            names = {x for c in (*classes, *ids) for x in _parts(c)}
            kind = name + "".join("." + x for x in sorted(names)[:4]) if name in BLOCKS else top()[1]
            if name in BLOCKS:
                blocks_at.append(len(stack))
            if by_name:
                by_names.append((len(stack), at))
            open_names[name] += 1
            stack.append((name, kind, skip, (within or marks or name in _PLACES) and not skip))

    def words(raw):
        text = html_lib.unescape(raw) if "&" in raw else raw
        if text:
            _, kind, skip, inside = top()
            n = len(text.split())
            out.append(Token(kind + ">a" if link else kind, text, n, block, skip, inside))

    for m in iter(lambda: _TOKEN.search(page, pos), None):
        if m.start() > pos:
            words(page[pos:m.start()])
        pos = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            continue
        closing, attrs = (m.group(1) or m.group(4)) == "/", m.group(3) or m.group(6) or ""
        if not closing and name in RAW and not attrs.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>|\Z", re.I).search(page, pos)
            pos = end.end()
            out.append(Token(name, None, 0, block, True, top()[3]))
            if pos >= len(page):
                break
            continue
        inside = top()[3]
        if name == "a":
            link = not closing
        elif name == "br":
            out.append(Token("br", "\n", 0, block, top()[2], inside))
        if name in BLOCKS:
            block, link = block + 1, False
        if closing:
            if open_names[name]:
                size = len(stack) - 1
                while stack[size][0] != name:
                    size -= 1
                cut(size)
        else:
            if name in BLOCKS:
                while blocks_at and name in CLOSED_BY_OPEN.get(stack[blocks_at[-1]][0], ()):
                    cut(blocks_at[-1])
            if name not in VOID:
                opened(name, attrs, m.start())
        if pos >= len(page) and m.group(0)[-1] != ">":
            break
        out.append(Token(name, None, 0, block, top()[2], inside))
    if pos < len(page):
        words(page[pos:])
    return tokens(page, holders | found) if found - holders else out


def is_labelled(toks: list[Token]) -> bool:
    return any(t.inside and t.words for t in toks)


class Weights:
    """Learned counts (kind -> words inside, words outside; tag -> the same) as scores."""

    def __init__(self, words: dict, tags: dict):
        self.words, self.tags, self._known = words, tags, {}

    def word(self, kind: str) -> float:
        if kind not in self._known:
            self._known[kind] = self._word(kind)
        return self._known[kind]

    def _word(self, kind: str) -> float:
        bare, _, link = kind.partition(">")
        for k in (kind, bare.split(".")[0] + (">" + link if link else "")):
            n_in, n_out = self.words.get(k, (0, 0))
            if n_in + n_out >= LEAST and (k == kind or "." not in bare):
                return max(-CLIP, min(CLIP, math.log((n_in + 1) / (n_out + 1))))
        return LINK_WORD if link else PRIOR.get(bare.split(".")[0], PLAIN_WORD)

    def tag(self, name: str) -> float:
        n_in, n_out = self.tags.get(name, (0, 0))
        return -max(TAG_COST, min(1.5, math.log((n_out + 1) / (n_in + 1)) / 2))


def best_range(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the highest total, the first of equals; empty when nothing is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, span = total, (start, k + 1)
    return span


def extract(page: str | None, weights: Weights) -> tuple[str, int, int]:
    """(text, first token, end token) of the content region."""
    toks = tokens(page or "")
    scores = [0.0 if t.skip else t.words * weights.word(t.kind) if t.words else weights.tag(t.kind) if t.text is None
              else 0.0 for t in toks]
    start, end = best_range(scores)
    blocks: dict[int, list] = {}
    for t in toks[start:end]:
        if t.text is not None and not t.skip:
            blocks.setdefault(t.block, []).append(t.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x), start, end


def _counts(batches):
    """Words and tags by kind, inside and outside the marked article, of the labelled pages."""
    for batch in small(batches):
        seen: dict = {}
        for page in batch.column(0).to_pylist():
            toks = tokens(page or "")
            if not is_labelled(toks):
                continue
            for t in toks:
                if not t.skip and (t.words or t.text is None):
                    c = seen.setdefault((t.kind, bool(t.words)), [0, 0])
                    c[0 if t.inside else 1] += t.words or 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.bool_()),
             pa.array([c[0] for c in seen.values()], pa.int64()), pa.array([c[1] for c in seen.values()], pa.int64())],
            ["kind", "is_word", "n_in", "n_out"])


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
        sample_pages: int = SAMPLE_PAGES) -> Weights:
    """Weights from about ``sample_pages`` pages; a bounded table of counts reaches the driver."""
    total = pages.count()
    share = min(1.0, sample_pages / max(1, total))
    draw = F.pmod(F.xxhash64(pages[id_col].cast("string")), F.lit(1_000_000))
    rows = pages.where(draw < int(share * 1_000_000)).select(pages[html_col].cast("string").alias("html"))
    counts = (rows.mapInArrow(_counts, "kind string, is_word boolean, n_in long, n_out long")
              .groupBy("kind", "is_word").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out")))
    top = counts.orderBy(F.desc(F.col("n_in") + F.col("n_out")), "kind", "is_word").limit(MAX_KEYS).collect()
    return Weights({r["kind"]: (r["n_in"], r["n_out"]) for r in top if r["is_word"]},
                   {r["kind"]: (r["n_in"], r["n_out"]) for r in top if not r["is_word"]})


def _extract(words: dict, tags: dict):
    def run(batches):
        weights = Weights(words, tags)
        for batch in small(batches):
            found = [extract(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())],
                ["page_id", "url", "text", "first_token", "end_token"])
    return run


def extract_pages(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """page_id, url, text, first_token, end_token of every page."""
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"),
                        pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(_extract(weights.words, weights.tags),
                           "page_id long, url string, text string, first_token long, end_token long")
