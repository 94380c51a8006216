"""Line dedup by an exact set-similarity join (DataFrame and SQL functions only).

A line is the set of its words (lower-cased, between ASCII white space).  Two
lines match when the Jaccard similarity of their sets is at least ``similarity``; a
line is removed when a line before it, in the order of (doc_id, text hash, line number), matches it.

1. *Rarity order.*  Words are counted in ``2^16`` hash buckets over all texts (a
   table of fixed size).  A word's id is its 64-bit hash with the bucket
   replaced by the bucket's place in the order of rising counts, so sorting ids sorts
   words from rare to frequent and ids stay as distinct as the hashes.
2. *Equal sets* (equal 128-bit hash of their ids) fold into their first line, with
   partial aggregation; the sets are numbered in the order of their lines.
3. *Prefix filter.*  Sets that match share a word among their ``n - ceil(t n) + 1``
   rarest ones.  One row per set and prefix word is dealt and sorted by that word, once for both sides of the join.
4. *Length, positional and parity filters* (the last compares 128-bit parities
   of the sets: they differ in no more bits than the sets differ in words)
   leave few pairs.  Words that more than ``HOT`` sets share (and those with their bit in a filter of fixed size)
   are kept apart: there a set first meets the group's earliest set only, so a group of near copies is compared in a
   star and not pair by pair.
5. *Verification* reads the remaining lines again and computes the Jaccard
   similarity of their words.  Sets that are still without a match then meet all sets before them in the
   groups of the words kept apart, so no match is lost.

Defined cases: null and empty texts have no lines to remove; lines without
words are never matched nor removed; a document is a doc_id with a text (two hashes, 126 bits), so rows of one
doc_id or of null ids with different texts are decided apart, in the order of the hashes, and only rows that
repeat both share their decisions; a null doc_id counts as the
smallest; removed lines leave no blank line behind; a document stays, with an empty text, when all its
lines go; extra columns are carried through.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.batches import text_hashes
from quantloom.session import cut_lineage

SIMILARITY = 0.8
BUCKETS = 1 << 16
FILTER_BITS = 1 << 22     # bits of the filters in front of the second reads, 512 KB
HOT = 128                 # a prefix word that more sets share has a leader, the earliest of them
_LOWEST = -(1 << 63)
_SPACES = r"'[ \\t\\x0B\\f\\r]+'"
DOC = ["doc", "h1", "h2"]       # a document: its id and the hashes of its text
LINE = [*DOC, "pos"]


def _doc_key(docs: DataFrame, id_col: str, text_col: str) -> list:
    key = [F.coalesce(docs[id_col].cast("long"), F.lit(_LOWEST)), *text_hashes(docs[text_col])]
    return [c.alias(name) for c, name in zip(key, DOC)]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*_doc_key(docs, id_col, text_col), F.lower(docs[text_col].cast("string")).alias("text"))


def _once(rows: DataFrame, name: str, expr: str) -> DataFrame:
    """``rows`` with a computed column; a generator in between keeps the optimizer from copying the expression."""
    return rows.select("*", F.explode(F.expr(f"array({expr})")).alias(name))


def rarity_order(texts: DataFrame) -> list[int]:
    """Place of every bucket in the order of rising word counts."""
    words = texts.select(F.explode(F.split("text", r"[ \n\t\x0B\f\r]+")).alias("w")).where("w <> ''")
    counts = (words.select(F.expr(f"cast(xxhash64(w) & {BUCKETS - 1} as int)").alias("b"))
              .groupBy("b").count().collect())          # at most BUCKETS rows
    n = dict(map(tuple, counts))
    place = [0] * BUCKETS
    for k, b in enumerate(sorted(range(BUCKETS), key=lambda b: (n.get(b, 0), b))):
        place[b] = k
    return place


def _words(line: str) -> str:
    """SQL: the words of a line, repeats included."""
    return f"array_remove(split({line}, {_SPACES}), '')"


def _word_ids(place: list[int]) -> str:
    """SQL: the ids of the words of ``words``."""
    # folds to one literal of fixed size; without nulls the ids are sorted as plain numbers
    places = f"cast(split('{','.join(str((k - BUCKETS // 2) << 48) for k in place)}', ',') as array<bigint>)"
    word_id = f"coalesce({places}[xxhash64(w) & {BUCKETS - 1}], 0L) | shiftrightunsigned(xxhash64(w), 16)"
    return f"transform(words, w -> {word_id})"


# the parity of 128 word classes: classes 0-63 in p1, the others in p2
_PARITY = "aggregate(ids, 0L, (a, x) -> a ^ if(x & 64 = {}, shiftleft(1L, cast(x & 63 as int)), 0L))"
# the low 32 bits of an id as a signed number
_SHORT = "cast(((x & 4294967295) ^ 2147483648) - 2147483648 as int)"


def _marks(keys: DataFrame, key: str) -> DataFrame:
    """A bit per hash of a key, FILTER_BITS bits in all, 64 a row: ``_slot``, ``_bits``."""
    return (keys.select(F.expr(f"pmod(xxhash64({key}), {FILTER_BITS})").alias("_h"))
            .groupBy(F.expr("shiftright(_h, 6)").alias("_slot"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(_h & 63 as int)))").alias("_bits")))


def _only(rows: DataFrame, key: str, marks: DataFrame, among: bool = True) -> DataFrame:
    """Rows whose ``key`` is (or, without ``among``, is not) marked: marked ones are probably among the keys of ``marks``."""
    rows = rows.withColumn("_h", F.expr(f"pmod(xxhash64({key}), {FILTER_BITS})"))
    rows = rows.join(F.broadcast(marks), F.expr("shiftright(_h, 6) = _slot"), "inner" if among else "left")
    hit = "shiftrightunsigned(coalesce(_bits, 0L), cast(_h & 63 as int)) & 1"
    return rows.where(f"{hit} = {int(among)}").drop("_h", "_slot", "_bits")


class _Join:
    """The steps of one join over ``texts`` (doc, h1, h2, text in lower case)."""

    def __init__(self, texts: DataFrame, similarity: float):
        t = Fraction(similarity).limit_denominator(1000)
        self.num, self.den, self.texts = t.numerator, t.denominator, texts
        first = self._sets()
        # numbered in the order of their lines: range partitions, sorted, count up
        ordered = first.repartitionByRange(*LINE).sortWithinPartitions(*LINE)
        self.sets = cut_lineage(ordered.withColumn("sid", F.monotonically_increasing_id()), "line_sets", drop_shuffles=True)

    def _sets(self) -> DataFrame:
        """One row per distinct word set: its first line, size, prefix and parities."""
        lines = self.texts.select(*DOC, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        rows = _once(lines, "words", _words("line")).where("size(words) > 0").select(*LINE, "words")
        rows = _once(rows, "all", _word_ids(rarity_order(self.texts))).select(*LINE, "all")
        # apart from the lambda function, so that Spark compiles it
        rows = _once(rows, "ids", "sort_array(array_distinct(`all`))").select(*LINE, "ids")
        n = "size(ids)"
        # sets too small to match any other set need no prefix
        length = (f"if({n} * ({self.den} - {self.num}) < {self.num}, 0, "
                  f"cast({n} - ({self.num} * {n} + {self.den - 1}) div {self.den} + 1 as int))")
        rows = rows.selectExpr(*LINE, f"{n} AS n", "xxhash64(ids) AS k1", "xxhash64(1, ids) AS k2",
                               f"transform(slice(ids, 1, {length}), x -> {_SHORT}) AS prefix",
                               f"{_PARITY.format(0)} AS p1", f"{_PARITY.format(64)} AS p2")
        # the order of (doc, upper half of h1, pos) in one value of fixed width (h1 has 62 bits): hash aggregate
        at = F.expr(f"cast(cast(doc as decimal(38,0)) * {1 << 62} + shiftleft(shiftright(h1, 31), 31) + pos "
                    "as decimal(38,0))")
        return rows.withColumn("at", at).groupBy("k1", "k2", "n", "prefix", "p1", "p2").agg(
            *[F.min_by(c, "at").alias(c) for c in LINE]).select(*LINE, "n", "prefix", "p1", "p2")

    def _prefixes(self, sets: DataFrame) -> DataFrame:
        """One row per prefix word; size and place share one number, so that fewer bytes are dealt."""
        rows = sets.select("sid", "n", "p1", "p2", F.posexplode("prefix").alias("i", "word"))
        return rows.selectExpr("word", "sid", "shiftleft(cast(n as bigint), 32) | i AS at", "p1", "p2")

    def _may_match(self):
        """SQL: the length, positional and parity filters of a prefix row (s) and one before it (t)."""
        n, i = (tuple(e.format(p) for p in "st") for e in ("shiftright({}_at, 32)", "({}_at & 4294967295)"))
        both, total = f"({n[0]} + {n[1]})", self.num + self.den
        return F.expr(
            f"t_sid < s_sid AND {n[0]} * {self.den} >= {self.num} * {n[1]} AND {n[1]} * {self.den} >= {self.num} * {n[0]}"
            f" AND (bit_count(s_p1 ^ t_p1) + bit_count(s_p2 ^ t_p2)) * {total} <= {both} * {self.den - self.num}"
            f" AND (least({i[0]}, {i[1]}) + least({n[0]} - {i[0]}, {n[1]} - {i[1]})) * {total} >= {both} * {self.num}")

    def _meet(self, asking: DataFrame, rows: DataFrame) -> DataFrame:
        """Pairs of asking prefix rows with the rows before them in their word's group, some of them repeated."""
        s, t = (d.select(*[F.col(c).alias(f"{p}_{c}") for c in d.columns]) for d, p in ((asking, "s"), (rows, "t")))
        return s.join(t, (F.col("s_word") == F.col("t_word")) & self._may_match()).select("s_sid", "t_sid")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose word sets reach the similarity."""
        sids = pairs.select(F.col("s_sid").alias("sid")).union(pairs.select("t_sid")).distinct()
        wanted = self.sets.select("sid", *LINE).join(sids, "sid", "left_semi").groupBy(*DOC).agg(
            F.collect_list(F.struct("pos", "sid")).alias("asked"))              # lines of one document
        wanted = cut_lineage(wanted, "line_wanted", drop_shuffles=True)
        texts = _only(self.texts, "doc, h1", _marks(wanted, "doc, h1")).join(wanted, DOC)
        found = texts.select(F.split("text", "\n").alias("lines"), "asked").select(
            "lines", F.explode("asked").alias("a")).select("a.sid", F.expr("lines[a.pos]").alias("line"))
        # rows that repeat a text bring the same line again
        lines = cut_lineage(found.dropDuplicates(["sid"]), "line_words", drop_shuffles=True)
        one, two = (lines.select(*[F.col(c).alias(f"{p}_{c}") for c in ("sid", "line")]) for p in "st")
        both = pairs.join(one, "s_sid").join(two, "t_sid").select("s_sid", "t_sid", "s_line", "t_line")
        for p in "st":
            both = _once(both, f"{p}_words", f"array_distinct({_words(f'{p}_line')})").drop(f"{p}_line")
        both = _once(both, "same", "size(array_intersect(s_words, t_words))")
        return both.where(f"same * {self.den} >= {self.num} * (size(s_words) + size(t_words) - same)").select(
            "s_sid", "t_sid")

    def _led(self, hot: DataFrame, marks: DataFrame) -> DataFrame:
        """Pairs of a set and the earliest set of a hot word's group."""
        leads = self._prefixes(_only(self.sets, "sid", _marks(hot, "lead")))
        leads = leads.join(hot.select("word", F.col("lead").alias("sid")), ["word", "sid"], "left_semi")
        return self._meet(_only(self._prefixes(self.sets), "word", marks), leads)

    def matched(self) -> DataFrame:
        """``sid``: sets that a set before them matches."""
        rows = self._prefixes(self.sets)
        hot = rows.groupBy("word").agg(F.count(F.lit(1)).alias("c"), F.min("sid").alias("lead"))
        hot = cut_lineage(hot.where(F.col("c") > HOT).select("word", "lead"), "line_hot", drop_shuffles=True)
        if hot.isEmpty():
            pairs = cut_lineage(self._meet(rows, rows).distinct(), "line_pairs", drop_shuffles=True)
            return self._verified(pairs).select(F.col("s_sid").alias("sid")).distinct()
        # a word is marked or not, so its whole group is on one side; marked are all hot words and perhaps some others
        marks = cut_lineage(_marks(hot, "word"), "line_marks", drop_shuffles=True)
        rest = _only(rows, "word", marks, among=False)
        few = cut_lineage(self._meet(rest, rest), "line_few", drop_shuffles=True)
        first = cut_lineage(few.unionByName(self._led(hot, marks)).distinct(), "line_pairs", drop_shuffles=True)
        good = cut_lineage(self._verified(first).select(F.col("s_sid").alias("sid")).distinct(), "line_matches",
                           drop_shuffles=True)
        # only sets that are still without a match meet all the others of their hot words' groups
        asking = _only(self._prefixes(self.sets.join(good, "sid", "left_anti")), "word", marks)
        more = self._meet(asking, _only(rows, "word", marks)).distinct()
        more = cut_lineage(more.join(first, ["s_sid", "t_sid"], "left_anti"), "line_pairs", drop_shuffles=True)
        return good.unionByName(self._verified(more).select(F.col("s_sid").alias("sid"))).distinct()


def kept_lines(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """doc (null ids as the smallest long), h1, h2, kept: the line numbers, from 0, of the lines with words that stay."""
    join = _Join(_texts(docs, id_col, text_col), similarity)
    stay = join.sets.join(join.matched(), "sid", "left_anti")
    return stay.groupBy(*DOC).agg(F.collect_list("pos").alias("kept"))


# SQL over ``lines`` (array of lines) and ``kept``: numbers of the lines without words
_BLANK = "filter(sequence(0, size(lines) - 1), k -> trim(LEADING ' \\t\\u000b\\u000c\\r' FROM lines[k]) = '')"


def line_decisions(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (line numbers from 0, ascending)."""
    kept = kept_lines(docs, similarity, id_col, text_col)
    # only line numbers leave the scan: those with words, as an array per document
    rows = docs.select(docs[id_col].alias("doc_id"), *_doc_key(docs, id_col, text_col),
                       F.split(F.coalesce(docs[text_col].cast("string"), F.lit("")), "\n").alias("lines"))
    rows = rows.select("doc_id", *DOC, F.size("lines").cast("long").alias("n_lines"),
                       F.expr(f"array_except(sequence(0, size(lines) - 1), {_BLANK})").alias("worded"))
    out = rows.join(kept, DOC, "left")
    removed = F.expr("array_sort(array_except(worded, coalesce(kept, cast(array() as array<int>))))")
    return out.select("doc_id", "n_lines", removed.alias("removed")).select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, without the removed lines; null texts stay null."""
    names = [f"_{c}" for c in DOC]
    kept = kept_lines(docs, similarity, id_col, text_col).toDF(*names, "_kept")
    own = dict(zip(names, _doc_key(docs, id_col, text_col)))
    rows = docs.withColumns(own).join(kept, names, "left")
    # columns of their own: inside a lambda the split would run again for every line
    rows = rows.withColumn("_lines", F.split(F.col(f"`{text_col}`"), "\n"))
    blank = _BLANK.replace("lines", "_lines")
    rows = rows.withColumn("_stay", F.expr(
        f"array_sort(array_union({blank}, coalesce(_kept, cast(array() as array<int>))))"))
    text = F.expr("array_join(transform(filter(_stay, k -> k < size(_lines)), k -> _lines[k]), '\n')")
    new = F.when(F.col(f"`{text_col}`").isNotNull(), text)
    return rows.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
