"""Importance resampling, n-gram Jaccard join and hard-negative mining: brute force and the defined edge cases."""
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import graph, hard_negatives, ngram_join, resample
from quantloom.llm.queries import QUERIES, table

SF_SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, rank int, score long, h long, sid long"
LONG = "word " * 30000 + "end"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, 4) for i, t in rows], DOCS).repartition(3)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c d e f g h i j k l"), (5, "A b c d e f g h i j k l"),
       (5, "A b c d e f g h i j k l"), (None, "a b c d e f g h i j k l"), (6, LONG), (7, "12 345 !!"), (8, "12 345 !!"),
       (None, None)]


# ---- op11
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def features(text):
    w = WORDS.findall(low(text))
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute_resample(docs, target, min_words=20, percent=25):
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in features(x)[1]:
                counts[f] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    out = []
    for i, x in docs:
        n, f = features(x)
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([n, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[0] >= min_words), key=lambda r: (-r[4], r[1] is None, r[1]))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[5] = rank
    return sorted(map(str, (tuple(r[1:]) for r in out)))


def resampled_rows(df):
    return sorted(str((r.doc_id, r.n_features, r.weight, r.score, r.rank)) for r in df.collect())


def test_resample_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF_SMALL, "documents").collect()]
    target = [r.text for r in table(spark, SF_SMALL, "benchmark").collect()]
    assert resampled_rows(QUERIES["op11_resample"](spark, SF_SMALL)) == brute_resample(docs, target)


def test_resample_edges(spark):
    target = spark.createDataFrame([(None,), ("word end a b",)], "text string")
    rows = ODD + [(k, f"Ünïcode wörd {k} a-b") for k in range(20, 60)]
    got = resampled_rows(resample.resample(docs_of(spark, rows), target, min_words=4))
    assert got == brute_resample(rows, [None, "word end a b"], min_words=4)
    none = docs_of(spark, [])
    assert resample.resample(none, target).columns[:5] == ["doc_id", "n_features", "weight", "score", "rank"]
    assert resample.resample(none, target).count() == 0
    assert resample.resample(docs_of(spark, ODD), target.limit(0)).count() == len(ODD)
    assert resample.resampled(docs_of(spark, ODD), target, percent=100, min_words=1).columns == docs_of(spark, []).columns


@pytest.mark.parametrize("ids", [[5] * 40, [None] * 40, list(range(40)), [None, 3] * 20])
def test_resample_draws_exactly_the_wanted_number_from_ties(spark, ids):
    rows = [(i, "a b c d e f g h i j k l m n o p q r s t u") for i in ids]
    got = resample.resample(docs_of(spark, rows), spark.createDataFrame([("a b",)], "text string"), percent=30).collect()
    assert sorted(r.rank for r in got if r["rank"] is not None) == list(range(1, 13))
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    key = lambda r: (-r.score, r.doc_id is None, r.doc_id or 0)
    assert list(map(key, drawn)) == sorted(map(key, got))[:12]


@pytest.mark.parametrize("piece", [1, 7, 50])
def test_feature_buckets_do_not_depend_on_the_pieces(monkeypatch, piece):
    text = "Ein Wörd-paar, 12 x  yy zzz; ende a b c d".encode()
    whole = [np.sort(np.concatenate([b for _, b in resample.feature_buckets(text, 997, n)])) for n in (1, 2, 3)]
    monkeypatch.setattr(resample, "PIECE", piece)
    for n, expected in zip((1, 2, 3), whole):
        parts = list(resample.feature_buckets(text, 997, n))
        assert sum(w for w, _ in parts) == 12
        assert (np.sort(np.concatenate([b for _, b in parts])) == expected).all()


# ---- op12
def shingles(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return frozenset([" ".join(w)] if 0 < len(w) < size else [" ".join(w[k:k + size]) for k in range(len(w) - size + 1)])


def brute_classes(rows, size=3, percent=90):
    sets = [shingles(t, size) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            if same and 100 * same >= percent * len(a | sets[j]):
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(str((i, len(sets[k]), least.get(find(k)), links[k])) for k, (i, _) in enumerate(rows))


def classes_of(df):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id, r.n_links)) for r in df.collect())


def near_copies(n, words=60, edits=3, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
        out.append((k, " ".join(own)))
    return out


def test_ngram_join_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF_SMALL, "documents").collect()]
    assert classes_of(QUERIES["op12_ngram_join"](spark, SF_SMALL)) == brute_classes(rows)


@pytest.mark.parametrize("hot, tie, sets, grams", [(64, 2048, 512, 1 << 18), (2, 5, 7, 1 << 18), (2, 2048, 512, 300)])
def test_ngram_join_large_groups(spark, monkeypatch, hot, tie, sets, grams):
    """Near copies of which only some link: pair by pair, by hot n-grams, and in bands and blocks."""
    for name, value in (("HOT", hot), ("TIE_SETS", tie), ("BLOCK_SETS", sets), ("BLOCK_GRAMS", grams)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = near_copies(70) + [(i + 100, t) for i, t in near_copies(30, 200, 4, 2)] + near_copies(3)
    rows += [(200 + k, " ".join(f"y{j}" for j in range(60 + k))) for k in range(40)]      # a chain over many sizes
    assert classes_of(ngram_join.near_classes(docs_of(spark, rows))) == brute_classes(rows)


@pytest.mark.parametrize("size, percent", [(1, 50), (2, 80), (3, 100)])
def test_ngram_join_other_thresholds(spark, size, percent):
    rows = near_copies(40, 20, 6, 3) + ODD[:6]
    assert classes_of(ngram_join.near_classes(docs_of(spark, rows), size, percent)) == brute_classes(rows, size, percent)


def test_ngram_join_edges(spark):
    assert classes_of(ngram_join.near_classes(docs_of(spark, ODD))) == brute_classes(ODD)
    none = ngram_join.near_classes(docs_of(spark, []))
    assert none.columns == ["doc_id", "n_shingles", "component_id", "n_links"] and none.count() == 0


@pytest.mark.parametrize("piece", [1, 8, 100])
def test_gram_hashes_do_not_depend_on_the_pieces(monkeypatch, piece):
    texts = [b"", b" \t ", b"one", b"one two", b"one  two\x0bthree four\nfive A b c " * 3]
    whole = [ngram_join.gram_hashes(t) for t in texts]
    assert [len(x) for x in whole] == [len(shingles(t.decode())) for t in texts]
    monkeypatch.setattr(ngram_join, "PIECE", piece)
    for t, expected in zip(texts, whole):
        assert (ngram_join.gram_hashes(t) == expected).all()


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(3, k) for k in range(200, 260)]
    edges = spark.createDataFrame(chain[::-1] + star + [(7, 7)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 3 for k in [3, *range(200, 260)]}}
    assert graph.components(edges.limit(0)).count() == 0


# ---- op13
def brute_negatives(rows):
    fit = [((i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [math.floor(256 * x) for x in v]))
           for i, v, lab in rows if lab is not None and v is not None
           and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, (i, lab, v) in enumerate(fit):
        if i is None or i % 50:
            continue
        scored = [(sum(p * q for p, q in zip(v, w)), j, other == lab) for b, (j, other, w) in enumerate(fit) if b != a]
        for ps, pid, _ in sorted((x for x in scored if x[2]), key=key)[:5]:
            hard = sorted((x for x in scored if not x[2] and 50 * ps <= 100 * x[0] <= 95 * ps), key=key)[:3]
            out += [str((i, pid, rank, x[1], ps, x[0])) for rank, x in enumerate(hard, 1)]
    return sorted(out)


def negatives_of(df):
    return sorted(str((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score))
                  for r in df.collect())


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, 2) for i, v, lab in rows],
                                 "vec_id long, embedding array<float>, label int, cell int, rid long").repartition(3)


def some_vectors(n, dim, seed=0, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(k, np.float32(centres[k % 6] + spread * rng.normal(size=dim)).tolist(), int(rng.integers(4)))
            for k in range(n)]


@pytest.mark.parametrize("per_cell, block, first", [(250, 2048, 2000), (4, 16, 8), (4, 2048, 40)])
def test_hard_negatives_brute_force(spark, monkeypatch, per_cell, block, first):
    for name, value in (("ROWS_PER_CELL", per_cell), ("BLOCK_ROWS", block), ("FIRST_ROWS", first)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = some_vectors(300, 6)
    assert negatives_of(hard_negatives.mine(vectors(spark, rows))) == brute_negatives(rows)


def test_hard_negatives_edges(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS_PER_CELL", 4)
    rows = some_vectors(120, 3)
    rows += [(200, [0.5, None, 1.0], 1), (250, None, 1), (300, [float("nan"), 1.0, 2.0], 1), (350, [1.0, 1.0, 1.0], None),
             (400, [float("inf"), 1.0, 2.0], 1), (None, [1.0, 1.0, 0.9], 2), (None, [1.0, 1.0, 0.8], 1), (450, [], 2),
             (500, [2.0], 3), (550, [1.0, 1.0, 1.0], 1), (551, [1.0, 1.0, 1.0], 1), (552, [1.0, 1.0, 1.0], 1)]
    assert negatives_of(hard_negatives.mine(vectors(spark, rows))) == brute_negatives(rows)
    assert hard_negatives.mine(vectors(spark, [])).count() == 0
    assert hard_negatives.mine(vectors(spark, [(50, [], 1), (51, None, 2)])).count() == 0


def test_hard_negatives_stop_early(spark, monkeypatch):
    """Close clusters: certified anchors leave most cells out, with the same result."""
    for name, value in (("ROWS_PER_CELL", 4), ("FIRST_ROWS", 20)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = hard_negatives.integer_rows(vectors(spark, some_vectors(600, 4, spread=0.02)))
    index = hard_negatives.MultiIndex(rows)
    anchors = rows.where("vec_id % 50 = 0")
    asked = []
    whole = hard_negatives._meet
    count = spark.sparkContext.accumulator(0)

    def counted(*args):
        run = whole(*args)

        def counting(batches):
            def passed():
                for b in batches:
                    count.add(sum(b.column("asks").to_pylist()))
                    yield b
            return run(passed())
        return counting
    monkeypatch.setattr(hard_negatives, "_meet", counted)
    open_ = anchors.select("rid", F.lit(0).cast("long").alias("w"), F.lit(-(1 << 62)).alias("lo"), F.lit(1 << 62).alias("hi"))
    found = index.search(anchors, open_, 5, True)
    assert found.count() == 5 * anchors.count() and not asked
    assert count.value < anchors.count() * int((index.sizes > 0).sum()) / 2


@pytest.mark.parametrize("scale", [1, 100, 60_000])
def test_hard_negatives_in_chunks(spark, monkeypatch, scale):
    """Several chunks, rounds and rankings of a task, repeated rows, and scores that need 24, 53 or 64 bits."""
    for name, value in (("ROWS_PER_CELL", 8), ("BLOCK_ROWS", 16), ("FIRST_ROWS", 8), ("CHUNK", 8), ("PART_ROWS", 40),
                        ("TILE", 64), ("PENDING", 32)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = some_vectors(400, 5, spread=1.0)
    rows += rows[::25] + [(None, v, lab) for _, v, lab in rows[:200:50]] + [(k + 400, v, lab) for k, v, lab in rows[::3]]
    rows = [(i, np.float32(scale * np.array(v)).tolist(), lab) for i, v, lab in rows]
    index = hard_negatives.MultiIndex(hard_negatives.integer_rows(vectors(spark, rows)))
    assert (index.exact, index.stored) == {1: ("f4", "i2"), 100: ("f8", "i4"), 60_000: ("i8", "i4")}[scale]
    assert negatives_of(hard_negatives.mine(vectors(spark, rows))) == brute_negatives(rows)


def test_hard_negatives_hold_no_row_for_each_anchor_and_cell(spark, monkeypatch):
    """Vectors without clusters: every anchor asks for nearly all cells; a search still writes its best rows only."""
    for name, value in (("ROWS_PER_CELL", 4), ("FIRST_ROWS", 20)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = hard_negatives.integer_rows(vectors(spark, some_vectors(600, 8, spread=30.0)))
    index = hard_negatives.MultiIndex(rows)
    anchors = rows.where("vec_id % 50 = 0")
    written = {}
    whole = hard_negatives.cut_lineage

    def counted(df, name="stage", *args):
        out = whole(df, name, *args)
        written[name] = max(written.get(name, 0), out.count())
        return out
    monkeypatch.setattr(hard_negatives, "cut_lineage", counted)
    open_ = anchors.select("rid", F.lit(0).cast("long").alias("w"), F.lit(-(1 << 62)).alias("lo"), F.lit(1 << 62).alias("hi"))
    assert index.search(anchors, open_, 5, True).count() == 5 * anchors.count()
    assert int((index.sizes > 0).sum()) > 60 and max(written.values()) <= 5 * anchors.count(), written


def test_integer_bounds_hold():
    """Every row's score lies between its cell's bounds."""
    rng = np.random.default_rng(3)
    rows = np.floor(256 * rng.normal(size=(400, 6)))
    index = hard_negatives._Plain.__new__(hard_negatives._Plain)
    index.dim, index.cut = 6, 3
    index.books = [hard_negatives._codebook(rows[:, :3].copy(), 5), hard_negatives._codebook(rows[:, 3:].copy(), 5)]
    index.k2 = 5
    near = [hard_negatives._nearest(rows[:, :3], index.books[0]), hard_negatives._nearest(rows[:, 3:], index.books[1])]
    far = [np.sqrt(((rows[:, :3] - index.books[0][near[0]]) ** 2).sum(axis=1)),
           np.sqrt(((rows[:, 3:] - index.books[1][near[1]]) ** 2).sum(axis=1))]
    index.radii = [np.array([f[c == k].max() for k in range(5)]) for f, c in zip(far, near)]
    cells = near[0] * 5 + near[1]
    index.sizes = np.bincount(cells, minlength=25)
    for anchor in rows[:20]:
        order = list(index.in_order(anchor))
        assert [u for u, _, _ in order] == sorted((u for u, _, _ in order), reverse=True)
        assert sorted(c for _, _, c in order) == np.flatnonzero(index.sizes).tolist()
        for upper, lower, cell in order:
            s = rows[cells == cell] @ anchor
            assert lower <= s.min() and s.max() <= upper


def test_ngram_join_drops_the_shuffles_of_its_stage_tables(spark, monkeypatch):
    from quantloom import session
    from quantloom.llm import graph, ngram_join
    kept = []

    def cut(df, name="stage", drop_shuffles=False):
        if not drop_shuffles:
            kept.append(name)
        return session.cut_lineage(df, name, drop_shuffles)
    monkeypatch.setattr(ngram_join, "cut_lineage", cut)
    monkeypatch.setattr(graph, "cut_lineage", cut)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[:58 + k])) for k in range(3)] + [(7, "a b c"), (8, None)]
    got = ngram_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 0, 2: 0, 7: 7, 8: 8}
    assert kept == ["ngram_rows"]           # the one table that is written without a shuffle
