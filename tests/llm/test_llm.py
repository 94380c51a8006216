"""Training-data operators: SQL comparison, brute force on small fixtures, and the defined edge cases."""
import hashlib
import html
import os
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from oracle import compare
from quantloom.llm import (chat_format, decontam, exact_dedup, html_extract, langid, licenses, line_dedup, packing,
                           quality, simhash)
from quantloom.llm.queries import QUERIES, SQL, TOKENIZER, table

SF_SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _h string, rank int"
LONG = "word " * 30000 + "end"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    full = [(i, t, lang, None, None if t is None else len(t), "x", 1) for i, t, lang in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, [(1, None, None), (2, "", "en"), (3, " \t\n", None), (4, "a b c", "en"), (5, "a b c", "en"),
                           (5, "a b c", "en"), (None, "a b c", None), (6, LONG, "en"), (7, "12 345 !!", "de")])


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    _, problems = compare(spark, duck, name, QUERIES[name], SQL[name], SF_SMALL)
    assert not problems, problems


# ---- op1
def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T &amp; t</title>{head}</head><body>{body}</body></html>"


def test_html_article_text(spark):
    got = QUERIES["op1_html_extract"](spark, SF_SMALL).collect()
    raw = {r.page_id: r.html for r in table(spark, SF_SMALL, "pages").collect()}
    assert len(got) == len(raw)
    for r in got:
        article = re.search(r"<article>(.*?)(</article>|\Z)", raw[r.page_id], re.S).group(1).replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_html_cases():
    w = html_extract.Weights({}, {})
    body = ("<nav><ul><li><a href='/'>Home page</a></ul></nav><div class='cookie-notice'>We use cookies here</div>"
            "<main><h1>The  title</h1><p>First &lt;b&gt; para<br>goes on &eacute;</p><div class=ad>Buy now</div>"
            "<form><p>Your mail</p></form><p>Second para with more words<script>var x='</p>';</script> end</p></main>"
            "<section id='comments'><p>Nice post said a reader of this page</p></section><aside>Side bar text</aside>"
            "<footer>Some footer words</footer>")
    assert html_extract.extract(page(body), w)[0] == (
        "The title\nFirst <b> para goes on é\nSecond para with more words end")
    for p in (None, "", "<p", "<!-- open", "<script>x", "</div></div>", "<a href='x>y"):
        assert html_extract.extract(p, w)[0] == ""
    assert html_extract.extract("<", w)[0] == "<"
    assert html_extract.extract("plain words only", w)[0] == "plain words only"
    assert html_extract.best_range([-1, 2, -1, 3, -9, 4]) == (1, 4)
    assert html_extract.best_range([-1.0, 0.0]) == (0, 0)


@pytest.mark.parametrize("start, end", [
    ("<html class='js-search'><body>", ""), ("<body class='has-sidebar'>", ""), ("<main class='no-banner'>", "</main>"),
    ("<article class='related'>", "</article>"), ("<div id='with-sidebar'><div><article>", "</article></div></div>"),
    ("<article title='Hidden Figures'>", "</article>"), ("<article data-title='a hidden role=alert'>", "</article>"),
    ("<article data-id='menu' aria-hidden=false>", "</article>"), ("<span itemprop=articleBody>", "</span>")])
def test_html_article_is_not_skipped(start, end):
    text = f"{start}<h1>The title</h1><p>First para of the text</p><p>Second para</p>{end}"
    got = html_extract.extract(text, html_extract.Weights({}, {}))[0]
    assert got == "The title\nFirst para of the text\nSecond para"


@pytest.mark.parametrize("part", [
    "<button>Sign up</button>", "<label>Your name</label>", "<audio>No sound</audio>", "<video>No film</video>",
    "<canvas>No picture</canvas>", "<span class='advert'>Buy <span>all</span> now</span>", "<span hidden>secret</span>",
    "<i style='display: none'>unseen</i>", "<a class='share' href='/'>Share this</a>", "<b aria-hidden='true'>x</b>",
    "<input hidden>", "<section id=comments><article class=comment><p>Nice post</p></article></section>"])
def test_html_inline_skips(part):
    text = f"<article><p>First para{part} goes on</p><p>Second para</p></article>"
    got = html_extract.extract(text, html_extract.Weights({}, {}))[0]
    assert got.replace("\n", " ") == "First para goes on Second para"


def test_html_long_skipped_parts(spark):
    """An aside longer than the lead before it, and plain paragraphs of comments longer than the articles."""
    say = lambda what, n: " ".join(f"{what}{k}" for k in range(n))
    aside = "<aside>" + f"<div><p>{say('aside', 60)}</p></div>" * 10 + "</aside>"
    comments = "<section id='comments'>" + f"<p>{say('reader', 100)}</p>" * 9 + "</section>"
    pages = [(k, "u", page(f"<nav><a href='/'>Home</a></nav><article><h1>Title {k}</h1><p>{say('lead', 40)}</p>{aside}"
                           f"<p>{say('tail', 50)}</p></article>{comments}<footer>Foot words</footer>")) for k in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for w in (html_extract.fit(df), html_extract.Weights({}, {})):
        got = {r.page_id: r.text for r in html_extract.extract_pages(df, w).collect()}
        assert got == {k: f"Title {k}\n{say('lead', 40)}\n{say('tail', 50)}" for k in range(30)}


# ---- op2
def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits):
    ids, root = sorted(fps), {}
    for i in ids:
        root[i] = i
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents")
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    got = rows_of(QUERIES["op2_simhash"](spark, SF_SMALL))
    want = brute_components(fps, 2)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {
        i: (f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_simhash_links(spark, bits):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    fps = {len(base) * k + j: b ^ sum(1 << int(x) for x in rng.choice(64, int(rng.integers(0, 4)), False))
           for k in range(4) for j, b in enumerate(base)}
    signed = {i: f - 2**64 if f >= 2**63 else f for i, f in fps.items()}
    df = spark.createDataFrame([(f,) for f in set(signed.values())], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, bits)).collect()}
    got = {}
    for i, f in signed.items():
        got.setdefault(roots.get(f, f), set()).add(i)
    want = {}
    for i, c in brute_components(fps, bits).items():
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_edges(odd, empty):
    rows = simhash.near_groups(odd).collect()
    zero = {r.doc_id: r for r in rows if r.doc_id in (1, 2, 3)}
    assert len(rows) == 9 and {r.component_id for r in zero.values()} == {1}
    assert {r.fingerprint for r in zero.values()} == {"0" * 16}
    assert {r.component_id for r in rows if r.doc_id in (4, 5, None)} == {4}
    assert simhash.near_groups(empty).count() == 0
    kept = simhash.drop_near(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 7]


def test_drop_near_keeps_rows_without_a_near_copy(spark):
    """Null ids of different texts, one of them a copy, and a repeated id with different texts."""
    texts = {k: " ".join(f"{k}{j}" for j in range(40)) for k in "abcdefg"}
    rows = [(3, texts["a"]), (None, texts["a"]), (None, texts["b"]), (None, texts["c"]), (None, texts["c"]),
            (7, texts["d"]), (7, texts["e"]), (8, texts["e"]), (9, texts["f"]), (10, texts["f"]), (10, texts["g"])]
    kept = simhash.drop_near(docs_of(spark, [(i, t, "en") for i, t in rows]))
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    want = [(3, "a"), (None, "b"), (None, "c"), (7, "d"), (7, "e"), (9, "f"), (10, "g")]
    assert got == sorted(((i, texts[k]) for i, k in want), key=str)


# ---- op3
def test_langid_held_out_accuracy(spark):
    sf = os.path.join(os.path.dirname(SF_SMALL), "sf0.01")
    truth = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    got = rows_of(QUERIES["op3_langid"](spark, sf))
    held = [i for i, r in got.items() if r.held_out]
    assert len(got) == len(truth) and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held)
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_langid_edges(odd, empty):
    model = langid.fit(odd, sample_docs=100)
    got = rows_of(langid.predict(odd.where("doc_id IS NOT NULL"), model))
    assert {i: r.lang_pred for i, r in got.items()} == {1: "und", 2: "und", 3: "und", 4: "en", 5: "en", 6: "en", 7: "und"}
    assert langid.predict(empty, model).count() == 0
    none = langid.fit(empty)
    assert none.langs == [] and {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


def test_langid_backs_off_to_shorter_grams():
    model = langid._model(["a", "b"], [("xyz", {"a": 5})], [("qu", {"b": 9, "a": 1}), ("q", {"a": 1, "b": 1}), ("z", {"a": 9})])
    scorer = langid.Scorer(model)
    (known, p), (unseen, _), (last, _) = scorer.predict_all(["xyz", "qu", "z"])
    assert (known, unseen, last) == ("a", "b", "a") and 0.5 < p <= 1


# ---- op4
def test_quality_separates_labels(spark):
    sf = os.path.join(os.path.dirname(SF_SMALL), "sf0.01")
    got = rows_of(QUERIES["op4_quality"](spark, sf))
    lab = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    assert len(got) == table(spark, sf, "documents").count()
    assert np.mean([got[i].good == (q > 0) for i, q in lab.items()]) > 0.95


def test_quality_edges(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(odd, quality.fit(odd, none)).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1, None), (4, 1, 0), (None, 0, 0), (2, None, 1)], none.schema)
    assert {r.score for r in quality.score(odd, quality.fit(odd, one)).collect()} == {1.0}
    assert quality.score(empty, quality.fit(empty, one)).count() == 0


def test_co_training_hands_labels_over():
    rng = np.random.default_rng(1)
    y = (np.arange(400) % 2).astype(float)
    text, meta = y[:, None] * 3 + rng.normal(size=(400, 2)), y[:, None] * 3 + rng.normal(size=(400, 2))
    model = quality.co_train(text[:60], meta[:60], y[:60], text[60:], meta[60:])
    assert len(model.rounds) == quality.ROUNDS and all(n > 0 for r in model.rounds for n in r)
    assert np.mean((model.score(text, meta) >= 0.5) == (y > 0)) > 0.95


# ---- op5
def brute_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(k, label) for k in range(len(words)) for p, label in licenses.BASE.items()
            if words[k:k + len(p.split())] == p.split()]
    at = [k for k, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_licenses_brute_force(spark):
    got = rows_of(QUERIES["op5_licenses"](spark, SF_SMALL))
    for r in table(spark, SF_SMALL, "documents").collect():
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == brute_base(r.text)
        assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(","))


@pytest.mark.parametrize("text", [None, "", "MIT license MIT License. mit\nlicense", "xmit license", "cc-by cc by by",
                                  "Ämit license apache license", "GNU  General\tPublic-License, apache license"])
def test_licenses_base_places(text):
    g = licenses.scan(text or "")
    assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == brute_base(text)


def test_license_expressions():
    ev = lambda s: licenses.evaluate(licenses.expression_tokens(s))
    assert ev("MIT OR GPL-2.0-only AND Apache-2.0") == (1.0, ["MIT", "GPL-2.0-only", "Apache-2.0"])
    assert ev("(MIT OR GPL-2.0-only) AND GPL-3.0")[0] == 0.3
    assert ev("GPL-2.0-only WITH Classpath-exception-2.0") == (pytest.approx(0.65), ["GPL-2.0-only"])
    assert ev("MIT some other words")[1] == ["MIT"] and ev("( MIT")[0] is None and ev("")[0] is None
    g = licenses.scan("# SPDX-License-Identifier: Apache-2.0 OR (LGPL-2.1+ AND MIT)\nall rights reserved")
    assert g["labels"] == "apache,lgpl,mit,proprietary" and g["score"] == 1.0 and g["base_labels"] == ""


# ---- op6
def brute_lines(rows, t=0.8):
    """Removed line numbers by comparing every line with every line before it."""
    seen, out = [], {}
    for doc, text in rows:
        out[doc] = []
        for k, line in enumerate((text or "").split("\n")):
            words = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.lower()))
            if words:
                if any(len(words & w) >= t * len(words | w) - 1e-12 for w in seen):
                    out[doc].append(k)
                seen.append(words)
    return out


def test_line_dedup_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents")
    want = brute_lines(sorted((r.doc_id, r.text) for r in docs.collect()))
    got = rows_of(QUERIES["op6_line_dedup"](spark, SF_SMALL))
    assert {i: r.removed for i, r in got.items()} == want
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    for r in docs.collect():
        assert texts[r.doc_id] == "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in want[r.doc_id])


def test_line_dedup_group_of_near_copies(spark):
    """Chains of edits: lines close to others than the earliest of their group."""
    base = [f"w{k}" for k in range(20)]
    rows = [(i, " ".join(base[:k] + [f"x{j}" for j in range(k, min(20, k + i % 5))] + base[k + i % 5:]) + f"\nown{i} line{i}")
            for i in range(60) for k in [i % 11]]
    got = rows_of(line_dedup.line_decisions(docs_of(spark, [(i, t, "en") for i, t in rows])))
    assert {i: r.removed for i, r in got.items()} == brute_lines(rows)


def test_line_dedup_edges(odd, empty):
    got = {(r.doc_id, r.n_lines): r.removed for r in line_dedup.line_decisions(odd).collect()}
    assert got == {(1, 1): [], (2, 1): [], (3, 2): [], (None, 1): [], (4, 1): [0], (5, 1): [0], (6, 1): [], (7, 1): []}
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns
    assert {r.doc_id: r.text for r in out.collect()} == {
        1: None, 2: "", 3: " \t\n", None: "a b c", 4: "", 5: "", 6: LONG, 7: "12 345 !!"}
    assert line_dedup.line_decisions(empty).count() == 0


def test_line_dedup_rows_that_share_an_id(spark):
    """Null ids and a repeated id with different texts: only lines that stand elsewhere go, from their own row."""
    shared = "one two three four five six"
    rows = [(None, f"{shared}\nonly in the first null row"), (None, "text of the second null row\nkept as its own line"),
            (None, f"nothing like it here\n{shared} seven"), (8, f"{shared}\nfirst of eight"),
            (8, "second text under id eight\nmore of the second text"), (9, "more of the second text\nnine alone")]
    docs = docs_of(spark, [(i, t, "en") for i, t in rows])
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(rows)
    left = [x for r in got for x in r.text.split("\n") if x]
    lines = {x for _, t in rows for x in t.split("\n")}
    near = {shared, f"{shared} seven"}
    assert {x for x in left if x not in near} == lines - near and len([x for x in left if x in near]) == 1
    assert left.count("more of the second text") == 1 and {r.text for r in got if r.doc_id == 9} == {"nine alone"}
    said = line_dedup.line_decisions(docs).collect()
    assert sum(r.n_removed for r in said) == 3 and sum(r.n_lines for r in said) == 12
    copies = docs_of(spark, [(None, "same old line", "en")] * 2 + [(None, "other", "en")])
    assert {r.n_removed for r in line_dedup.line_decisions(copies).collect()} == {0}


def test_line_dedup_hot_words_meet_their_leader_first(spark, monkeypatch):
    """With few sets to a hot word: leaders that match, leaders that do not, and words kept apart for a shared bit."""
    monkeypatch.setattr(line_dedup, "HOT", 3)
    rows = [(i, "\n".join(" ".join([f"w{(i * 7 + j) % 23}" if j == i % 4 else f"w{j + 12 * (k + i % 2)}" for j in range(11)])
                          for k in range(3))) for i in range(40)]
    want = brute_lines(rows)
    assert any(want.values()) and not all(len(x) == 3 for x in want.values())
    for bits in (line_dedup.FILTER_BITS, 64):
        monkeypatch.setattr(line_dedup, "FILTER_BITS", bits)
        got = rows_of(line_dedup.line_decisions(docs_of(spark, [(i, t, "en") for i, t in rows])))
        assert {i: r.removed for i, r in got.items()} == want


def test_line_dedup_deals_its_prefixes_once(spark):
    """Both sides of the join of the prefix rows read one exchange."""
    docs = docs_of(spark, [(i, f"one two three four five six seven number{i}", "en") for i in range(9)])
    join = line_dedup._Join(line_dedup._texts(docs, "doc_id", "text"), 0.8)
    rows = join._prefixes(join.sets)
    small, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"
    before = {k: spark.conf.get(k) for k in (small, adaptive)}
    try:
        spark.conf.set(small, "-1")
        spark.conf.set(adaptive, "false")
        plan = join._meet(rows, rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("ReusedExchange") == 1 and plan.count("+- Exchange hashpartitioning") == 1


def test_line_dedup_lines_of_the_letter_f_have_words(spark):
    """The form feed is white space, the letter f is a word."""
    rows = [(1, "f\nother words here"), (2, "ff f\nf\n\x0c\n \t\x0b\r"), (3, "f ff\n\x0cf")]
    got = rows_of(line_dedup.line_decisions(docs_of(spark, [(i, t, "en") for i, t in rows])))
    assert {i: r.removed for i, r in got.items()} == brute_lines(rows) == {1: [], 2: [1], 3: [0, 1]}


# ---- op7
def test_decontamination_brute_force(spark):
    items = {r.item_id: r.text for r in table(spark, SF_SMALL, "benchmark").collect()}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontam"](spark, SF_SMALL).collect()}
    index = decontam.BlockMaxIndex(sorted(items.items()))
    number = {i: k for k, (i, _) in enumerate(index.items)}
    want = set()
    for r in table(spark, SF_SMALL, "documents").collect():
        words = decontam.words_of(r.text)
        for s in range(0, max(1, len(words) - index.longest), index.longest):
            part = words[s:s + 2 * index.longest]
            for i, k in number.items():
                score = sum(x for w in set(part) for n, x in index.postings.get(w, ()) if n == k)
                q, a = index.verify(k, part)
                if score >= index.threshold - 1e-9 and q >= decontam.QUESTION_OVERLAP and a >= decontam.ANSWER_OVERLAP:
                    want.add((r.doc_id, i))
    assert got == want
    assert {(r.doc_id, i) for r in table(spark, SF_SMALL, "documents").collect() for i, t in items.items()
            if t in r.text} <= got


def test_wand_returns_all_above_threshold():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rng.choice(words, 12))) for i in range(150)]
    for threshold in (0.2, 0.5, 0.9):
        index = decontam.BlockMaxIndex(items, 4, threshold)
        for _ in range(40):
            q = set(rng.choice(words, 25))
            want = {}
            for w in q:
                for n, x in index.postings.get(w, ()):
                    want[n] = want.get(n, 0) + x
            assert {n for n, _ in index.retrieve(q)} == {n for n, x in want.items() if x >= threshold - 1e-9}


def test_decontamination_edges(spark, odd, empty):
    bench = spark.createDataFrame([(1, "a b c. Word end."), (2, None), (3, ""), (4, "a b c. Word end.")],
                                  "item_id long, text string")
    none = bench.limit(0)
    assert decontam.find_leaks(odd, none).count() == 0 and decontam.find_leaks(empty, bench).count() == 0
    leak = docs_of(spark, [(9, "x y z A B C -- word END q", None), (10, "nothing here", None)])
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(leak, bench).collect()} == {(9, 1), (9, 4)}
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(leak, bench, max_index_words=3).collect()} == {(9, 1), (9, 4)}
    kept = decontam.remove_leaks(leak, bench)
    assert kept.columns == leak.columns and [r.doc_id for r in kept.collect()] == [10]


def test_decontamination_null_ids(spark):
    """Documents and items without an id: found, and only the leaking rows go."""
    bench = spark.createDataFrame([(1, "a b c. Word end."), (None, "d e f. Other end."), (None, "g h i. Third end.")],
                                  "item_id long, text string")
    rows = [(None, "x A B C word end y"), (None, "clean words"), (5, "d e f other end"), (5, "clean as well"),
            (6, "g h i third end")]
    docs = docs_of(spark, [(i, t, None) for i, t in rows])
    for size in (decontam.MAX_INDEX_WORDS, 3):
        got = sorted(((r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench, max_index_words=size).collect()), key=str)
        assert got == sorted([(None, 1), (5, None), (6, None)], key=str)
    assert {(r.doc_id, r.text) for r in decontam.remove_leaks(docs, bench).collect()} == {
        (None, "clean words"), (5, "clean as well")}


def test_decontamination_parts_agree(spark):
    """Partial passages: one index and many parts give the same rows."""
    rng = np.random.default_rng(7)
    vocab = [f"w{k}" for k in range(300)]
    items = [(i, " ".join(rng.choice(vocab[:40 + 13 * (i % 20)], 8 + 2 * i)) + ". " + " ".join(rng.choice(vocab, 5)) + ".")
             for i in range(40)]
    docs = []
    for i, t in items:
        words = t.split()
        for cut in range(1, 6):
            docs.append((10 * i + cut, " ".join(["filler"] * 9 + words[len(words) * cut // 12:] + ["more"] * 7), "en"))
    docs, bench = docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    one, many = ({(r.doc_id, r.item_id): r for r in decontam.find_leaks(docs, bench, max_index_words=size).collect()}
                 for size in (decontam.MAX_INDEX_WORDS, 150))
    assert one == many and 40 < len(one) < 200


def test_decontamination_edited_short_answer():
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen? Blue whale."
    index = decontam.BlockMaxIndex([(1, item)])
    found = lambda t: [x[:2] for x in decontam._search(index, [5], [t])]
    assert found(item) == [(5, 1)] and found(item.replace("whale", "shark")) == [(5, 1)]
    assert found("one two three four five six seven eight x y z. Blue shark.") == []


# ---- op8
def test_chat_round_trip(spark):
    texts = ["a\\b", "</s>[INST] ok [/INST]", "\\[INST] <<SYS>> \\\\", "", None, "<s> <s>\n </s>", "[[INST]]", " x ",
             "<<TURN>>a <<TEXT>> b <</TURN>>", LONG]
    rows = [(i, k, role, texts[(i + k) % len(texts)]) for i in range(12)
            for k, role in enumerate(["system", "user", "assistant", "tool\n<s>", None, "assistant"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    chats = chat_format.format_chats(df)
    read = chats.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"),
                        chat_format.loss_text(F.col("segments")).alias("loss"), "valid", "bad_turn")
    for r in read.collect():
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.t] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")
        assert not r.valid and r.bad_turn == 3


def test_chat_order(spark):
    cases = {"su": True, "sua": True, "ua": True, "uau": True, "": None, "a": False, "uu": False, "us": False, "sa": False}
    names = {"s": "system", "u": "user", "a": "assistant"}
    rows = [(i, k, names[c], "t") for i, roles in enumerate(cases) for k, c in enumerate(roles)]
    got = rows_of(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")),
                  "conv_id")
    assert {k: got[i].valid for i, k in enumerate(cases) if k} == {k: v for k, v in cases.items() if k}
    assert [got[i].complete for i, k in enumerate(cases) if k] == [k.endswith("a") and v for k, v in cases.items() if k]
    none = chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert none.count() == 0


# ---- op9
def test_exact_dedup_edges(spark, odd, empty):
    rows = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(odd).collect()]
    key = lambda x: str(x)
    assert sorted(rows, key=key) == sorted(
        [(1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True), (4, 4, 4, True), (5, 4, 4, False), (5, 4, 4, False),
         (None, 4, 4, False), (6, 6, 1, True), (7, 7, 1, True)], key=key)
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7]
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_compares_contents(spark):
    """A digest of four bits: most contents share theirs, the groups must stay apart."""
    docs = docs_of(spark, [(k, f"text {k % 40} " + " " * (k % 3), "en") for k in range(200)])
    weak = lambda c: F.substring(exact_dedup.sha256_hex(c), 1, 1)
    pick = lambda df: sorted((r.doc_id, r.keep_id, r.group_size) for r in df.collect())
    assert pick(exact_dedup.exact_groups(docs, digest=weak)) == pick(exact_dedup.exact_groups(docs))


# ---- op10
def test_packing_round_trip(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path(TOKENIZER)
    tok = Tokenizer.from_file(path)
    pieces = packing.pack(odd, path, 512)
    rows = pieces.collect()
    place = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and r.offset + r.length <= 512
        for k, x in enumerate(ids):
            assert place.setdefault((r.sequence_id, r.offset + k), x) is x
    assert sorted(place) == [(k // 512, k % 512) for k in range(len(place))]
    stream, want = [place[k] for k in sorted(place)], []
    for r in odd.collect():
        want.append(tok.encode(r.text or "", add_special_tokens=False).ids + [1])
    assert sorted(map(tuple, np.split(stream, np.flatnonzero(np.array(stream) == 1)[:-1] + 1))) == sorted(map(tuple, want))
    seqs = {r.sequence_id: r for r in packing.assemble(pieces, 512, 0).collect()}
    assert all(len(r.ids) == 512 for r in seqs.values())
    assert [x for k in sorted(seqs) for x in seqs[k].ids[:seqs[k].n_tokens]] == stream
    assert packing.pack(empty, path).count() == 0


def test_merge_ranks_give_the_tokenizers_ids():
    import public_tokenizers
    from tokenizers import Tokenizer
    enc, tok = packing.encoder(public_tokenizers.path(TOKENIZER)), Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    texts = ["", " a  b\n\n c\t", "it's I'LL don't", "x<|endoftext|> y", "naïve日本 ١٢٣", "a b c​d", "  "]
    texts += [f"q{chr(c)} {chr(c)}{chr(c)}z 1{chr(c)}" for c in range(0x500)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids


# ---- pipeline
def test_pipeline_against_stage_decisions(spark):
    docs = table(spark, SF_SMALL, "documents")
    cols, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF_SMALL)
        assert kept.columns == cols, name
    left = {r.doc_id: r.text for r in kept.collect()}
    gone = brute_lines(sorted((r.doc_id, r.text) for r in docs.collect()))
    lines = {r.doc_id: "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone[r.doc_id])
             for r in docs.collect()}
    first = brute_components({i: brute_fingerprint(t) for i, t in lines.items()}, 2)
    items = [decontam.words_of(r.text) for r in table(spark, SF_SMALL, "benchmark").collect()]
    holds = lambda t: any(" ".join(w) in " ".join(decontam.words_of(t)) for w in items)
    want = {i for i, t in lines.items() if first[i] == i and not holds(t)}
    assert set(left) <= {i for i in lines if first[i] == i} and want - set(left) == set()
    assert all(left[i] == lines[i] for i in left)
    total = corpus_pipeline.run(spark, SF_SMALL).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d"))
    rows = total.collect()
    assert {r.doc_id for r in rows} == set(left) and all(r.n == r.d for r in rows)


def test_pipeline_empty_and_odd(spark, odd, empty, tmp_path):
    """Of equal texts the first line stays in the row with the null id, whose document then outlives its copies."""
    for name, docs, want in (("odd", odd, {None, 4, 6}), ("empty", empty, set())):
        os.makedirs(tmp_path / name)
        docs.drop("_h", "rank").write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / name)).collect()} == want


def test_digests_of_the_probe_conversation(spark):
    r = QUERIES["op8_chat_format"](spark, SF_SMALL).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    said = f"user\n{text}\nassistant\n{text}\n"
    assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.loss_chars == len(text)
    assert r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
