"""Extraction, language and quality rules of the contracts, and edge cases of the operators' own functions."""
import itertools
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import batches, chat_format, html_extract, langid, licenses, packing, quality


# ---- op1
@pytest.mark.parametrize("part, kept", [
    ("<section id='discussion'><p>forty words of it</p></section>", "forty words of it"),
    ("<h2 id='search-algorithms'>Search algorithms</h2>", "Search algorithms"),
    ("<h2 id='related-work'>Related work</h2>", "Related work"),
    ("<p class='social-science'>A study of people</p>", "A study of people"),
    ("<p id='ad-hoc'>An ad hoc rule</p>", "An ad hoc rule"),
    ("<div class='social-science'><p>More of it</p></div>", "More of it"),
    ("<section id='related-work'><p>Others did this</p></section>", "Others did this"),
    ("<div class='share-buttons'>Share</div>", ""), ("<div class='cookie-notice'>We use them</div>", ""),
    ("<p class='advert'>Buy</p>", ""), ("<div id='comments'><p>Nice</p></div>", ""), ("<div class='notice'>Moved</div>", ""),
    ("<ul class='related-posts'><li>One</ul>", ""), ("<div class='ad'>Buy</div>", "")])
def test_names_inside_a_marked_article(part, kept):
    text = f"<body><article><p>First para</p>{part}<p>Second para</p></article></body>"
    got = html_extract.extract(text, html_extract.Weights({}, {}))[0]
    assert got == "\n".join(x for x in ("First para", kept, "Second para") if x)


@pytest.mark.parametrize("page", [
    "<div>" * 30000 + "<i>" * 30000 + "words at last", "<div class=menu>" * 20000 + "<article>" * 20000 + "<p>x",
    "<article>" + "<i><p>a</p>" * 20000, "<a class=share>" * 20000 + "</b>" * 20000, "<p><i>" * 20000 + "</p>" * 20000])
def test_deeply_nested_pages_are_read_in_linear_time(page):
    began = time.process_time()
    html_extract.extract(page, html_extract.Weights({}, {}))
    assert time.process_time() - began < 3


def test_best_range_against_all_ranges():
    rng = random.Random(4)
    for _ in range(400):
        scores = [rng.randint(-4, 4) for _ in range(rng.randint(0, 12))]
        ranges = [(a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        top = max((sum(scores[a:b]) for a, b in ranges), default=0)
        a, b = html_extract.best_range(scores)
        assert sum(scores[a:b]) == max(0, top) and ((a, b) == (0, 0) or top > 0)
        if top > 0:     # the first of equals, by its end
            assert b == min(y for x, y in ranges if sum(scores[x:y]) == top)


def test_pages_edges(spark):
    long = "<article>" + "<p>one two three</p>" * 30000 + "</article>"
    rows = [(1, "u", None, 1), (2, "u", "", 1), (3, None, "<p>Some words here</p>", 1), (3, None, "<p>Some words here</p>", 1),
            (None, "v", long, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, first_token int")
    got = html_extract.extract_pages(pages, html_extract.fit(pages)).collect()
    assert sorted((r.page_id or 0, len(r.text)) for r in got) == [(0, 30000 * 14 - 1), (1, 0), (2, 0), (3, 15), (3, 15)]
    none = pages.limit(0)
    assert html_extract.extract_pages(none, html_extract.fit(none)).count() == 0


# ---- op3
@pytest.mark.parametrize("text, words", [("½ ① ²", []), ("a½b ①c", ["a", "b", "c"]), ("Straße 12 x_y", ["straße", "x", "y"])])
def test_numerals_are_no_letters(text, words):
    assert langid.words_of(text) == words


def brute_language(model, text):
    """Scores by the rule, word by word."""
    totals = np.zeros(len(model.langs))
    for word, n in Counter(langid.words_of(text)).items():
        if word in model.words:
            totals += n * model.table[model.words[word]]
            continue
        marked, at = f"_{word}_", 0
        while at < len(marked):
            step = next((k for k in (4, 3, 2, 1) if at + k <= len(marked) and marked[at:at + k] in model.grams), 0)
            if step:
                totals += n * model.table[model.grams[marked[at:at + step]]]
            at += step or 1
    return model.langs[int(totals.argmax())], float(1 / np.exp(totals - totals.max()).sum())


def test_scorer_against_the_rule(monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(200)]
    known = [(w, {"x": rng.randint(0, 5), "y": rng.randint(0, 5), "z": 1}) for w in dict.fromkeys(words[:80])]
    grams = [("".join(g), {"x": rng.randint(0, 9), "y": rng.randint(0, 9), "z": 2}) for k in (1, 2, 3)
             for g in itertools.product("abcde_", repeat=k) if rng.random() < 0.6]
    model = langid._model(["x", "y", "z"], known, grams)
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 15))) for _ in range(120)]
    monkeypatch.setattr(langid, "CACHE_WORDS", 20)            # forgets often
    scorer = langid.Scorer(model)
    for k in range(0, 120, 10):
        for text, (lang, score) in zip(texts[k:k + 10], scorer.predict_all(texts[k:k + 10])):
            assert (lang, pytest.approx(score, abs=1e-4)) == brute_language(model, text)


# ---- op4
def test_quality_sample_is_bounded_whatever_the_ids(spark, monkeypatch):
    """Half of the rows with null ids, a third of all with one text."""
    rows = spark.range(6000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.when(
        F.col("id") % 3 == 0, F.lit("the same text")).otherwise(F.concat(F.lit("text of "), "id")).alias("text"),
        F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(5).alias("n_chars"))
    labels = rows.where("doc_id < 3000").select("doc_id", (F.col("doc_id") % 4 / 2).cast("int").alias("quality"))
    seen = {}
    monkeypatch.setattr(quality, "co_train", lambda text, meta, y, pool, pool_meta, rounds: seen.update(
        labelled=len(text), pool=len(pool), y=len(y)))
    quality.fit(rows, labels, sample_labelled=200, sample_pool=100)
    assert 150 <= seen["labelled"] == seen["y"] <= 200 and 50 <= seen["pool"] <= 100


def test_quality_ranks_held_out_labels(spark):
    """Area under the curve on labelled documents that the fit never saw."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 0"))
    scored = quality.score(docs.where("doc_id % 2 = 1"), model).join(labels, "doc_id").where("quality IS NOT NULL")
    got = scored.select("score", "quality").toPandas()
    good, bad = got[got.quality > 0].score.to_numpy(), got[got.quality <= 0].score.to_numpy()
    auc = np.mean((good[:, None] > bad) + 0.5 * (good[:, None] == bad))
    assert len(good) and len(bad) and auc > 0.95


# ---- op5, op8
def test_license_edges(spark):
    schema = "doc_id long, text string, labels string, n_words int"
    rows = [(None, "The MIT License", "x", 1), (None, "The MIT License", "x", 1), (2, None, "x", 1), (3, "", "x", 1)]
    got = sorted((r.doc_id or 0, r.base_labels, r.n_base, r.n_words) for r in
                 licenses.scan_licenses(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, "mit", 1, 3), (0, "mit", 1, 3), (2, "", 0, 0), (3, "", 0, 0)]
    assert licenses.scan_licenses(spark.createDataFrame([], schema)).count() == 0


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (5, 0, "user", "x"), (5, 0, "user", "x"), (5, 0, "assistant", "y")]
    got = {r.conv_id: r for r in chat_format.format_chats(spark.createDataFrame(rows, schema)).select(
        "conv_id", chat_format.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert [(t.role, t.text) for t in got[None].turns] == [("user", "a"), ("assistant", "b")]
    assert sorted((t.role, t.text) for t in got[5].turns) == [("assistant", "y"), ("user", "x"), ("user", "x")]
    assert chat_format.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_workers_give_memory_back():
    class Batch:
        num_rows = 3

        def slice(self, k, n):
            return k, n
    assert list(batches.small([Batch(), Batch()], 2)) == [(0, 2), (2, 2)] * 2
    batches.give_back()
    assert packing.encoder is not None
