"""Quality classifier by co-training of a text view and a metadata view.

The text view sees only the text (shares of character-class trigrams, word
statistics); the metadata view sees only ``source``, ``lang`` and ``n_chars``.  Each view is a
logistic regression.  In every round each view labels the unlabelled documents
of which it is surest (calibrated probability at least ``CONFIDENT``, at most ``PER_ROUND``
of each class) and hands them to the other view.  After the rounds both
views are calibrated on labelled documents that neither was trained on, and a document's score is the
product of the calibrated odds over the prior odds.

``fit`` uses at most ``sample_labelled`` labelled and ``sample_pool``
unlabelled documents, taken by a hash of id and text (the documented bounds); only their feature
vectors reach the driver.  ``score`` covers every document and its whole text.

Defined cases: null texts count as empty, null metadata as a category of its
own; a fit without labels, or with one class only, gives the same score (the share of good labels, or 0.5)
to every document; labels of a document that contradict each other are all used; repeated rows score alike.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.batches import small

SAMPLE_LABELLED = 6000
SAMPLE_POOL = 6000
ROUNDS = 3
PER_ROUND = 300
CONFIDENT = 0.9
CALIBRATION_FOLD = 4      # every fourth labelled document calibrates
# character classes: space, newline, lower, upper, digit, stop, bracket or quote, other mark, non-ASCII
N_CLASSES = 9
_CLASS = np.full(256, 7, np.uint8)
for _chars, _k in ((b" \t", 0), (b"\n\r\x0b\x0c", 1), (bytes(range(97, 123)), 2), (bytes(range(65, 91)), 3),
                   (bytes(range(48, 58)), 4), (b".,;:?-", 5), (b"()[]{}\"'`", 6), (bytes(range(128, 256)), 8)):
    _CLASS[list(_chars)] = _k
N_TEXT = N_CLASSES ** 3 + 8
N_SOURCE, N_LANG, N_SIZE = 64, 16, 24
N_META = N_SOURCE + N_LANG + N_SIZE


def text_features(text: str) -> np.ndarray:
    """Character-class trigram shares (square root) and word statistics."""
    raw = text.encode("utf-8", "surrogatepass")
    out = np.zeros(N_TEXT, np.float32)
    codes = _CLASS[np.frombuffer(raw, np.uint8)].astype(np.int16)
    if len(codes) > 2:
        grams = codes[:-2] * (N_CLASSES * N_CLASSES) + codes[1:-1] * N_CLASSES + codes[2:]
        out[:N_CLASSES ** 3] = np.sqrt(np.bincount(grams, minlength=N_CLASSES ** 3) / len(grams))
    words = raw.split()
    if words:
        n, kinds = len(words), set(words)
        repeats = sum(a == b for a, b in zip(words, words[1:]))
        lines = raw.split(b"\n")
        out[N_CLASSES ** 3:] = (
            len(kinds) / n, min(1.0, len(kinds) / (n ** 0.7 + 1)), repeats / n, min(1.0, len(raw) / n / 20),
            min(1.0, len(lines) / n), len(set(lines)) / len(lines), min(1.0, np.log1p(n) / 12),
            sum(len(w) == 1 for w in words) / n)
    return out


def meta_features(source, lang, n_chars) -> np.ndarray:
    out = np.zeros(N_META, np.float32)
    slot = lambda x, n: zlib.crc32(("\0" if x is None else str(x)).encode("utf-8", "surrogatepass")) % n
    out[slot(source, N_SOURCE)] = 1
    out[N_SOURCE + slot(lang, N_LANG)] = 1
    size = 0 if n_chars is None else min(N_SIZE - 1, 1 + int(np.log2(max(0, n_chars) + 1)))
    out[N_SOURCE + N_LANG + size] = 1
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(float)
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep)
        move = np.linalg.solve(h, x.T @ (y - p) - keep * w)
        w += move
        if np.abs(move).max() < 1e-5:
            break
    return w


def _margin(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Model:
    views: list = field(default_factory=list)         # (weights, slope, offset) of the text and the metadata view
    prior: float = 0.5
    rounds: list = field(default_factory=list)        # pseudo-labels handed over in each round

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if not self.views:
            return np.full(len(text), self.prior)
        odds = -np.log(self.prior / (1 - self.prior))
        odds = odds + sum(a * _margin(w, x) + b for (w, a, b), x in zip(self.views, (text, meta)))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _calibrate(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn a view's margin into log odds."""
    m = _margin(w, x)
    scale = np.abs(m).max() or 1.0
    a, b = _logistic((m / scale)[:, None], y, 1e-3, 25)
    return a / scale, b


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray,
             rounds: int = ROUNDS) -> Model:
    """``y`` in {0, 1}, rows in a fixed order; every ``CALIBRATION_FOLD``-th row of a class calibrates."""
    good = float(y.mean()) if len(y) else 0.5
    if not len(y) or good in (0.0, 1.0):
        return Model([], good)
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[::CALIBRATION_FOLD]] = True
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    train, check = ~held, held if held.any() else np.ones(len(y), bool)
    views, pools = (text, meta), (pool_text, pool_meta)
    extra = [{}, {}]           # pool row -> label, for each view
    log, fitted = [], []
    for r in range(rounds + 1):
        fitted = []
        for x, pool, own in zip(views, pools, extra):
            rows = sorted(own)
            w = _logistic(np.vstack([x[train], pool[rows]]), np.concatenate([y[train], [own[k] for k in rows]]))
            fitted.append((w, *_calibrate(w, x[check], y[check])))
        if r == rounds or not len(pool_text):
            break
        given = []
        for v in (0, 1):
            w, a, b = fitted[v]
            p = 1 / (1 + np.exp(-np.clip(a * _margin(w, pools[v]) + b, -30, 30)))
            n = 0
            for label, sure in ((1, p), (0, 1 - p)):
                best = [k for k in np.argsort(-sure, kind="stable")[:PER_ROUND * (r + 1)] if sure[k] >= CONFIDENT]
                for k in best:
                    n += extra[1 - v].setdefault(int(k), label) == label
            given.append(n)
        log.append(tuple(given))
    return Model(fitted, good, log)


def _features(batches):
    for batch in small(batches):
        cols = [c.to_pylist() for c in batch.columns]
        text = [text_features(t or "") for t in cols[1]]
        meta = [meta_features(*x) for x in zip(*cols[2:5])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(5), batch.column(6), pa.array([x.tobytes() for x in text], pa.binary()),
             pa.array([x.tobytes() for x in meta], pa.binary())], ["doc_id", "quality", "_draw", "text", "meta"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                       F.col("n_chars").cast("long").alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, sample_labelled: int = SAMPLE_LABELLED, sample_pool: int = SAMPLE_POOL,
        rounds: int = ROUNDS) -> Model:
    """Co-train on a bounded sample of labelled and unlabelled documents.

    Documents are drawn by a hash of id and text.  A rate thins them out first; of what is left the ``sample_*`` rows of
    the smallest hashes are taken, by a distributed top-k over the features, so however many rows share an
    id or a text no more than that reach the driver.
    """
    known = (labels.select(labels["doc_id"].cast("long").alias("_id"), labels["quality"].cast("double").alias("quality"))
             .where("quality IS NOT NULL AND _id IS NOT NULL"))
    rows = _rows(docs).withColumn("_draw", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))
    share = F.pmod(F.col("_draw"), F.lit(1_000_000))
    rate = lambda want, n: int(1_000_000 * min(1.0, 1.5 * want / max(1, n)))
    shape = "doc_id long, quality double, _draw long, text binary, meta binary"

    def drawn(some, n):
        some = some.select("doc_id", "text", "source", "lang", "n_chars", "quality", "_draw")
        return (some.mapInArrow(_features, shape).orderBy(F.pmod("_draw", F.lit(1_000_000)), "_draw", "doc_id", "quality")
                .limit(n).toPandas())
    labelled = rows.where(share < rate(sample_labelled, known.count())).join(known, F.col("doc_id") == F.col("_id"))
    lab = drawn(labelled, sample_labelled)
    # the pool leaves out the documents that carry a label
    rest = rows.where(share < rate(sample_pool, docs.count())).join(known, F.col("doc_id") == F.col("_id"), "left_anti")
    pool = drawn(rest.withColumn("quality", F.lit(None).cast("double")), sample_pool)
    load = lambda col, n: (np.stack([np.frombuffer(b, np.float32) for b in col]) if len(col)
                           else np.zeros((0, n), np.float32))
    return co_train(load(lab["text"], N_TEXT), load(lab["meta"], N_META), (lab["quality"] > 0).to_numpy(float),
                    load(pool["text"], N_TEXT), load(pool["meta"], N_META), rounds)


def _score(sent):
    def run(batches):
        model = sent.value
        for batch in small(batches):
            cols = [c.to_pylist() for c in batch.columns]
            scores = model.score(np.stack([text_features(t or "") for t in cols[1]]),
                                 np.stack([meta_features(*x) for x in zip(*cols[2:5])]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(scores >= 0.5, pa.bool_())],
                ["doc_id", "score", "good"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (probability of good quality), good, of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)      # two weight vectors
    return _rows(docs).mapInArrow(_score(sent), "doc_id long, score double, good boolean")
