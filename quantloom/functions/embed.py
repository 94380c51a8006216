"""Texts to vectors (K1, D21): a user's embedding model behind Arrow batches.

A model is a function ``list of texts -> matrix`` (one row per text).  The user hands over a factory
without arguments; every task calls it once, so a model is loaded where it runs and is never
serialised with the plan.  Texts longer than ``chunk_tokens`` words are cut into
chunks, all chunks of a batch go to the model in one call, and a text's vector is the mean of its chunks'.

``HashingEmbedder`` is the default model; it gives the vectors of ``vectors.hash_embed_long``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quantloom.functions.vectors import DEFAULT_CHUNK_TOKENS, DEFAULT_DIM

Model = Callable[[list[str]], np.ndarray]

ROWS = 256                  # texts embedded by one call
BLOCK_CHARS = 1 << 22       # characters whose tokens the default model holds at once, one text at least
_SPACES = "\t\n\x0b\f\r"      # with the blank: what separates words


def _slots(tokens: np.ndarray, dim: int) -> np.ndarray:
    """2 * slot of every token (UTF-8), plus 1 when its sign is minus; 2 * dim for the empty one."""
    md5 = np.frombuffer(b"".join([hashlib.md5(t).digest() for t in tokens]), np.uint8).reshape(-1, 16)
    slot = np.ascontiguousarray(md5[:, :4]).view(">u4").ravel().astype(np.int64) % dim
    return np.where(tokens == b"", 2 * dim, slot * 2 + (md5[:, 4] >> 4) % 2)


class HashingEmbedder:
    """Feature hashing: a token adds +1 or -1 to one of ``dim`` slots, both chosen by its md5; unit length."""

    def __init__(self, dim: int = DEFAULT_DIM):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        start = size = 0
        for k, text in enumerate(texts, 1):
            size += len(text)
            if size >= BLOCK_CHARS or k == len(texts):
                out[start:k] = self._sums(texts[start:k])
                start, size = k, 0
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    def _sums(self, texts: list[str]) -> np.ndarray:
        """The signs summed per text and slot; equal tokens are hashed once."""
        plain = pa.array([blanks(t.lower()).encode("utf-8", "surrogatepass") for t in texts], pa.large_binary())
        split = pc.split_pattern(plain, b" ")
        found = pc.dictionary_encode(split.values)
        codes = _slots(found.dictionary.to_numpy(zero_copy_only=False), self.dim)
        width = 2 * (self.dim + 1)      # the empty token has a slot of its own, left out
        at = np.repeat(np.arange(len(texts)) * width, np.diff(split.offsets)) + codes[found.indices]
        counts = np.bincount(at, minlength=len(texts) * width).reshape(len(texts), width)[:, :-2]
        return counts[:, ::2] - counts[:, 1::2]


def blanks(text: str) -> str:
    for c in _SPACES:
        text = text.replace(c, " ")
    return text


def words(text: str) -> list[str]:
    return [w for w in blanks(text).split(" ") if w]


def chunks(text: str, chunk_tokens: int) -> list[str]:
    """The text in pieces of ``chunk_tokens`` words; a text that fits stays as it is, spaces included."""
    found = words(text)
    if len(found) <= chunk_tokens:
        return [text]
    return [" ".join(found[k:k + chunk_tokens]) for k in range(0, len(found), chunk_tokens)]


def mean_of_chunks(model: Model, texts: list[str], dim: int, chunk_tokens: int) -> np.ndarray:
    parts = [chunks(t, chunk_tokens) for t in texts]
    sizes = np.array([len(p) for p in parts])
    found = np.asarray(model([c for p in parts for c in p]), float)
    if found.shape != (int(sizes.sum()), dim):
        raise ValueError(f"the embedding model gave shape {found.shape}, expected {(int(sizes.sum()), dim)}")
    starts = np.cumsum(sizes) - sizes
    return np.add.reduceat(found, starts, axis=0) / sizes[:, None]


def _embed(factory: Callable[[], Model], at: int, dim: int, chunk_tokens: int):
    def run(batches):
        model = None
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                model = factory() if model is None else model
                texts = [t or "" for t in batch.column(at).to_pylist()]
                values = mean_of_chunks(model, texts, dim, chunk_tokens).ravel()
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), values)
                yield pa.RecordBatch.from_arrays([*batch.columns, vectors], [*batch.schema.names, "embedding"])
    return run


def embed_texts(df: DataFrame, text_col: str = "text", model: Callable[[], Model] | None = None,
                dim: int = DEFAULT_DIM, chunk_tokens: int = DEFAULT_CHUNK_TOKENS) -> DataFrame:
    """``df`` with ``embedding`` (array<double> of ``dim`` values) of every whole text; null counts as empty."""
    factory = (lambda: HashingEmbedder(dim)) if model is None else model
    schema = StructType([*df.schema.fields, StructField("embedding", ArrayType(DoubleType()))])
    return df.mapInArrow(_embed(factory, df.columns.index(text_col), dim, chunk_tokens), schema)


def of_length(vector: Column, dim: int) -> Column:
    """The vector; one of another length stops the job."""
    return F.when(F.size(vector) == dim, vector).otherwise(
        F.raise_error(F.concat(F.lit(f"embedding of {dim} values expected, got "), F.size(vector).cast("string"))))
