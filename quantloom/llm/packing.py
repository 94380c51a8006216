"""Packing by concatenate and cut.

All documents form one long stream of token ids, each document followed by a
separator id; the stream is cut into windows of ``window`` ids.  Two passes:

1. every partition tokenises its rows once and writes ids with their start
   inside the partition to a table in the shared folder (a rerun task reads
   these files, never a half-finished neighbour);
2. the partition totals (one number per partition, the only thing that goes
   through the driver) become prefix sums, each document's place in the global
   stream follows, and each document is cut at the window borders.

No rows are shuffled and no group is collected; a document of any length is
cut where the borders fall.  Only the last sequence can be short.

Defined cases: a null or empty text is the separator alone; the order of the
stream is the order of the input partitions and of the rows in them; equal
doc_ids are separate documents; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.batches import give_back, small
from quantloom.session import cut_lineage

WINDOW = 2048
SEPARATOR = 1


# fixed value: the pieces that byte-level BPE files with ``use_regex`` cut a text into
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_ranks(spec: dict):
    """The tokenizer file's vocabulary as a ``tiktoken`` encoding, or None when it is not plain byte-level BPE."""
    import tiktoken
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex")
             and not pre.get("add_prefix_space") and spec.get("normalizer") is None
             and not any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges",
                                                "continuing_subword_prefix", "end_of_word_suffix")))
    if not plain:
        return None
    # byte-level files write a byte as itself where it is visible, the others as characters from 256 on, in order
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letter = {chr(b): b for b in visible}
    letter |= {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - visible))}
    vocab = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in merges]
    if len(vocab) != 256 + len(made) or -1 in made or made != sorted(made) or min(made) < 256:
        return None      # merges are not in the order of the ids they make
    return tiktoken.Encoding("ranks", pat_str=PIECES, special_tokens={},
                             mergeable_ranks={bytes(letter[c] for c in t): k for t, k in vocab.items()})


class Encoder:
    """Packed token ids of whole texts.

    Where the tokenizer's file is plain byte-level BPE, its vocabulary serves as
    merge ranks for ``tiktoken``, which gives the same ids several times faster. Other
    files, and texts that hold a special token's string, go through ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self._tok = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or ()]
        self.ranks = byte_ranks(spec)
        largest = self.ranks.max_token_value if self.ranks else self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2") if largest + len(self.special) < 65536 else np.dtype("<u4")

    @property
    def tok(self):
        if self._tok is None:
            from tokenizers import Tokenizer
            self._tok = Tokenizer.from_file(self.path)
        return self._tok

    def encode(self, text: str) -> bytes:
        if self.ranks and not any(s in text for s in self.special):
            ids = self.ranks.encode_ordinary(text)
        else:
            ids = self.tok.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()


def encoder(path: str) -> Encoder:
    """A fresh encoder: it goes with its task, so a worker that serves other stages later does not keep it."""
    return Encoder(path)


def _tokenise(path: str, separator: int):
    def run(batches):
        give_back()
        enc, part, at = encoder(path), TaskContext.get().partitionId(), 0
        end, ids = np.array([separator], enc.dtype).tobytes(), []
        for batch in small(batches):
            ids = [enc.encode(t.as_py() or "") + end for t in batch.column(1)]
            sizes = [len(x) // enc.dtype.itemsize for x in ids]
            starts = list(accumulate(sizes, initial=at))
            at = starts.pop()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), batch.column(0), pa.array(starts, pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array([enc.dtype.itemsize] * len(ids), pa.int32()),
                 pa.array(ids, pa.binary())], ["part", "doc_id", "at", "n", "width", "ids"])
        del enc, ids
        give_back()
    return run


def _cut(first: dict, window: int):
    def run(batches):
        give_back()
        for batch in batches:
            out = {k: [] for k in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}
            part, doc, at, n, width, ids = (batch.column(k) for k in range(6))
            for p, d, a, size, w, x in zip(*(c.to_pylist() for c in (part, doc, at, n, width)), ids):
                words = np.frombuffer(x.as_buffer(), f"<u{w}").astype("<u4")
                g, done = first[p] + a, 0
                while done < size:
                    seq, off = divmod(g + done, window)
                    length = min(window - off, size - done)
                    for k, v in (("doc_id", d), ("start", done), ("length", length), ("doc_tokens", size),
                                 ("sequence_id", seq), ("offset", off),
                                 ("ids", words[done:done + length].tobytes())):
                        out[k].append(v)
                    done += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], list(out))
    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, separator: int = SEPARATOR,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian u32)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    tokens = cut_lineage(rows.mapInArrow(
        _tokenise(tokenizer_path, separator),
        "part int, doc_id long, at long, n long, width int, ids binary"), "pack_ids")
    totals = {r["part"]: r["total"] for r in
              tokens.groupBy("part").agg(F.sum("n").alias("total")).collect()}
    parts = sorted(totals)
    first = dict(zip(parts, accumulate((totals[p] for p in parts), initial=0)))
    return tokens.mapInArrow(
        _cut(first, window),
        "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def assemble(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens, ids array<long> padded to ``window``; at most ``window`` pieces meet in a row."""
    hexed = F.hex("ids")
    spell = F.transform(
        F.sequence(F.lit(0), F.col("length") - 1),
        lambda i: F.conv(F.concat(*[F.substring(hexed, (i * 8 + k).cast("int") + 1, F.lit(2)) for k in (6, 4, 2, 0)]),
                         16, 10).cast("long"))
    rows = pieces.select("sequence_id", F.struct("offset", spell.alias("ids")).alias("piece"), "length")
    seqs = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list("piece")).alias("pieces"),
                                           F.sum("length").alias("n_tokens"))
    ids = F.flatten(F.transform("pieces", lambda p: p["ids"]))
    pad = F.array_repeat(F.lit(pad_id).cast("long"), (F.lit(window) - F.col("n_tokens")).cast("int"))
    return seqs.select("sequence_id", "n_tokens", F.concat(ids, pad).alias("ids"))
