"""Byte-level BPE encoding and decoding by a pair occurrence index (free style: Arrow inside tasks).

``encode`` splits each whole text into words as the tokenizer file says, gathers the
block's distinct words, and merges them together with :class:`~.bpe.PairIndexBPE`: each
pair's rank maps to every place of the pair in the block, active ranks are applied in
ascending order, and only the lists of touched neighbours are updated. ``decode`` joins
the bytes of the ids' tokens.

No shuffle: a narrow map over the input's partitions. Memory per task: one slice of
texts (``SLICE_BYTES``), one block of distinct words and a cache of ``CACHE_WORDS`` words.

Defined results: a null text counts as empty and gives no ids; empty texts decode to
"". Null ids are carried through. Repeated rows give repeated rows. A very long text is a slice by itself; long words go
through blocks of their own. Equal ranks at one place are taken from the left, as the library does; no other ties arise. An empty table gives an empty result. Only the id and text columns
are read, so further columns may have any names. Strings of special tokens inside a text become their ids, as
the library does by default.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE_WORDS, LETTERS, NUMBERS, SPACES, PairIndexBPE, splitter

#: Characters of text that a task works on at once (one longer text: that text).
SLICE_CHARS = 8_000_000

_WORDS = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)


class Codec:
    """Encoder and decoder of one vocabulary, with a bounded memory of encoded words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.bpe = PairIndexBPE(path)
        own = Tokenizer.from_file(path)
        pre = own.pre_tokenizer
        self.split = splitter(_WORDS, lambda t: [t[a:b] for _, (a, b) in pre.pre_tokenize_str(t)])
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """(string, is it a special token) in order."""
        bpe = self.bpe
        if not bpe.split_special or not any(s in text for s in bpe.special):
            return [(text, False)]
        return [(p, p in bpe.special) for p in bpe.split_special.split(text) if p]

    def learn(self, words: set[str]) -> None:
        new = sorted(words)
        for at, ids, offsets in self.bpe.blocks([w.encode() for w in new]):
            ids = ids.astype("<u4")
            cuts = offsets.tolist()
            for k in range(len(cuts) - 1):
                self.known[new[at + k]] = ids[cuts[k] : cuts[k + 1]].tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        known, split = self.known, self.split
        if len(known) > CACHE_WORDS:
            known.clear()
        split_texts, missing = [], set()
        for text in texts:
            words = []
            for part, special in self.pieces(text):
                if special:
                    words.append(part)
                    known.setdefault(part, np.array([self.bpe.special[part]], "<u4").tobytes())
                else:
                    words.extend(split(part))
            missing.update(w for w in words if w not in known)
            split_texts.append(words)
        self.learn(missing)
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4") for words in split_texts]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bpe.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    """One per Python worker."""
    return Codec(path)


@lru_cache(1)
def _decimal(size: int) -> list[bytes]:
    return [b"%d" % i for i in range(size)]


def slices(texts: list[str], room: int = SLICE_CHARS):
    """Runs of texts of at most ``room`` characters, one text at least."""
    at = 0
    while at < len(texts):
        end, left = at, room
        while end < len(texts) and (end == at or len(texts[end]) <= left):
            left -= len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def text_slices(column: pa.Array, room: int, rows: int = 1000):
    """(place of the first, texts) of ``slices`` of a batch's texts, null ones empty; only ``rows`` of them are Python strings at a time."""
    for at in range(0, len(column), rows):
        for part in slices(column.slice(at, rows).fill_null("").to_pylist(), room):
            yield at, part
            at += len(part)


def _map(df: DataFrame, schema: str, id_col: str, text_col: str, work) -> DataFrame:
    """``work(texts) -> dict of columns`` over slices; the id is carried through."""

    def run(batches):
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1).to_pylist(), 0
            for part in slices([t or "" for t in texts]):
                cols = work(part)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), *(pa.array(v) if not isinstance(v, pa.Array) else v for v in cols.values())],
                    names=[id_col, *cols],
                )
                at += len(part)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text."""

    def work(texts):
        rows = codec(path).encode(texts)
        offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
        flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
        return {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}

    return _map(df, "ids array<int>", id_col, text_col, work)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every list of ids; null lists and ids outside the vocabulary give no text for their part."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                ok = [i for i in ids or () if i is not None and 0 <= i < len(c.bpe.token_bytes)]
                texts.append(c.decode(np.array(ok, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text in one task: (id, n_tokens, ids_sha256, decoded_sha256, lossless)."""

    def work(texts):
        c = codec(path)
        names = _decimal(len(c.bpe.token_bytes))
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "lossless": []}
        for text, ids in zip(texts, c.encode(texts)):
            back = c.decode(ids)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(b",".join(map(names.__getitem__, ids.tolist()))).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
            out["lossless"].append(back == text)
        return out

    return _map(df, "n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean", id_col, text_col, work)
