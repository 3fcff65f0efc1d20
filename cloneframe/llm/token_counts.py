"""Token counts by heap-and-linked-list byte-pair merging (free style: Arrow inside tasks).

Each chunk of a whole text (see :class:`~.bpe.HeapCounter`) is merged by repeatedly
popping the lowest-rank adjacent pair; its count is its initial symbols minus its
merges, and no ids are made. No shuffle; memory per task is one slice of texts and a
bounded cache of chunk counts.

Defined results: null and empty texts have 0 bytes and 0 tokens. Null ids are carried through,
repeated rows repeat, and only the id and text columns are read. Very long texts are counted whole, a chunk's
heap at a time. Pairs of equal rank are merged from the left; no other ties arise. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from .bpe import HeapCounter
from .bpe_codec import _map

@lru_cache(2)
def counter(path: str) -> HeapCounter:
    """One per Python worker."""
    return HeapCounter(path)


def count_tokens(df: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text."""

    def work(texts):
        count = counter(path).count
        tokens = [count(t) for t in texts]
        return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    return _map(df, "n_bytes long, n_tokens long, over_limit boolean", id_col, text_col, work)
