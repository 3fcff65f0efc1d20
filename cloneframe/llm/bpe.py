"""Byte-pair merging kernels shared by the tokenizer operators.

Two ways of applying the same merge list:

* :class:`PairIndexBPE` keeps, for all words of a block at once, an index from each
  pair's rank to every place where the pair stands, and applies the active ranks in
  ascending order.
* :class:`HeapCounter` walks one chunk with a heap over a linked list of symbols and
  only counts: initial symbols minus merges.

Both are helpers that run inside Spark tasks; neither holds more than one block of
distinct words.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np

NO_RANK = np.int64(1 << 40)
#: Distinct words whose encodings a Python worker remembers.
CACHE_WORDS = 300_000
#: Symbols that one block of words may hold.
BLOCK_SYMBOLS = 3_000_000


@lru_cache(1)
def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes
    stand for themselves, the others are numbered on from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def char_class(prefix: str, top: int = 0x530) -> str:
    """Ranges, for a ``re`` class, of code points below ``top`` whose category starts with prefix."""
    out, at = [], 0
    while at < top:
        if unicodedata.category(chr(at)).startswith(prefix):
            first = at
            while at < top and unicodedata.category(chr(at)).startswith(prefix):
                at += 1
            out.append(f"\\u{first:04x}-\\u{at - 1:04x}")
        at += 1
    return "".join(out)


LETTERS, NUMBERS, SPACES = char_class("L"), char_class("N"), r"\t-\r \x85\xa0"
#: Below these code points the classes above are complete; other texts go to the tokenizer's own splitter.
PLAIN = re.compile(r"[^\x00-ԯ‐-‧€]")


def _sorted_set(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]]


class PairIndexBPE:
    """Merges of one byte-level vocabulary file of the ``tokenizers`` library.

    ``end_suffix`` vocabularies mark the last symbol of a word.  ``words(list of bytes)``
    returns (ids, offsets): word i's ids are ``ids[offsets[i]:offsets[i + 1]]``.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_chars()
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.path, self.suffix = path, suffix
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.twin = np.array([a == b for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        back = {c: b for b, c in enumerate(chars)}
        self.token_bytes = [b""] * max(self.size, *(i + 1 for i in self.special.values()), 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NO_RANK)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        n, ends = len(raw), np.cumsum(sizes)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        sym = self.first[raw]
        tails = ends[sizes > 0] - 1
        sym[tails] = self.last[raw[tails]]
        # The linked list of symbols; n is "none" on either side.
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[tails], prv[tails[:-1] + 1], prv[0] = n, n, n
        rank = np.full(n + 1, NO_RANK)
        inner = np.flatnonzero(nxt[:n] < n)
        rank[inner] = self.rank_of(sym[inner], sym[inner + 1])
        # The index: rank -> places; the heap holds the active ranks.
        places: dict[int, list[np.ndarray]] = {}

        def note(where: np.ndarray) -> None:
            where = where[rank[where] < NO_RANK]
            if not len(where):
                return
            r = rank[where]
            if len(where) > 1:
                order = np.argsort(r, kind="stable")
                where, r = where[order], r[order]
                cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
                parts, heads = np.split(where, cuts), r[np.r_[0, cuts]].tolist()
            else:
                parts, heads = [where], r.tolist()
            for head, part in zip(heads, parts):
                if head not in places:
                    places[head] = [part]
                    heapq.heappush(heap, head)
                else:
                    places[head].append(part)

        heap: list[int] = []
        note(inner)
        alive = np.ones(n, bool)
        while heap:
            r = heapq.heappop(heap)
            got = places.pop(r)
            at = got[0] if len(got) == 1 else np.concatenate(got)
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(got) > 1:
                at = _sorted_set(at)
            if self.twin[r] and len(at) > 1:
                # In a run of equal symbols every other pair merges, from the left.
                new_run = np.r_[True, nxt[at[:-1]] != at[1:]]
                start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = self.made[r]
            nxt[at] = after
            prv[after] = at
            prv[n] = n
            alive[gone] = False
            rank[gone] = NO_RANK
            rank[at] = NO_RANK
            right = at[after < n]
            before = prv[at]
            before = before[before < n]
            touched = np.concatenate([right, before])
            if len(touched):
                rank[touched] = self.rank_of(sym[touched], sym[nxt[touched]])
                note(_sorted_set(touched))
        offsets = np.r_[0, np.cumsum(alive)[ends - 1]] if sizes.all() else np.r_[0, np.r_[0, np.cumsum(alive)][ends]]
        return sym[alive], offsets

    def blocks(self, words: list[bytes]):
        """(first word, ids, offsets) of blocks of a bounded number of symbols."""
        at = 0
        while at < len(words):
            end, room = at, BLOCK_SYMBOLS
            while end < len(words) and (end == at or len(words[end]) <= room):
                room -= len(words[end])
                end += 1
            yield at, *self.words(words[at:end])
            at = end


def splitter(pattern: re.Pattern, slow):
    """text -> its words: ``pattern`` where its classes are complete, else ``slow``."""
    return lambda text: slow(text) if not text.isascii() and PLAIN.search(text) else pattern.findall(text)


class HeapCounter:
    """Counts the pieces of a sentencepiece BPE model without making their ids.

    A chunk starts at a space mark that follows something else: no piece holds a
    mark after another character (checked on loading), so no merge crosses it. A
    letter and a following sign are parted too where no piece holds the two.
    """

    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model, self.rank, self.width = model, {}, {}
        followers: set[str] = set()
        joined: set[str] = set()
        crossing = False
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i)
            self.rank[piece] = (-model.get_score(i), i)
            joined.update(piece if len(piece) > 1 else "")
            for a, b in zip(piece, piece[1:]):
                crossing |= b == self.MARK and a != self.MARK
                if a.isalnum():
                    followers.add(b)
        # Ranks as small numbers; pieces of one score share a rank, so that the leftmost merges first.
        scores = {s: r for r, s in enumerate(sorted({s for s, _ in self.rank.values()}))}
        self.rank = {p: scores[s] for p, (s, _) in self.rank.items()}
        signs = "!\"#$%&()*+,./:;<=>?@[]^_{|}~\n\t-'"
        alone = re.escape("".join(c for c in signs if c not in followers))
        lone = re.escape("".join(c for c in signs if c not in joined)) or "\x00"
        self.chunk = None if crossing else re.compile(
            rf"▁*+[{LETTERS}]++(?=[▁{alone}]|\Z)|[{lone}]|▁*+[^▁{lone}]++|▁++"
        )
        self.cache: dict[str, int] = {}

    def count_chunk(self, chunk: str) -> int:
        """Initial symbols minus merges; a symbol outside the vocabulary counts its UTF-8 bytes."""
        get, sym = self.rank.get, list(chunk)
        n = total = len(sym)
        if not chunk.isascii() or not chunk.isprintable():
            total += sum(len(c.encode()) - 1 for c in sym if c not in self.rank)
        # of[i]: the rank of the pair that starts at i, None if there is none.
        of = list(map(get, map(add, sym, sym[1:])))
        of.append(None)
        heap = [r * n + i for i, r in enumerate(of) if r is not None]
        if not heap:
            return total
        heapify(heap)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n))
        while heap:
            r, i = divmod(heappop(heap), n)
            if of[i] != r:
                continue  # this pair has changed since
            j = nxt[i]
            sym[i] = made = sym[i] + sym[j]
            total -= 1
            nxt[i] = k = nxt[j]
            prv[k] = i
            of[j] = None
            if k < n:
                of[i] = r = get(made + sym[k])
                if r is not None:
                    heappush(heap, r * n + i)
            else:
                of[i] = None
            p = prv[i]
            if p >= 0:
                of[p] = r = get(sym[p] + made)
                if r is not None:
                    heappush(heap, r * n + p)
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = self.MARK + text.replace(" ", self.MARK)
        chunks = self.chunk.findall(marked) if self.chunk else [marked]
        cache, total = self.cache, 0
        for c in chunks:
            k = cache.get(c)
            if k is None:
                k = self.count_chunk(c)
                if len(c) <= 64:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[c] = k
            total += k
        return total
