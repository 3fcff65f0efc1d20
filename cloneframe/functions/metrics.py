"""Pairwise sequence metrics, as native expressions and as NumPy kernels over blocks.

The residue costs follow the published definition min(4, 4 - BLOSUM62): 0 for equal letters, 4
unless the matrix scores the pair above zero. One gap per pair is placed where the pair costs least, or at a fixed
place. A gap sign equals itself and costs 4 against any letter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unordered residue pairs with a BLOSUM62 score of 3, 2 and 1, hence costs 1, 2 and 3.
COSTS = {1: "IV FY", 2: "RK DE EQ HY IL LM WY", 3: "AS RQ ND NH NS QK EK IM LV MV FW ST"}
FAR = 4


def costs(table: dict[int, str] = COSTS) -> np.ndarray:
    """(256, 256) costs by byte."""
    out = np.full((256, 256), FAR, np.int32)
    np.fill_diagonal(out, 0)
    for cost, pairs in table.items():
        for a, b in pairs.split():
            out[ord(a), ord(b)] = out[ord(b), ord(a)] = cost
    return out


def residue_cost(a: Column, b: Column) -> Column:
    """The cost of two letters; the pairs stand in one string per cost."""
    both = F.concat(a, b)
    listed = {c: " ".join(f"{x} {x[::-1]}" for x in p.split()) for c, p in COSTS.items()}
    out = F.when(a == b, 0)
    for cost, pairs in listed.items():
        out = out.when(F.instr(F.lit(pairs), both) > 0, cost)
    return out.otherwise(FAR)


_COSTS = costs()


def _by_length(texts: list[str], number: np.ndarray) -> list[tuple[list[int], np.ndarray]]:
    """(places, letters' numbers as a matrix) of the strings of each length."""
    places: dict[int, list[int]] = {}
    for i, x in enumerate(texts):
        places.setdefault(len(x), []).append(i)
    raw = lambda rows: np.frombuffer("".join(texts[i] for i in rows).encode("latin-1", "replace"), np.uint8)
    return [(rows, number[raw(rows)].reshape(len(rows), n)) for n, rows in places.items()]


def _per_lengths(left: list[str], right: list[str], of) -> np.ndarray:
    """``of(a, b)`` over all pairs of two lengths at once, a as (rows, 1, n) and b as (1, cols, m) code points."""
    out = np.empty((len(left), len(right)), np.int32)
    code = lambda texts, rows: np.array([[ord(c) for c in texts[i]] for i in rows], np.int64).reshape(len(rows), -1)
    lengths = lambda texts: {n: [i for i, x in enumerate(texts) if len(x) == n] for n in {len(x) for x in texts}}
    for rows in lengths(left).values():
        a = code(left, rows)[:, None, :]
        for cols in lengths(right).values():
            out[np.ix_(rows, cols)] = of(a, code(right, cols)[None, :, :])
    return out


@dataclass(frozen=True)
class Tcr:
    """Trimmed substitution distance with one gap. Strings too short for their trims cost their gaps alone."""

    ntrim: int = 3
    ctrim: int = 2
    fixed_gap: bool = False
    gap_penalty: int = 4
    dist_weight: int = 1

    def column(self, s: Column, t: Column) -> Column:
        n, m = F.length(s), F.length(t)
        low, gap = F.least(n, m), F.abs(n - m)

        def head(end: Column) -> Column:
            return F.aggregate(
                F.when(end > self.ntrim, F.sequence(F.lit(self.ntrim + 1), end)).otherwise(F.array().cast("array<int>")),
                F.lit(0), lambda a, i: a + residue_cost(F.substr(s, i, F.lit(1)), F.substr(t, i, F.lit(1))),
            )

        def tail(size: Column) -> Column:
            return F.aggregate(
                F.when(size > self.ctrim, F.sequence(F.lit(self.ctrim), size - 1)).otherwise(F.array().cast("array<int>")),
                F.lit(0), lambda a, j: a + residue_cost(F.substr(s, n - j, F.lit(1)), F.substr(t, m - j, F.lit(1))),
            )

        first, last = self._gap_places(low, F.least, F.greatest, lambda x: F.floor(x / 2).cast("int"), F.lit)
        best = F.array_min(F.transform(F.sequence(first, last), lambda g: head(g) + tail(low - g)))
        return F.when(n == m, head(n - self.ctrim)).otherwise(best) * self.dist_weight + gap * self.gap_penalty

    def _gap_places(self, low, least, greatest, half, lit):
        if self.fixed_gap:
            g = least(lit(6), 3 + half(low - 5))
            return greatest(lit(0), g), greatest(lit(0), g)
        # 5 to low - 5, widened by one on each side while there is none
        wide = greatest(lit(0), half(10 - low + 1))
        return greatest(lit(0), 5 - wide), least(low, low - 5 + wide)

    def block(self, left: list[str], right: list[str]) -> np.ndarray:
        """All pairs by matrix products: a string's letters as ones and zeros by place, times what each letter costs against the other's at that place."""
        out = np.empty((len(left), len(right)), np.int32)
        used = np.frombuffer("".join([*left, *right]).encode("latin-1", "replace"), np.uint8)
        letters = np.unique(used)
        number, table = np.zeros(256, np.intp), _COSTS[np.ix_(letters, letters)].astype(np.float32)
        number[letters] = np.arange(len(letters))
        ones = np.eye(len(letters), dtype=np.float32)
        for rows, a in _by_length(left, number):
            n = a.shape[1]
            for cols, b in _by_length(right, number):
                m = b.shape[1]
                low, gap = min(n, m), abs(n - m)
                costs_of = lambda x, y, i, j: (  # the summed costs of places i to j - 1
                    ones[x[:, i:j]].reshape(len(x), -1) @ table[:, y[:, i:j]].transpose(2, 0, 1).reshape(-1, len(y)) if j > i else np.zeros((len(x), len(y)), np.float32)
                )
                if n == m:
                    d = costs_of(a, b, self.ntrim, n - self.ctrim)
                else:
                    ends = a[:, n - low :][:, ::-1], b[:, m - low :][:, ::-1]
                    first, last = self._gap_places(low, min, max, lambda x: x // 2, int)
                    here = d = costs_of(a, b, self.ntrim, first) + costs_of(*ends, self.ctrim, low - first)
                    for g in range(first, last):  # the gap moves on by one: a letter more from the start, one less from the end
                        here = here + costs_of(a, b, max(g, self.ntrim), g + 1) - costs_of(*ends, max(self.ctrim, low - g - 1), low - g)
                        d = np.minimum(d, here)
                out[np.ix_(rows, cols)] = np.rint(d).astype(np.int32) * self.dist_weight + gap * self.gap_penalty
        return out

    def length_cost(self) -> int:
        """The least that one letter of length difference costs."""
        return self.gap_penalty


@dataclass(frozen=True)
class Edit:
    """Levenshtein distance, natively."""

    def column(self, s: Column, t: Column) -> Column:
        return F.levenshtein(s, t)

    def block(self, left, right):
        return _per_lengths(left, right, edit_distances)

    def length_cost(self) -> int:
        return 1


@dataclass(frozen=True)
class Hamming:
    """Differing places of strings of one length; null for others."""

    def column(self, s: Column, t: Column) -> Column:
        return F.when(
            F.length(s) == F.length(t),
            F.size(F.filter(F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>")), lambda i: F.substr(s, i, F.lit(1)) != F.substr(t, i, F.lit(1)))),
        )

    def length_cost(self) -> int:
        return 0


@dataclass(frozen=True)
class Aligned:
    """A Needleman-Wunsch alignment, then its differing places (``mismatches``) or a score dissimilarity."""

    mismatches: bool = True

    def block(self, left, right):
        if self.mismatches:
            return _per_lengths(left, right, lambda a, b: alignments(a, b)[1])
        own = lambda xs: np.array([align(x, x)[0] for x in xs], np.int64)
        return ((own(left)[:, None] + own(right)[None, :]) // 2 - _per_lengths(left, right, lambda a, b: alignments(a, b)[0])).astype(np.int32)

    def length_cost(self) -> int:
        return 1 if self.mismatches else 0


@dataclass(frozen=True)
class Custom:
    """Any ``f(s, t) -> number``; slow, one call for each pair of distinct strings."""

    f: Callable[[str, str], float]

    def block(self, left, right):
        return np.array([[self.f(a, b) for b in right] for a in left]).reshape(len(left), len(right))

    def length_cost(self) -> int:
        return 0


def edit_distance(a: str, b: str) -> int:
    return int(Edit().block([a], [b])[0, 0])


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levenshtein distances of all pairs, one cell of the table at a time for all of them."""
    shape = np.broadcast_shapes(a.shape[:2], b.shape[:2])
    row = [np.full(shape, j, np.int32) for j in range(b.shape[2] + 1)]
    for i in range(a.shape[2]):
        before, row[0] = row[0], np.full(shape, i + 1, np.int32)
        for j in range(b.shape[2]):
            best = np.minimum(np.minimum(row[j], row[j + 1]) + 1, before + (a[:, :, i] != b[:, :, j]))
            before, row[j + 1] = row[j + 1], best
    return row[-1]


def _score(x: str, y: str) -> int:
    """The similarity that stands behind the costs: 4 minus the cost."""
    return FAR - int(_COSTS[ord(x) & 255, ord(y) & 255]) if x != y else 5


def align(a: str, b: str, gap: int = -4) -> tuple[int, list[tuple[str, str]]]:
    """Best global score and one best alignment, pairs of letters with '-' for gaps; substitutions go before gaps on ties."""
    n, m = len(a), len(b)
    best = np.zeros((n + 1, m + 1), int)
    best[:, 0], best[0, :] = np.arange(n + 1) * gap, np.arange(m + 1) * gap
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i, j] = max(best[i - 1, j - 1] + _score(a[i - 1], b[j - 1]), best[i - 1, j] + gap, best[i, j - 1] + gap)
    out, i, j = [], n, m
    while i or j:
        if i and j and best[i, j] == best[i - 1, j - 1] + _score(a[i - 1], b[j - 1]):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and best[i, j] == best[i - 1, j] + gap:
            i -= 1
            out.append((a[i], "-"))
        else:
            j -= 1
            out.append(("-", b[j]))
    return int(best[n, m]), out[::-1]


_SCORES = np.where(np.eye(256, dtype=bool), 5, FAR - _COSTS)


def alignments(a: np.ndarray, b: np.ndarray, gap: int = -4) -> tuple[np.ndarray, np.ndarray]:
    """(best global score, differing places of the alignment that ``align`` picks) of all pairs, by the same table for all of them."""
    shape = np.broadcast_shapes(a.shape[:2], b.shape[:2])
    full = lambda v: np.full(shape, v, np.int32)
    row = [(full(j * gap), full(j)) for j in range(b.shape[2] + 1)]
    for i in range(a.shape[2]):
        before, row[0] = row[0], (full((i + 1) * gap), full(i + 1))
        for j in range(b.shape[2]):
            x, y = a[:, :, i], b[:, :, j]
            diagonal, up, back = before[0] + _SCORES[x & 255, y & 255], row[j + 1][0] + gap, row[j][0] + gap
            best = np.maximum(np.maximum(diagonal, up), back)
            places = np.where(best == diagonal, before[1] + (x != y), np.where(best == up, row[j + 1][1], row[j][1]) + 1)
            before, row[j + 1] = row[j + 1], (best.astype(np.int32), places.astype(np.int32))
    return row[-1]


def nw_hamming(a: str, b: str) -> int:
    return sum(x != y for x, y in align(a, b)[1])


def nw_dissimilarity(a: str, b: str) -> int:
    """Mean of the two scores with oneself minus the score of both, rounded down."""
    return (align(a, a)[0] + align(b, b)[0]) // 2 - align(a, b)[0]


@dataclass(frozen=True)
class MetricSpec:
    """Weighted sum of metrics: (column, metric, weight). The first column's lengths block the join."""

    parts: tuple[tuple[str, object, float], ...] = field(default_factory=tuple)

    def __post_init__(self):
        if not self.parts:
            raise ValueError("a metric needs at least one column")

    @property
    def columns(self) -> list[str]:
        return [c for c, *_ in self.parts]

    def column(self, left: Callable[[str], Column], right: Callable[[str], Column]) -> Column:
        total = None
        for name, metric, weight in self.parts:
            if not hasattr(metric, "column"):
                raise ValueError(f"{type(metric).__name__} has no native expression")
            d = metric.column(left(name), right(name)) * weight
            total = d if total is None else total + d
        return total

    def length_cost(self) -> float:
        """What one letter of difference in the first column's length costs at least."""
        _, metric, weight = self.parts[0]
        return metric.length_cost() * weight


def default_spec(chain_letter: str = "b", cdr3_only: bool = False) -> MetricSpec:
    """The default distance of one chain: CDR3 three times, the germline loops once each."""
    x, germline = chain_letter, Tcr(0, 0, True)
    loops = () if cdr3_only else tuple((f"{c}_{x}_aa", germline, 1) for c in ("pmhc", "cdr2", "cdr1"))
    return MetricSpec(((f"cdr3_{x}_aa", Tcr(), 3), *loops))
