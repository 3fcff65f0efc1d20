"""Background repertoires: gene usage, stratified samples and a recombination generator."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import _CODE as _CODONS
from ..sources.store import written
from .clones import gene_usage, stratified_usage, usage_weights, with_gene_frequencies
from .ranks import ranked


def stratified_sample(df: DataFrame, group: list[str], n: int, seed: int = 1, keys: list[str] | None = None) -> DataFrame:
    """At most n rows of each group, by a seeded hash of the keys, so a rerun gives the same rows. Sampling is the operator."""
    order = Window.partitionBy(*group).orderBy(F.xxhash64(*(keys or df.columns), F.lit(seed)), *(keys or df.columns))
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def sample(df: DataFrame, n: int, seed: int = 1, replace: bool = False) -> DataFrame:
    """n rows by a seeded hash, so a rerun gives the same ones; with replacement n draws, each of any row with equal chance. Sampling is the operator.

    With replacement, rows are numbered and each draw is joined to the number that its hash picks.
    """
    if not replace:
        return df.orderBy(F.xxhash64(*df.columns, F.lit(seed)), *df.columns).limit(n)
    numbered = written(ranked(df, [F.xxhash64(*df.columns, F.lit(seed)), *df.columns], "_at"))
    size = numbered.agg(F.count("*").alias("_size")).filter("_size > 0")
    draws = df.sparkSession.range(n).crossJoin(F.broadcast(size)).select((F.pmod(F.xxhash64("id", F.lit(seed)), F.col("_size")) + 1).cast("long").alias("_at"))
    return draws.join(numbered, "_at").select(*df.columns)


def flat_background(reference: DataFrame, size: int, v: str = "v_reps", j: str = "j_reps", seed: int = 1, subject: str = "subject") -> DataFrame:
    """As many rows of each V-J pair: the fewest that a pair has, or its share of ``size``; with gene frequencies and weights."""
    per = gene_usage(reference, [v, j])
    bounds = per.agg(F.min("n").alias("least"), F.count("*").alias("pairs")).first()
    n = min(bounds["least"], math.ceil(size / bounds["pairs"]))
    flat = stratified_sample(reference, [v, j], n, seed)
    return usage_weights(with_gene_frequencies(flat, stratified_usage(reference, v, j, subject), v, j), [v, j], "pVJ")


def subject_sample(reference: DataFrame, size: int, most: int = 120_000, subject: str = "subject", seed: int = 1) -> DataFrame:
    """An equal draw from every subject, at most ``most`` each."""
    n = min(most, math.ceil(size / max(1, reference.select(subject).distinct().count())))
    return stratified_sample(reference, [subject], n, seed)


@dataclass(frozen=True)
class Recombination:
    """A generation model of a chain with V, D and J genes.

    ``v``, ``d``, ``j``: gene to its kept nucleotides after trimming, (sequence, probability) each: of V from the conserved cysteine on, of
    J up to the conserved last residue. ``p_v``, ``p_dj``: gene probabilities. Inserts have a length distribution and a
    first-order chain of bases A, C, G, T that starts in its steady state; that between D and J runs from J towards D.
    """

    v: dict[str, list[tuple[str, float]]]
    d: dict[str, list[tuple[str, float]]]
    j: dict[str, list[tuple[str, float]]]
    p_v: dict[str, float]
    p_dj: dict[tuple[str, str], float]
    p_insert_vd: list[float]
    p_insert_dj: list[float]
    markov_vd: list[list[float]]
    markov_dj: list[list[float]]

    @staticmethod
    def trimmed(germline: str, left: list[float] | None = None, right: list[float] | None = None, palindrome: int = 0) -> list[tuple[str, float]]:
        """Kept sequences of a germline with palindromic bases, ``left`` and ``right`` being the probabilities of losing 0, 1, ... of either end's extended bases."""
        rc = germline[::-1].translate(str.maketrans("ACGT", "TGCA"))
        head, tail = (rc[len(rc) - palindrome :] if palindrome and left else ""), (rc[:palindrome] if palindrome and right else "")
        full, out = head + germline + tail, {}
        for a, p in enumerate(left or [1.0]):
            for b, q in enumerate(right or [1.0]):
                if p * q and a + b <= len(full):
                    kept = full[a : len(full) - b]
                    out[kept] = out.get(kept, 0.0) + p * q
        return list(out.items())

    def first(self, chain: list[list[float]]) -> np.ndarray:
        """The chain's steady state."""
        m = np.array(chain, float)
        x = np.linalg.lstsq(np.vstack([m.T - np.eye(4), np.ones(4)]), np.array([0, 0, 0, 0, 1.0]), rcond=None)[0]
        return np.clip(x, 0, None) / np.clip(x, 0, None).sum()

    def draw(self, rng: np.random.Generator, v: str | None, j: str | None) -> tuple[str, str, str] | None:
        """(nucleotides, V, J) of one event; given genes stay, with D drawn as if J had been drawn with it."""
        pick = lambda p: int(np.searchsorted(np.cumsum(p) / np.sum(p), rng.random(), "right"))
        v = v or list(self.p_v)[pick(list(self.p_v.values()))]
        d, drawn = list(self.p_dj)[pick(list(self.p_dj.values()))]
        parts = []
        for options in (self.v[v], self.d[d], self.j[j or drawn]):
            if not options:
                return None
            parts.append(options[pick([q for _, q in options])][0])
        one = self._bases(rng, pick(self.p_insert_vd), self.markov_vd)
        two = self._bases(rng, pick(self.p_insert_dj), self.markov_dj)[::-1]
        return parts[0] + one + parts[1] + two + parts[2], v, j or drawn

    def _bases(self, rng: np.random.Generator, n: int, chain: list[list[float]]) -> str:
        out, p = "", self.first(chain)
        for _ in range(n):
            k = min(3, int(np.searchsorted(np.cumsum(p) / np.sum(p), rng.random(), "right")))
            out, p = out + "ACGT"[k], chain[k]
        return out

    def cdr3(self, rng: np.random.Generator, v: str | None = None, j: str | None = None, tries: int = 20) -> tuple[str, str, str] | None:
        """(residues, V, J) of the first draw in frame, without a stop, from C to F, V or W; None for unknown genes or after the tries."""
        if v is not None and v not in self.v or j is not None and j not in self.j:
            return None
        for _ in range(tries):
            got = self.draw(rng, v, j)
            if got and len(got[0]) % 3 == 0 and got[0]:
                aa = residues(got[0])
                if "*" not in aa and aa[0] == "C" and aa[-1] in "FVW":
                    return aa, got[1], got[2]
        return None


def residues(nt: str) -> str:
    at = {b: i for i, b in enumerate("TCAG")}
    return "".join(_CODONS[16 * at[nt[i]] + 4 * at[nt[i + 1]] + at[nt[i + 2]]] for i in range(0, len(nt) - 2, 3))


def generate(wanted: DataFrame, model: Recombination, v: str = "v_reps", j: str = "j_reps", n: str = "n", seed: int = 1, tries: int = 20) -> DataFrame:
    """(v, j, cdr3) for each row's number of sequences. A row's draws are seeded by its genes and number, so a rerun gives the same; failed draws are left out."""

    def run(batches):
        for pdf in batches:
            rows = []
            for gv, gj, i, h in zip(pdf["v"], pdf["j"], pdf["i"], pdf["h"]):
                got = model.cdr3(np.random.default_rng([seed, int(h) & 0xFFFFFFFF, int(i)]), gv, gj, tries)
                if got:
                    rows.append((gv, gj, got[0]))
            yield pd.DataFrame(rows, columns=["v", "j", "cdr3"])

    each = wanted.select(F.col(v).alias("v"), F.col(j).alias("j"), F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias("i")).withColumn("h", F.xxhash64("v", "j"))
    return each.mapInPandas(run, "v string, j string, cdr3 string").withColumnsRenamed({"v": v, "j": j})


def all_pairs(spark: SparkSession, model: Recombination, n: int, v: str = "v_reps", j: str = "j_reps") -> DataFrame:
    """n sequences of every V-J pair of first alleles."""
    first = lambda genes: [g for g in genes if g.endswith("*01")]
    rows = [(a, b, n) for a in first(model.v) for b in first(model.j)]
    return generate(spark.createDataFrame(rows, f"{v} string, {j} string, n int"), model, v, j)


def matched_background(usage: DataFrame, model: Recombination, size: int, v: str = "v_reps", j: str = "j_reps", seed: int = 1) -> DataFrame:
    """Generated sequences in proportion to a usage table (v, j, n): n times ceil(size / sum of n) each."""
    times = math.ceil(size / max(1, usage.agg(F.sum("n")).first()[0]))
    return generate(usage.withColumn("n", F.col("n") * times), model, v, j, seed=seed)


class _Reader:
    """Matrices that follow a residue string base by base: at place p the state is the open codon's bases, 1, 4 or 16 of them."""

    def __init__(self, cdr3: str):
        self.n = 3 * len(cdr3)
        bases = "ACGT"
        self.steps: list[list[np.ndarray]] = []
        for a in cdr3:
            codons = {x + y + z for x in bases for y in bases for z in bases if residues(x + y + z) == a}
            one, two = {c[0] for c in codons}, {c[:2] for c in codons}
            first = [np.zeros((1, 4)) for _ in bases]
            second, third = [np.zeros((4, 16)) for _ in bases], [np.zeros((16, 1)) for _ in bases]
            for k, b in enumerate(bases):
                first[k][0, k] = b in one
                for i, x in enumerate(bases):
                    second[k][i, 4 * i + k] = x + b in two
                    for m, y in enumerate(bases):
                        third[k][4 * i + m, 0] = x + y + b in codons
            self.steps += [first, second, third]

    def width(self, place: int) -> int:
        return (1, 4, 16)[place % 3]

    def empty(self, *shape: int) -> list[np.ndarray]:
        return [np.zeros((*shape, self.width(p))) for p in range(self.n + 1)]

    def inserted(self, start: list[np.ndarray], lengths: list[float], step: np.ndarray, head: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Weights after an insert: arrays (any, state) per place. ``step[x, y]`` weighs base y after x, ``head`` a first base, ``end`` a last one."""
        rows, most = start[0].shape[0], len(lengths) - 1
        out = [lengths[0] * x for x in start]
        layer = np.zeros((most, 4, rows, 1))  # by length less one, last base, row, state
        share = np.array(lengths[1:])
        for p in range(self.n):
            new = np.zeros((most, 4, rows, self.width(p + 1)))
            for k in range(4):
                move = self.steps[p][k]
                if most:
                    new[0, k] = head[k] * (start[p] @ move)
                    new[1:, k] = np.tensordot(layer[:-1], step[:, k], ([1], [0])) @ move
            layer = new
            out[p + 1] = out[p + 1] + np.einsum("l,lbrs,b->rs", share, layer, end)
        return out


def generation_probability(cdr3: str, model: Recombination, v: str | list[str] | None = None, j: str | list[str] | None = None) -> float:
    """The probability that the model makes exactly this residue string, summed over all events and codons; with genes given, of these with their own probabilities.

    Forward sums over places: V's kept bases, the first insert, D's, the second insert; J's kept bases are read from the end.
    """
    if not cdr3 or set(cdr3) - set(_CODONS) or "*" in cdr3:
        return 0.0
    r, base = _Reader(cdr3), {b: i for i, b in enumerate("ACGT")}
    chosen = lambda x, every: list(every) if x is None else [x] if isinstance(x, str) else list(x)

    def forward(x: np.ndarray, text: str, place: int) -> np.ndarray | None:
        if place + len(text) > r.n:
            return None
        for k, b in enumerate(text):
            x = x @ r.steps[place + k][base[b]]
            if not x.any():
                return None
        return x

    begin = r.empty(1)
    for gene in chosen(v, model.p_v):
        for kept, q in model.v.get(gene, []):
            got = forward(np.array([[model.p_v.get(gene, 0.0) * q]]), kept, 0)
            if got is not None:
                begin[len(kept)] += got
    vd, dj = np.array(model.markov_vd, float), np.array(model.markov_dj, float)
    after = r.inserted(begin, model.p_insert_vd, vd, model.first(vd), np.ones(4))
    names = list(model.d)
    middle = r.empty(len(names))
    for i, d in enumerate(names):
        starts: dict[int, list[tuple[str, float]]] = {}
        for kept, q in model.d[d]:
            for place in range(r.n - len(kept) + 1):
                if after[place].any():
                    starts.setdefault(place, []).append((kept, q))
        for place, options in starts.items():
            read: dict[str, np.ndarray | None] = {"": after[place]}
            for kept, q in sorted(options, key=lambda o: o[0]):
                # Longest prefix read so far, then base by base.
                k = len(kept)
                while kept[:k] not in read:
                    k -= 1
                x = read[kept[:k]]
                for m in range(k, len(kept)):
                    x = forward(x, kept[m], place + m) if x is not None else None
                    read[kept[: m + 1]] = x
                if x is not None:
                    middle[place + len(kept)][i] += q * x[0]
    last = r.inserted(middle, model.p_insert_dj, dj.T, np.ones(4), model.first(dj))
    total = 0.0
    for gene in chosen(j, dict.fromkeys(g for _, g in model.p_dj)):
        tail = r.empty(1)
        for kept, q in model.j.get(gene, []):
            if len(kept) <= r.n:
                x = np.array([[q]])
                for k, b in enumerate(reversed(kept)):
                    x = x @ r.steps[r.n - 1 - k][base[b]].T
                tail[r.n - len(kept)] += x
        share = np.array([model.p_dj.get((d, gene), 0.0) for d in names])
        total += sum(float(share @ (last[p] @ tail[p][0])) for p in range(r.n + 1))
    return total


def with_generation_probability(df: DataFrame, model: Recombination, cdr3: str, name: str = "pgen") -> DataFrame:
    """Adds the probability of each CDR3, computed once for every distinct string."""

    @F.pandas_udf("double")
    def pgen(s: pd.Series) -> pd.Series:
        return s.map(lambda x: generation_probability(x, model))

    distinct = df.select(cdr3).dropna().distinct().withColumn(name, pgen(F.col(cdr3)))
    return df.join(distinct, cdr3, "left")
