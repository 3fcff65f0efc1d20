"""Quality classifier by positive-unlabelled learning (free style: NumPy features in Arrow tasks).

Trusted positives are rows labelled 1; the unlabelled set is every row of the learning folds, positives among them,
so it stands for the whole population; the class prior is the share of 1 among the labelled rows of those folds. With
the logistic loss l(z) = log(1 + exp(-z)) and prior p, the non-negative unbiased risk is

    p E_pos[l(f)] + max(0, E_unl[l(-f)] - p E_pos[l(-f)])

``RIDGE`` / 2 |weights|^2 is added. For a linear f this is the greater of two convex functions (the risk with and without
the bracket), so it has one least point, and ``minimise`` finds it: Newton steps with a backtracking line search on the
unbiased risk until the decrement is below ``TOLERANCE``; if the bracket is negative there, the share with which it must
count for the least point is found by a bracketing secant, until the duality gap is below ``GAP``. Each
evaluation is one pass of Spark over all rows' features, summed per task and then per bucket; at most
``BUCKETS`` rows of sums reach the driver. No row is sampled.

Features come from a whole text's bytes alone: shares of character kinds, word and line
shapes, repetition. The feature table is written once and read by each pass and by scoring.

Defined results: null and empty texts have features of zero and get the score of those; very long texts count by their shares, as a
whole. No ties arise: equal texts get equal scores, and repeated rows repeat. Without labels of both
kinds in the learning folds there is nothing to learn: every score is the prior (1 without labels). Rows with a
null id are scored, never learned from; labels of ids without a text are unused, repeated labels count once (the lowest). Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe_codec import SLICE_CHARS, text_slices
from .frames import written

#: The ridge is the least of 0.001, 0.003, 0.01, 0.03 and 0.1 at which the non-negative branch hardly binds (a share of the bracket over 0.95) on learning rows by the thousand.
RIDGE, BUCKETS = 0.1, 32
#: Newton's decrement at which a descent ends, and how far the risk found may be above the least one.
TOLERANCE, GAP = 1e-9, 1e-6
#: Character kinds, by their first byte in UTF-8.
_KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\f", "\n", ".", ",", "!?", "|", "#$%&*<>", "\"'()-:;/", "{}[]=+_\\^~`@"]
_TABLE = np.full(256, len(_KINDS), np.int64)
for _i, _k in enumerate(_KINDS):
    _TABLE[[ord(c) for c in _k]] = _i
_TABLE[0x80:0xC0] = len(_KINDS) + 1  # further bytes of a character
_N_KINDS = len(_KINDS) + 2
FEATURES = _N_KINDS - 1 + 11
#: Characters and words that shares are counted over in addition, so that a text of a few words isn't judged by one capital.
MORE_CHARS, MORE_WORDS = 30, 6


def features_of(text: str) -> np.ndarray:
    out = np.zeros(FEATURES, np.float32)
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return out
    kinds = np.bincount(_TABLE[data], minlength=_N_KINDS)[: _N_KINDS - 1]
    n = kinds.sum()
    out[: _N_KINDS - 1] = np.sqrt(kinds / (n + MORE_CHARS))
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    w, k = max(1, len(words)), max(1, len(lines))
    closed = sum(x.rstrip()[-1:] in b".!?\"')" for x in lines)
    capital = kinds[1] / (kinds[0] + kinds[1] + MORE_CHARS)
    again = sum(map(eq, words, words[1:]))
    out[_N_KINDS - 1 :] = [
        1.0,  # the text isn't empty
        np.log1p(len(words)) / 10,
        np.log1p(n / w) / 3,
        (w - len(set(words))) / (w + MORE_WORDS),
        1 - len(set(lines)) / k,
        closed / k,
        np.log1p(w / k) / 6,
        capital,
        min(1.0, kinds[9] / (w + MORE_WORDS)),
        min(1.0, kinds[8] / (w + MORE_WORDS)),
        np.sqrt(again / (w + MORE_WORDS)),
    ]
    return out


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<float>) of every whole text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at, part in text_slices(batch.column(1), SLICE_CHARS):
                flat = np.concatenate([features_of(t) for t in part])
                x = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, FEATURES, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), x], names=[id_col, "x"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, x array<float>")


def held_out(id_col: str) -> Column:
    """The fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column(batch.schema.get_field_index("x"))
    return x.flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)


def _sums(rows: DataFrame, work, size: int) -> np.ndarray:
    """The sum of ``work(batch) -> vector`` over all batches: by task, then by bucket."""

    def by_task(batches):
        from pyspark import TaskContext

        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += work(batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % BUCKETS]), pa.array([total], pa.list_(pa.float64()))], names=["bucket", "v"])

    def by_bucket(table):
        total = np.sum(table.column("v").to_pylist(), axis=0)
        return pa.table({"v": pa.array([total], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(by_task, "bucket long, v array<double>")
    got = parts.groupBy("bucket").applyInArrow(by_bucket, "v array<double>").collect()
    return np.sum([r["v"] for r in got], axis=0) if got else np.zeros(size)


class Terms(NamedTuple):
    """At some weights: the positives' part of the risk, the unbiased risk, and both ones' gradients and Hessians."""

    part: float
    whole: float
    part_gradient: np.ndarray
    whole_gradient: np.ndarray
    part_hessian: np.ndarray
    whole_hessian: np.ndarray

    @property
    def bracket(self) -> float:
        return self.whole - self.part


def sums_of(x: np.ndarray, pos: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What all rows of a block add to ``terms_of``; x has a last column of ones."""
    f = x @ w
    s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    p, h = x[pos], s * (1 - s)
    hessian = lambda m, z: ((z * m[:, None]).T @ z).ravel()
    return np.concatenate([
        [np.logaddexp(0, f).sum(), np.logaddexp(0, -f[pos]).sum(), f[pos].sum()],
        s @ x, (s[pos] - 1) @ p, p.sum(0), hessian(h, x), hessian(h[pos], p),
    ])


def terms_of(t: np.ndarray, n: float, n_pos: float, prior: float, d: int) -> Terms:
    a, b = t[3 : 3 + 3 * d].reshape(3, d), t[3 + 3 * d :].reshape(2, d, d)
    return Terms(
        prior * t[1] / n_pos, t[0] / n - prior * t[2] / n_pos,
        prior * a[1] / n_pos, a[0] / n - prior * a[2] / n_pos,
        prior * b[1] / n_pos, b[0] / n,
    )


def minimise(terms: Callable[[np.ndarray], Terms], d: int, ridge: float = RIDGE) -> np.ndarray:
    """The weights of the least non-negative risk with ridge; the last one, the intercept, is free (but for rounding)."""
    penalty = np.r_[np.full(d - 1, ridge), 1e-9]

    def descend(share: float, w: np.ndarray, t: Terms) -> tuple[np.ndarray, Terms]:
        """Least part + share * bracket, from w on."""
        value = lambda w, t: t.part + share * t.bracket + (penalty * w * w).sum() / 2
        mixed = lambda a, b: (1 - share) * a + share * b
        while True:
            gradient = mixed(t.part_gradient, t.whole_gradient) + penalty * w
            step = np.linalg.solve(mixed(t.part_hessian, t.whole_hessian) + np.diag(penalty), gradient)
            decrement, size = gradient @ step, 1.0
            if decrement < TOLERANCE:
                return w, t
            while True:
                new = w - size * step
                at = terms(new)
                if value(new, at) <= value(w, t) - 1e-4 * size * decrement:
                    break
                size /= 2
                if size < 1e-9:  # below the sums' rounding
                    return w, t
            w, t = new, at

    # What the risk at the least point for a share can be above the least risk: max(0, bracket) - share * bracket.
    share, w = 1.0, np.zeros(d)
    w, t = descend(share, w, terms(w))
    low, high, at_low, at_high, side = 0.0, 1.0, None, t.bracket, 0
    while max(0.0, t.bracket) - share * t.bracket > GAP and high - low > 1e-12 * high:
        # The bracket falls as its share grows: a secant between a share with a positive and one with a negative bracket.
        share = high / 4 if at_low is None else (low * at_high - high * at_low) / (at_high - at_low)
        w, t = descend(share, w, t)
        if t.bracket < 0:
            high, at_high = share, t.bracket
            if side < 0 and at_low is not None:
                at_low /= 2  # the end that stays counts half, so that both ends move
            side = -1
        else:
            low, at_low = share, t.bracket
            if side > 0:
                at_high /= 2
            side = 1
    return w


def fit(rows: DataFrame, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(mean, scale, weights with the intercept last) from rows (x, positive), unlabelled ones and positives. None without positives or with nothing else."""
    marks = lambda batch: batch.column(1).to_numpy(zero_copy_only=False).astype(bool)

    def moments(batch):
        x = matrix(batch)
        return np.concatenate([[len(x), marks(batch).sum()], x.sum(0), (x**2).sum(0)])

    total = _sums(rows, moments, 2 + 2 * FEATURES)
    n, n_pos = total[:2]
    if not n_pos or n == n_pos:
        return None
    mean = total[2 : 2 + FEATURES] / n
    scale = np.sqrt(np.maximum(total[2 + FEATURES :] / n - mean**2, 0))
    scale[scale < 1e-6] = np.inf  # a feature without spread has no weight
    d = FEATURES + 1

    def terms(w):
        work = lambda batch: sums_of(np.c_[(matrix(batch) - mean) / scale, np.ones(batch.num_rows)], marks(batch), w)
        return terms_of(_sums(rows, work, 3 + 3 * d + 2 * d * d), n, n_pos, prior, d)

    return mean, scale, minimise(terms, d)


class Model:
    """A fitted score: callable on a matrix of features. Without weights every score is the prior."""

    def __init__(self, prior: float, parts: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
        self.prior, self.parts = prior, parts

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.prior)
        mean, scale, w = self.parts
        return 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -30, 30)))


def learn(x: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_id: str = "doc_id", label_col: str = "quality") -> Model:
    """A model from a table of features (id, x) that can be read again, and labels."""
    known = written(
        labels.filter(F.col(label_id).isNotNull() & F.col(label_col).isin(0, 1))
        .filter(~held_out(label_id))
        .groupBy(F.col(label_id).alias(id_col))
        .agg(F.min(label_col).alias("_y"))
    )
    seen = known.agg(F.count("*").alias("n"), F.sum("_y").alias("ones")).first()
    prior = float(seen["ones"] / seen["n"]) if seen["n"] else 1.0
    if not seen["n"] or not 0 < seen["ones"] < seen["n"]:
        return Model(prior, None)
    rows = x.filter(F.col(id_col).isNotNull() & ~held_out(id_col)).join(known, id_col, "left")
    return Model(prior, fit(written(rows.select("x", F.coalesce(F.col("_y") == 1, F.lit(False)).alias("positive"))), prior))


def quality_scores(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality"
) -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    x = written(features(df, id_col, text_col))
    model = learn(x, labels, id_col, label_id, label_col)
    kind = df.schema[id_col].dataType.simpleString()

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model(matrix(batch)))], names=[id_col, "score"])

    scored = x.mapInArrow(score, f"`{id_col}` {kind}, score double")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text scores 0.5 or more, as they are.

    Only the learning folds' features are written. The verdicts then come row by row from the texts: joining a table of
    scores would shuffle all texts, which costs more than their features, and is undefined for rows that share an id.
    """
    learning = df.filter(F.col(id_col).isNotNull() & ~held_out(id_col))
    model = learn(written(features(learning, id_col, text_col)), labels, id_col)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model(np.array([features_of(t or "") for t in texts], np.float64).reshape(-1, FEATURES)))

    return df.filter(score(F.col(text_col)) >= 0.5)
