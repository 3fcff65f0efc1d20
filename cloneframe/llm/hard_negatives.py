"""Hard negatives by bit-sliced integer products (free style: NumPy in Arrow tasks over a grid of blocks).

Anchors are a stated part of the rows, and each is compared with all rows. Rows are dealt by hash into blocks of candidates, anchors into blocks of anchors;
a task compares one block of each, so its memory is bounded whatever the labels, and a hot label spreads over all blocks.

Within a task, the candidates' integer components are cut into bit-planes (two's complement). Planes are multiplied with the anchors, the most significant first;
after each, a score lies between its sum so far plus the least and plus the most that the planes left can add. A candidate is dropped for an
anchor once its interval misses all that anchor's score ranges or lies below the ``k`` best known there. When few are left, the further planes are summed for those pairs alone.

1. Positives: the best rows of the anchor's label, which only meets candidates of that label; each task's best, then the best of those.
2. Negatives: rows of other labels in each positive's range of scores; each task's best, then the best of those.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors of different lengths are filled with zeros. Of rows that
share an id, the one with the least (label, vector) takes part. Ties go to the smaller id. Anchors without positives, and positives without negatives in range, give no rows, as does an
empty table. Only the id, label and vector columns are read. Scores are 64-bit integers and wrap beyond.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import written

#: Candidates and anchors of a block at most; fewer candidates where that would leave tasks without work.
CANDIDATES, LEAST_CANDIDATES, ANCHORS = 65_536, 2_048, 8_192
#: Pairs that are compared at once within a task.
TILE_ROWS, TILE_COLUMNS = 512, 8_192
#: Below this share of open pairs, they are handled as a list.
SPARSE = 0.1


def quantised(df: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, label, q) of the rows that take part: components as floor(scale * x)."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x"))
    return rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite).select("id", "label", F.transform("x", lambda v: F.floor(scale * v)).alias("q"))


def bit_planes(q: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(weight, plane of 0 and 1) of integers, the most significant first; weights times planes sum to ``q``."""
    bits = 1 + max(int(q.max(initial=0)).bit_length(), int(-q.min(initial=0) - 1).bit_length() if q.min(initial=0) < 0 else 0)
    return [((1 << j) * (-1 if j == bits - 1 else 1), (q >> j) & 1) for j in range(bits - 1, -1, -1)]


class Best:
    """The k best (score, id) of each of m x p lists."""

    def __init__(self, m: int, p: int, k: int):
        self.k, self.p = k, p
        self.least = np.full((m, p), -math.inf)  # the k-th best, once there are k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.r_[self.slot, slot], np.r_[self.score, score], np.r_[self.id, ids]
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = place < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        full = place == self.k - 1
        self.least.reshape(-1)[slot[full]] = score[full]


def sift(a: np.ndarray, low: np.ndarray, high: np.ndarray, c: np.ndarray, ids: np.ndarray, allowed: np.ndarray, best: Best, at: int) -> None:
    """Adds to ``best`` (lists of anchors from ``at`` on) what anchors ``a`` (m x d) have among candidates ``c`` (n x d): allowed pairs with a score within
    [low, high] of one of p ranges (m x p)."""
    reach = int(np.abs(a).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, a.shape[1]) * 4
    kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64
    planes = bit_planes(c) if reach < 1 << 62 else [(1, c)]  # wider products wrap, and no interval holds for them
    most, least, left = np.maximum(a, 0).sum(1), np.minimum(a, 0).sum(1), sum(abs(w) for w, _ in planes[1:])
    x, score, open_, pairs = a.astype(kind), np.zeros((len(a), len(c)), kind), allowed, None
    for weight, plane in planes:
        if pairs is None:
            score += (weight * x) @ plane.T.astype(kind)
        else:
            r, k, s = pairs
            pairs = r, k, s + weight * np.einsum("ij,ij->i", a[r], plane[k])
        floor = best.least[at : at + len(a)]
        if pairs is None:
            if left and left * int((most - least).min(initial=1 << 62)) > float(score.max(initial=0)) - float(score.min(initial=0)):
                left >>= 1
                continue  # all intervals are wider than all scores so far: nothing can be dropped
            under, over = score + (left * least)[:, None].astype(kind), score + (left * most)[:, None].astype(kind)
            need = np.zeros_like(open_)
            for p in range(low.shape[1]):
                need |= (over >= np.maximum(low[:, p], floor[:, p])[:, None]) & (under <= high[:, p][:, None])
            open_ = open_ & need
            if left == 0 or np.count_nonzero(open_) < SPARSE * open_.size:
                r, k = np.nonzero(open_)
                pairs = r, k, score[r, k].astype(np.int64)
        else:
            r, k, s = pairs
            need = np.zeros(len(s), bool)
            for p in range(low.shape[1]):
                need |= (s + left * most[r] >= np.maximum(low[r, p], floor[r, p])) & (s + left * least[r] <= high[r, p])
            pairs = r[need], k[need], s[need]
        left >>= 1
    r, k, s = pairs if pairs is not None else (*np.nonzero(open_), score[open_].astype(np.int64))
    for p in range(low.shape[1]):
        fit = (s >= low[r, p]) & (s <= high[r, p]) & (s >= floor[r, p])
        best.add((at + r[fit]) * best.p + p, s[fit], ids[k[fit]])


def _columns(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, label codes are left as values, and the vectors as a matrix; of equal ids the least row."""
    table = table.combine_chunks()
    ids, labels = table["id"].to_numpy(), np.array(table["label"].to_pylist())
    q = table["q"].combine_chunks()
    sizes, flat = q.value_lengths().to_numpy(zero_copy_only=False), q.flatten().to_numpy(zero_copy_only=False)
    rows = np.zeros((len(ids), width), np.int64)
    starts = np.cumsum(sizes) - sizes
    rows[np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(starts, sizes)] = flat
    if len(np.unique(ids)) < len(ids):
        order = sorted(range(len(ids)), key=lambda i: (ids[i], labels[i], rows[i].tolist()))
        keep = [i for j, i in enumerate(order) if j == 0 or ids[order[j - 1]] != ids[i]]
        ids, labels, rows = ids[keep], labels[keep], rows[keep]
    return ids, labels, rows


def _both(left: pa.Table, right: pa.Table):
    width = max([1, *(int(t["q"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for t in (left, right))])
    a_ids, a_labels, a = _columns(left, width)
    c_ids, c_labels, c = _columns(right, width)
    codes = np.unique(np.r_[a_labels, c_labels], return_inverse=True)[1]
    return a_ids, codes[: len(a_ids)], a, c_ids, codes[len(a_ids) :], c


def _tiles(size: int, step: int, first: int):
    """Ranges that cover ``size``; the first is short, as it sets the bounds of the others."""
    at = 0
    while at < size:
        end = min(size, at + (first if at == 0 else step))
        yield at, end
        at = end


def _cells(rows: DataFrame, anchors: DataFrame) -> tuple:
    """Both sides dealt over a grid: each block of anchors meets each block of candidates in one task."""
    n, m = rows.count(), anchors.count()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = max(1, math.ceil(n / CANDIDATES), min(parts, math.ceil(n / LEAST_CANDIDATES)))
    lines = max(1, math.ceil(m / ANCHORS))
    block = lambda k, of: F.pmod(F.xxhash64("id"), F.lit(of)).cast("int").alias(k)
    every = lambda k, of: F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias(k)
    left = anchors.select("*", block("_line", lines)).select("*", every("_column", columns))
    right = rows.select(*(F.col(c).alias(c) for c in rows.columns), block("_column", columns)).select("*", every("_line", lines))
    return left.groupBy("_line", "_column"), right.groupBy("_line", "_column")


def top_positives(rows: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): each anchor's best ``k`` other rows of its label."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(left) and len(right):
            a_ids, a_codes, a, c_ids, c_codes, c = _both(left, right)
            for code in np.unique(a_codes):
                mine, theirs = np.nonzero(a_codes == code)[0], np.nonzero(c_codes == code)[0]
                best, wide = Best(len(mine), 1, k), np.full((len(mine), 1), math.inf)
                for i, i2 in _tiles(len(mine), TILE_ROWS, TILE_ROWS):
                    for j, j2 in _tiles(len(theirs), TILE_COLUMNS, 64 * k):
                        ours, cand = mine[i:i2], theirs[j:j2]
                        sift(a[ours], -wide[i:i2], wide[i:i2], c[cand], c_ids[cand], a_ids[ours][:, None] != c_ids[cand][None, :], best, i)
                for column, values in zip(out, (a_ids[mine[best.slot]], best.id, best.score)):
                    column.extend(values.tolist())
        return pa.table({"anchor_id": pa.array(out[0], pa.int64()), "positive_id": pa.array(out[1], pa.int64()), "positive_score": pa.array(out[2], pa.int64())})

    left, right = _cells(rows, anchors)
    found = left.cogroup(right).applyInArrow(run, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k).drop("_place")


def top_negatives(rows: DataFrame, anchors: DataFrame, positives: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each positive the best ``k`` rows of other labels from ``low`` to ``high`` percent of its score."""
    lists = positives.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("_positives"))  # of bounded size

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(5)]
        if len(left) and len(right):
            known = dict(zip(left["id"].to_pylist(), left["_positives"].to_pylist()))
            a_ids, a_codes, a, c_ids, c_codes, c = _both(left, right)
            width = max(len(x) for x in known.values())
            ids, scores = np.zeros((len(a), width), np.int64), np.zeros((len(a), width), np.int64)
            least, most = np.full((len(a), width), math.inf), np.full((len(a), width), -math.inf)
            for i, anchor in enumerate(a_ids.tolist()):
                for j, x in enumerate(known[anchor]):
                    s = x["positive_score"]
                    ids[i, j], scores[i, j], least[i, j], most[i, j] = x["positive_id"], s, -(-low * s // 100), high * s // 100
            best = Best(len(a), width, k)
            for i, i2 in _tiles(len(a), TILE_ROWS, TILE_ROWS):
                for j, j2 in _tiles(len(c), TILE_COLUMNS, 64 * k):
                    sift(a[i:i2], least[i:i2], most[i:i2], c[j:j2], c_ids[j:j2], a_codes[i:i2, None] != c_codes[None, j:j2], best, i)
            row, p = best.slot // width, best.slot % width
            for column, values in zip(out, (a_ids[row], ids[row, p], best.id, scores[row, p], best.score)):
                column.extend(values.tolist())
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"), out)})

    left, right = _cells(rows, anchors.join(lists, "id"))
    found = left.cogroup(right).applyInArrow(run, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(
    df: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """For each anchor (rows for whose ``id`` the column holds) and each of its best positives, the best negatives in range."""
    rows = written(quantised(df, id_col, label_col, vector_col))
    chosen = rows.filter(anchors)
    best = written(top_positives(rows, chosen, positives))
    return top_negatives(rows, chosen, best, negatives, low, high)


def with_noise(df: DataFrame) -> DataFrame:
    """``embeddings`` with the label of every seventh id moved on by one."""
    return df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


#: The same in DuckDB's SQL, over all anchors and rows.
ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, a.label AS al, c.vec_id AS c, c.label AS cl, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * c.q[i]))::BIGINT AS score
      FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT a, c AS p, score AS ps FROM s WHERE al = cl QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5),
n AS (SELECT a, p, ps, c, score, row_number() OVER (PARTITION BY a, p ORDER BY score DESC, c) AS rank FROM p JOIN s USING (a) WHERE al <> cl AND 30 * ps <= 100 * score AND 100 * score <= 90 * ps)
SELECT a AS anchor_id, p AS positive_id, rank::INT AS rank, c AS negative_id, ps AS positive_score, score AS negative_score FROM n WHERE rank <= 10
"""
