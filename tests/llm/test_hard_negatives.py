"""Hard negatives against plain Python over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloneframe.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score int, q string, id int"


def plain(rows, anchor=lambda i: i % 100 == 0, k=5, n=10):
    kept = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        row = (label, [math.floor(256 * v) for v in x])
        kept[i] = min(kept.get(i, row), row)
    out = set()
    for i, (label, q) in kept.items():
        if not anchor(i):
            continue
        score = {j: sum(a * b for a, b in zip(q, r)) for j, (_, r) in kept.items() if j != i}
        order = sorted(score, key=lambda j: (-score[j], j))
        for p in [j for j in order if kept[j][0] == label][:k]:
            fit = [j for j in order if kept[j][0] != label and 30 * score[p] <= 100 * score[j] <= 90 * score[p]][:n]
            out |= {(i, p, rank, j, score[p], score[j]) for rank, j in enumerate(fit, 1)}
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, x, label, 1, "q", 2) for i, x, label in rows], SCHEMA)


def mined(spark, rows, **options):
    return [tuple(r) for r in hard_negatives.hard_negatives(table(spark, rows), F.col("id") % 100 == 0, **options).collect()]


def odd_rows(seed, scale):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0.1, scale) for _ in range(12)], rng.choice([0, 0, 0, 1, 2, 9])) for i in range(900)]
    same = rows[100][1]
    rows += [(i, same, i % 2) for i in range(900, 960)]  # ties
    rows += [(960, None, 1), (961, [1.0, None], 1), (962, [math.inf] * 12, 1), (963, [math.nan] + [0.0] * 11, 1), (964, [0.1] * 12, None), (None, [0.1] * 12, 1)]
    rows += [(970, [], 0), (1000, [0.5] * 3, 0), (1100, [0.0] * 12, 1), (1200, [-v for v in same], 0)]  # empty, short, zero, opposite
    return rows + rows[200:203] + [(300, [9.0] * 12, 5), (500, rows[500][1], -1)]  # repeated rows and ids


@pytest.mark.parametrize(("seed", "scale"), [(1, 0.2), (2, 30.0), (3, 3e4), (4, 3e6)])
def test_equals_all_pairs(spark, seed, scale, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_CANDIDATES", 256)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    rows = odd_rows(seed, scale)
    got = mined(spark, rows)
    assert len(got) == len(set(got)) and set(got) == plain(rows) and len(got) > 100


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == [] and mined(spark, [(100, [1.0], 1), (1, [1.0], 1), (2, [1.0], 1)]) == []


def test_planes_sum_to_the_integers():
    rng = np.random.default_rng(0)
    for q in (rng.integers(-300, 300, (5, 7)), rng.integers(0, 9, (3, 3)), np.full((2, 2), -128), np.zeros((1, 4), int)):
        planes = hard_negatives.bit_planes(q)
        assert (sum(w * p for w, p in planes) == q).all() and planes[0][0] < 0
        assert [abs(w) for w, _ in planes] == sorted((abs(w) for w, _ in planes), reverse=True)


def test_intervals_drop_most_pairs_before_the_last_plane(monkeypatch):
    """Of a tile with known bounds, few pairs are left for the last planes, and the result is that of the full products."""
    rng = np.random.default_rng(5)
    a, c = rng.integers(-90, 90, (40, 64)), rng.integers(-90, 90, (3000, 64))
    best, wide = hard_negatives.Best(40, 1, 5), np.full((40, 1), math.inf)
    sizes = []
    summed = np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, x, y: sizes.append(len(x)) or summed(how, x, y))
    for j, j2 in hard_negatives._tiles(3000, 3000, 320):
        hard_negatives.sift(a, -wide, wide, c[j:j2], np.arange(j, j2), np.ones((40, j2 - j), bool), best, 0)
    full = a @ c.T
    for i in range(40):
        order = np.lexsort((np.arange(3000), -full[i]))[:5]
        assert best.id[best.slot == i].tolist() == order.tolist() and best.score[best.slot == i].tolist() == full[i, order].tolist()
    assert sizes and sizes[-1] < 0.05 * 40 * 2680
