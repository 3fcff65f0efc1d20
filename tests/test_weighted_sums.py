"""Weighted sums of centres are exact: equal centres tie, whatever the order of rows and however their weight is cut into clones."""

import random
from decimal import Decimal

import pytest

from cloneframe.operators import discovery, radii as R

EDGES = "left_ix long, right_ix long, dist double"


def controlled(spark, weights, edges, control, n=2):
    """``background_control`` of n targets that have themselves for neighbours, over clones 0, 1, ... of these weights."""
    target = spark.createDataFrame([(i,) for i in range(n)], "clone_ix long")
    own = spark.createDataFrame([(i, i, 0.0) for i in range(n)], EDGES)
    background = spark.createDataFrame(list(enumerate(weights)), "clone_ix long, weight double")
    out = R.background_control(own, spark.createDataFrame(edges, EDGES), target, background, control, [0.0, 1.0])
    return {r["left_ix"]: r for r in out.collect()}


def test_equal_weights_have_equal_radii(spark):
    """0.1 three times is 0.3, one twentieth of six clones: both centres may reach that far."""
    edges = [(0, i, 1.0) for i in range(3)] + [(1, 3, 1.0)]
    got = controlled(spark, [0.1, 0.1, 0.1, 0.3, 1.0, 1.0], edges, 0.05)
    assert got[0]["radius"] == got[1]["radius"] == 1.0
    assert got[0]["bkgd_weighted"] == got[1]["bkgd_weighted"] == 0.3 and got[0]["chi2dist"] == got[1]["chi2dist"]


def test_sums_are_those_of_decimals(spark):
    rng = random.Random(5)
    weights = [rng.randrange(1, 10**7) / 25 for _ in range(60)]
    edges = [(i, k, 0.0) for i in range(40) for k in rng.sample(range(60), 30)]
    got = controlled(spark, weights, edges, 0.0, 40)
    assert {i: r["bkgd_weighted"] for i, r in got.items()} == {i: float(sum(Decimal(repr(weights[k])) for j, k, _ in edges if i == j)) for i in range(40)}


def test_weights_that_are_no_short_decimals_count(spark):
    weights = [1e-30, 2e-30, 1 / 7000, 3e12, 5.0, None]
    got = controlled(spark, weights, [(0, 0, 0.0), (0, 1, 0.0), (1, 2, 0.0), (1, 3, 0.0), (2, 4, 0.0), (2, 2, 0.0), (3, 5, 0.0)], 0.0, 5)
    assert [got[i]["bkgd_weighted"] for i in range(5)] == pytest.approx([3e-30, 3e12 + 1 / 7000, 5 + 1 / 7000, 0, 0], rel=1e-15)


def test_equal_centres_rank_by_id(spark):
    """Weights so heavy that a last digit of their sum reaches the ninth decimal of the statistic: one heavy clone and three of a third of its weight still tie."""
    cdr3, weights = "CASSLAEQYF", [2413186.8, 2413186.8, 2413186.8, 7239560.4]
    target = spark.createDataFrame([(i, cdr3, f"s{i}") for i in (1, 2)], "clone_ix long, cdr3_b_aa string, subject string")
    background = spark.createDataFrame([(i, cdr3, x) for i, x in enumerate(weights)], "clone_ix long, cdr3_b_aa string, weight double")
    own = spark.createDataFrame([(i, i, 0.0) for i in (1, 2)], EDGES)
    far = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0), (1, 2, 0.0), (2, 3, 0.0)], EDGES)
    got = discovery.find_metaclonotypes(target, background, own, far, 0.05, [0.0, 1.0], min_subjects=0).collect()
    assert sorted((r["rank"], r["left_ix"]) for r in got) == [(1, 1), (2, 2)] and len({r["chi2joint"] for r in got}) == 1
