"""Operators that work in rounds or by parts, against plain versions on random cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloneframe.functions import metrics as M
from cloneframe.operators import background, cluster, clones as C, discovery, diversity, edges as E, neighbors as N, radii as R
from cloneframe.operators.ranks import adjusted, ranked


def words(rng, n, low, high, letters="ABC"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)]


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_edit_join_finds_every_pair(spark, radius):
    rng = random.Random(radius)
    left, right = (words(rng, 70, 0, 9) + words(rng, 30, 5, 14) + [None, ""] for _ in range(2))
    side = lambda xs: spark.createDataFrame([(i, f"v{i % 2}", x) for i, x in enumerate(xs)], "clone_ix int, v string, s string")
    got = sorted((r["left_ix"], r["right_ix"], r["dist"]) for r in E.edit_join(side(left), side(right), "s", radius, ["v"]).collect())
    want = [(i, j, float(d)) for (i, a), (j, b) in itertools.product(enumerate(left), enumerate(right)) if i % 2 == j % 2 and a is not None and b is not None and (d := M.edit_distance(a, b)) <= radius]
    assert got == want and len(want) > 5


def cdr3s(rng, n):
    """Strings with conserved ends: a few stems, a free middle of a few letters, a few tails."""
    stem, tail, letters = ["CASSL", "CASSP", "CASS", "CSA"], ["EQYF", "YEQYF", "GELFF", "EAFF"], "ACDEFGHIKLMNPQRSTVWY"
    return ["".join([rng.choice(stem), *rng.choices(letters, k=rng.randint(4, 8)), rng.choice(tail)]) for _ in range(n)]


@pytest.mark.parametrize(("radius", "share"), [(1, 0.03), (2, 0.1), (3, 0.2)])
def test_index_prunes_strings_with_conserved_ends(spark, radius, share):
    rng = random.Random(radius)
    strings = sorted({*cdr3s(rng, 2500), "", "C", "CASSLEQYF"})
    df = spark.createDataFrame([(i, "v", x) for i, x in enumerate(strings)], "clone_ix int, v string, s string")
    got = {(r["left_ix"], r["right_ix"], r["dist"]) for r in E.edit_join(df, df, "s", radius, ["v"]).collect()}
    every = df.select("clone_ix", "s").join(df.select(F.col("clone_ix").alias("other"), F.col("s").alias("t")), F.abs(F.length("s") - F.length("t")) <= radius)
    possible = every.count()
    assert got == {(r[0], r[1], float(r[2])) for r in every.select("clone_ix", "other", F.levenshtein("s", "t", radius).alias("d")).filter("d >= 0").collect()}
    a, b = df.select(F.col("v").alias("_k0"), F.col("s").alias("left")), df.select(F.col("v").alias("_k0"), F.col("s").alias("right"))
    tried = E.edit_candidates(a, b, ["_k0"], radius).count()
    assert len(got) <= tried < share * possible
    keys = a.select(F.inline(E.deletion_keys(F.col("left"), radius))).groupBy("_part").count()
    assert keys.agg(F.max("count")).first()[0] < 0.04 * len(strings)


def test_deletion_keys(spark):
    words_ = ["", "a", "aab", "abcd", "aaaa"]
    got = spark.createDataFrame([(w,) for w in words_], "w string").select("w", F.inline(E.deletion_keys(F.col("w"), 2))).collect()
    want = {(w, "".join(k), n) for w in words_ for n in range(3) if n <= len(w) for k in itertools.combinations(w, len(w) - n)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_grid_sends_a_block_to_few_tasks(spark):
    """200,000 strings against as many: rows sent to tasks are a small part of those that pairs of blocks would take, and each two blocks meet once."""
    n = 200_000
    strings = spark.range(n).select(F.concat(F.lit("CA"), F.substring(F.md5(F.col("id").cast("string")), 1, 12)).alias("s"))
    spec = M.MetricSpec((("s", M.Hamming(), 1),))
    left, right = E.grid(strings, strings, spec, 3.0)
    sent = sum(df.agg(F.sum(F.size(c))).first()[0] for df, c in ((left, "_left"), (right, "_right")))
    assert sent < 0.1 * 2 * n * (n / E.BLOCK)
    key = ["_size_left", "_size_right", "_line", "_column"]
    pairs = left.select(*key, F.size("_left").alias("a")).join(right.select(*key, F.size("_right").alias("b")), key)
    assert pairs.agg(F.sum(F.col("a") * F.col("b"))).first()[0] == n * n and pairs.count() >= 4 * 4
    assert pairs.agg(F.max("a")).first()[0] < 1.3 * E.SIDE * E.BLOCK


def test_kernels_over_blocks_equal_single_pairs():
    rng = random.Random(4)
    a, b = words(rng, 30, 0, 17, "ACDEFGHIKLMNPQRSTVWY."), words(rng, 30, 0, 17, "ACDEFGHIKLMNPQRSTVWY.")
    for metric, one in ((M.Aligned(), M.nw_hamming), (M.Aligned(False), M.nw_dissimilarity)):
        assert metric.block(a, b).tolist() == [[one(x, y) for y in b] for x in a]
    for metric in (M.Tcr(), M.Tcr(0, 0, True), M.Tcr(2, 1, False, 8, 3)):
        whole = metric.block(a, b)
        assert all(whole[i, j] == metric.block([x], [y])[0, 0] for i, x in enumerate(a) for j, y in enumerate(b))


def both_ways(spark, d, reach):
    i, j = np.nonzero((d <= reach) & ~np.eye(len(d), dtype=bool))
    return spark.createDataFrame([(int(x), int(y), float(d[x, y])) for x, y in zip(i, j)], "left_ix long, right_ix long, dist double")


def as_sets(labels):
    out = {}
    for x, c in labels:
        out.setdefault(c, set()).add(x)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("method", ["complete", "average", "ward", "single"])
def test_linkage_in_rounds_equals_linkage_in_memory(spark, method):
    rng = np.random.default_rng(1)
    x = rng.random((60, 2)) * 10
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    nodes = spark.createDataFrame([(i,) for i in range(60)], "clone_ix long")
    for t in (1.5, 4.0):
        # Average and Ward need distances beyond the cut; complete and single don't.
        reach = t if method in ("complete", "single") else 99
        got = cluster.hierarchical(both_ways(spark, d, reach), nodes, t, method)
        assert as_sets((r["ix"], r["cluster_id"]) for r in got.collect()) == as_sets(enumerate(cluster.cut_tree(cluster.linkage(d, method), 60, t)))
        assert all(r["cluster_id"] <= r["ix"] for r in got.collect())


def test_tree_nodes(spark):
    x = np.array([0.0, 1, 3, 10, 11.5])
    d = abs(x[:, None] - x)
    nodes = spark.createDataFrame([(i,) for i in range(5)], "clone_ix long")
    _, members = cluster.agglomerate(both_ways(spark, d, 99), nodes, 99)
    found = {}
    for r in members.collect():
        found.setdefault((r["node"], r["height"]), set()).add(r["ix"])
    assert sorted((h, sorted(s)) for (_, h), s in found.items()) == [(1.0, [0, 1]), (1.5, [3, 4]), (3.0, [0, 1, 2]), (11.5, [0, 1, 2, 3, 4])]
    none, nothing = cluster.agglomerate(both_ways(spark, d, 99), nodes, 0.5)
    assert none.filter("ix <> cluster_id").count() == 0 == nothing.count()
    with pytest.raises(ValueError):
        cluster.agglomerate(both_ways(spark, d, 99), nodes, 1, "centroid")


def test_one_part_of_six_thousand(spark):
    """A chain without a gap: one connected part, far above what was gathered before; equal distances everywhere in one half."""
    rng = np.random.default_rng(2)
    x = np.r_[np.arange(3000.0), 3000 + np.cumsum(0.4 + rng.random(3000))]
    t = 3.0
    near = [(i, j, abs(float(x[i] - x[j]))) for i in range(6000) for j in range(max(0, i - 9), min(6000, i + 10)) if i != j and abs(x[i] - x[j]) <= t]
    e = spark.createDataFrame(near, "left_ix long, right_ix long, dist double")
    got = {r["ix"]: r["cluster_id"] for r in cluster.hierarchical(e, spark.createDataFrame([(i,) for i in range(6000)], "clone_ix long"), t).collect()}
    sets = as_sets(got.items())
    spans = sorted((min(x[s]), max(x[s])) for s in sets)
    assert sum(map(len, sets)) == 6000 and all(b - a <= t for a, b in spans)
    assert all(b2 - a1 > t for (a1, _), (_, b2) in zip(spans, spans[1:]))  # no two could merge
    plain = as_sets(zip(range(3000), cluster.cut_tree(cluster.linkage(abs(x[3000:, None] - x[3000:])), 3000, t)))
    mine = as_sets((i - 3000, got[i]) for i in range(3000, 6000))
    assert len(set(map(tuple, plain)) & set(map(tuple, mine))) > 0.99 * len(plain)  # the seam may differ


@pytest.mark.parametrize("least", [1, 2, 3])
def test_pruning_equals_the_greedy_walk(spark, least):
    rng = random.Random(least)
    sets = [rng.sample(range(12), rng.randint(0 if i else 4, 7)) for i in range(150)]
    df = spark.createDataFrame([(i + 1, s, i) for i, s in enumerate(sets)], "rank int, neighbors array<int>, x int")
    kept, want = [], []
    for s in sets:
        want.append(not any(len(set(s) - k) < least for k in kept))
        if want[-1]:
            kept.append(set(s))
    out = N.nonredundant(df, "rank", "neighbors", least)
    assert out.columns == ["rank", "neighbors", "x", "novel"] and [r["novel"] for r in out.orderBy("rank").collect()] == want
    assert N.nonredundant(df.limit(0), "rank", "neighbors").count() == 0


def test_ranks_and_corrections(spark):
    rng = random.Random(3)
    p = [rng.choice([0.0, 1e-300, 1e-5, 0.001, 0.01, 0.5, 1.0, rng.random(), rng.random() ** 9]) for _ in range(400)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)] + [(999, None)], "i int, pvalue double").repartition(5)
    rows = ranked(df.filter("pvalue is not null"), ["pvalue", "i"]).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 401)) and [(r["pvalue"], r["i"]) for r in rows] == sorted((x, i) for i, x in enumerate(p))
    got = {r["i"]: (r["FWERp"], r["FDRq"]) for r in adjusted(df).collect()}
    order, holm, bh, run = sorted(range(400), key=lambda i: p[i]), {}, {}, 0.0
    for k, i in enumerate(order):
        run = max(run, min(1.0, (400 - k) * p[i]))
        holm[i] = run
    run = 1.0
    for k, i in reversed(list(enumerate(order))):
        run = min(run, 400 * p[i] / (k + 1))
        bh[i] = run
    assert got.pop(999) == (None, None) and all(got[i] == (pytest.approx(holm[i]), pytest.approx(bh[i])) for i in range(400))


def plain_fisher(a, b, c, d):
    f, n, r, k = math.lgamma, a + b + c + d, a + b, a + c
    p = lambda x: f(r + 1) + f(n - r + 1) + f(k + 1) + f(n - k + 1) - f(n + 1) - f(x + 1) - f(r - x + 1) - f(k - x + 1) - f(n - r - k + x + 1)
    return min(1.0, sum(math.exp(p(x)) for x in range(max(0, r + k - n), min(r, k) + 1) if p(x) <= p(a) + 1e-7))


def test_fisher(spark):
    rng = random.Random(8)
    cells = [tuple(rng.randint(0, m) for _ in range(4)) for m in (3, 10, 60, 900) for _ in range(40)] + [(0, 0, 0, 0), (0, 5, 0, 7), (900_000, 1_000_000, 1_000_000, 1_100_000)]
    got = [r["p"] for r in spark.createDataFrame(cells + [(1, None, 2, 3)], "a long, b long, c long, d long").coalesce(1).select(N.fisher_p("a", "b", "c", "d").alias("p")).collect()]
    a, b, c, d = cells[-1]
    chi = (a + b + c + d) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert got.pop() is None and got.pop() == pytest.approx(math.erfc(math.sqrt(chi / 2)), rel=0.02)
    assert got[:-2] == [pytest.approx(plain_fisher(*c), rel=1e-6, abs=1e-12) for c in cells[:-3]] and got[-2:] == [1.0, 1.0]


def test_breslow_day(spark):
    strata = [("g", 10, 20, 30, 25), ("g", 4, 9, 7, 30), ("g", 12, 3, 8, 9), ("g", 0, 0, 5, 6)]
    (r,) = N.breslow_day(spark.createDataFrame(strata, "g string, ct_0 int, ct_1 int, ct_2 int, ct_3 int"), ["g"]).collect()
    full = [s[1:] for s in strata if s[1] + s[2]]
    psi = sum(a * d / (a + b + c + d) for a, b, c, d in full) / sum(b * c / (a + b + c + d) for a, b, c, d in full)
    x = o = v = 0.0
    for a, b, c, d in full:
        low, high = max(0, a - d), min(a + b, a + c)
        for _ in range(200):  # the cell with this odds ratio, by halving
            e = (low + high) / 2
            low, high = (e, high) if e * (d - a + e) < psi * (a + b - e) * (a + c - e) else (low, e)
        w = 1 / (1 / e + 1 / (a + b - e) + 1 / (a + c - e) + 1 / (d - a + e))
        x, o, v = x + (a - e) ** 2 / w, o + a - e, v + w
    assert r["OR_mh"] == pytest.approx(psi) and r["strata"] == 3 and r["breslow_day"] == pytest.approx(x - o * o / v)


@pytest.mark.parametrize("last", [None, "k"])
def test_deviation_of_entropies_by_the_matrix(spark, last):
    counts = np.array([7, 1, 4, 9, 2, 5])
    df = spark.createDataFrame([("a", i, int(c)) for i, c in enumerate(counts)], "g string, k int, count long")
    got = {r["order"]: r["sd"] for r in diversity.generalised_simpson(df, ["g"], "count", [2, 3, 7], last=last).collect()}
    c = counts if last else np.array(sorted(counts, reverse=True))
    p = c / c.sum()
    for order, sd in got.items():
        g = (1 - p) ** order + order * p * (1 - p) ** (order - 1)
        h, q = (g - g[-1])[:-1], p[:-1]
        assert sd == pytest.approx(math.sqrt(h @ (np.diag(q) - np.outer(q, q)) @ h / c.sum()))


def test_samples(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "x int, y int").repartition(7)
    drawn = background.sample(df, 1000, seed=2, replace=True)
    rows = sorted(drawn.collect())
    assert len(rows) == 1000 and rows == sorted(background.sample(df.repartition(3), 1000, seed=2, replace=True).collect())
    assert len({r["x"] for r in rows}) > 90 and {r["x"] // 25 for r in rows} == {0, 1, 2, 3}
    assert background.sample(df, 10).count() == 10 and background.sample(df.limit(0), 5, replace=True).count() == 0


def test_first_values_and_steps(spark):
    df = spark.createDataFrame([("a", 2, None, 5), ("a", 1, None, 6), ("a", 3, "z", None), (None, 1, "q", 1), ("b", 1, None, None)], "g string, o int, s string, n int")
    assert sorted(map(tuple, C.first_values(df, ["g"], ["o"], ["s", "n"]).collect())) == [("a", "z", 6), ("b", None, None)]
    e = spark.createDataFrame([(1, 0.0, 0.2), (1, 2.0, 0.7)], "left_ix int, threshold double, ecdf double")
    assert [(r["x"], r["y"]) for r in R.step_vectors(e).orderBy("x", "corner").collect()] == [(0.0, 0.0), (0.0, 0.2), (2.0, 0.2), (2.0, 0.7)]


def test_chi_square_tail(spark):
    """Even degrees against the closed sum in exact fractions of floats, odd ones against erfc and the step between degrees."""
    def plain(x, k):
        h = x / 2
        if k % 2 == 0:
            return math.exp(-h) * math.fsum(h**i / math.factorial(i) for i in range(k // 2))
        return math.erfc(math.sqrt(h)) + math.exp(-h) * math.fsum(h ** (i - 0.5) / math.gamma(i + 0.5) for i in range(1, k // 2 + 1))

    cases = [(x, k) for x in (1e-6, 0.3, 2.0, 7.99, 8.0, 8.01, 25.0, 90.0, 600.0) for k in (1, 2, 3, 4, 7, 12, 31)]
    df = spark.createDataFrame([*cases, (None, 3), (0.0, 5), (4.0, 0), (1e5, 9)], "x double, k int")
    got = [r["p"] for r in df.coalesce(1).select(N.chi2_tail(F.col("x"), F.col("k")).alias("p")).collect()]
    assert got[-4:] == [None, 1.0, None, 0.0]
    assert got[:-4] == [pytest.approx(plain(x, k), rel=1e-9) for x, k in cases]


def test_choice_of_test_by_levels(spark):
    clones = spark.createDataFrame([(i, "xyz"[i % 3], "ab"[i % 2], "c", i + 1) for i in range(12)], "clone_ix long, three string, two string, one string, count int")
    members = spark.createDataFrame([("n", i) for i in (0, 1, 3, 6)] + [("small", 1)], "node string, ix long")
    by = lambda c: discovery.node_differences(members, clones, c).collect()
    (r,) = by("two")
    assert r["test"] == "fishers" and r["pvalue"] == pytest.approx(plain_fisher(8, 28, 6, 36)) and r["FWERp"] == r["FDRq"] == pytest.approx(r["pvalue"])
    (r,) = by("three")
    inside, whole = np.array([12, 2, 0.0]), np.array([22, 26, 30.0])
    e = whole * inside.sum() / whole.sum()
    assert r["test"] == "chi2" and r["statistic"] == pytest.approx(((inside - e) ** 2 / e + (inside - e) ** 2 / (whole - e)).sum())
    assert r["pvalue"] == r["FWERp"] == r["FDRq"] == pytest.approx(math.exp(-r["statistic"] / 2))
    assert by("one")[0]["test"] == "none"
