import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloneframe.functions import metrics as M
from cloneframe.operators.ranks import adjusted
from cloneframe.operators import background, cluster, diversity, motifs
from cloneframe.operators import clones as C
from cloneframe.operators import edges as E
from cloneframe.operators import neighbors as N
from cloneframe.operators import radii as R

SPEC = M.MetricSpec((("cdr3_b_aa", M.Tcr(), 3), ("cdr1_b_aa", M.Tcr(0, 0, True), 1)))


@pytest.fixture(scope="module")
def clones(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        base = rng.choice(["CASSLDRGEVFF", "CASSPGQGYEQYF", "CASSIRSSYEQYF", "CSARDF"])
        s = list(base)
        for _ in range(rng.randint(0, 3)):
            s[rng.randrange(3, len(s))] = rng.choice("ACDEFGHIKLMNPQRSTVWY")
        rows.append((i, "".join(s), rng.choice(["SGHNS", "MNHEY", "SGHRS"]), f"TRBV{i % 3}", rng.randint(1, 9), f"s{i % 7}"))
    return spark.createDataFrame(rows, "clone_ix long, cdr3_b_aa string, cdr1_b_aa string, v_b_gene string, count long, subject string")


def brute(rows, radius):
    tcr, loop = M.Tcr(), M.Tcr(0, 0, True)
    out = {}
    for a, b in itertools.product(rows, rows):
        d = 3 * tcr.block([a["cdr3_b_aa"]], [b["cdr3_b_aa"]])[0, 0] + loop.block([a["cdr1_b_aa"]], [b["cdr1_b_aa"]])[0, 0]
        if d <= radius:
            out[a["clone_ix"], b["clone_ix"]] = float(d)
    return out


def as_dict(edges):
    return {(r["left_ix"], r["right_ix"]): r["dist"] for r in edges.collect()}


def test_radius_join_is_brute_force(spark, clones, monkeypatch):
    rows = clones.collect()
    want = brute(rows, 30)
    assert as_dict(E.radius_join(clones, clones, SPEC, 30)) == want
    monkeypatch.setattr(E, "BLOCK", 7)
    assert as_dict(E.radius_join(clones, clones, SPEC, 30)) == want
    native = E.native_join(clones.withColumn("one", F.lit(1)), clones.withColumn("one", F.lit(1)), SPEC, 30, ["one"])
    assert as_dict(native) == want
    # A larger radius keeps all edges; parts add up.
    more = as_dict(E.radius_join(clones, clones, SPEC, 60))
    assert set(want) <= set(more)
    for r in E.radius_join(clones, clones, SPEC, 30, parts=True).collect():
        assert r["dist"] == 3 * r["dist_cdr3_b_aa"] + r["dist_cdr1_b_aa"]


def test_other_metrics_join(spark, clones):
    a = E.radius_join(clones, clones, M.MetricSpec((("cdr3_b_aa", M.Edit(), 1),)), 2)
    b = E.radius_join(clones, clones, M.MetricSpec((("cdr3_b_aa", M.Custom(M.edit_distance), 1),)), 2)
    assert as_dict(a) == as_dict(b)


def edges_of(spark, triples):
    return spark.createDataFrame(triples, "left_ix long, right_ix long, dist double")


def test_neighbour_lists(spark):
    m = [[0, 0, 1, 4], [1, 0, 0, 2], [0, 10, 0, 3], [0, 0, 2, 0]]
    kept = [(i, j, float(m[i][j])) for i in range(4) for j in range(4) if i == j or m[i][j]]
    e = edges_of(spark, kept)
    lists = lambda x: {r["left_ix"]: r["neighbors"] for r in E.neighbor_lists(x).collect()}
    assert lists(E.within(e, radius=4)) == {0: [0, 2, 3], 1: [0, 1, 3], 2: [2, 3], 3: [2, 3]}
    left = spark.createDataFrame([(0, 1), (1, 1), (2, 20), (3, 1)], "clone_ix long, radius int")
    assert lists(E.within(e, left)) == {0: [0, 2], 1: [0, 1], 2: [1, 2, 3], 3: [3]}


def test_join_kinds(spark):
    left = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "clone_ix long, x string")
    right = spark.createDataFrame([(0, "p"), (1, "q"), (2, "r")], "clone_ix long, y string")
    e = edges_of(spark, [(0, 0, 0.0), (0, 1, 0.0), (0, 2, 5.0), (1, 1, 2.0)])
    rows = lambda how, **k: sorted((r["x_x"] or "", r["y_y"] or "", r["dist"]) for r in E.join_by_distance(e, left, right, how, **k).collect())
    assert rows("inner", max_n=1) == [("a", "p", 0.0), ("b", "q", 2.0)]
    assert [r[:2] for r in rows("left", max_n=2)] == [("a", "p"), ("a", "q"), ("b", "q"), ("c", "")]
    assert [r[:2] for r in rows("outer", max_n=2)] == [("", "r"), ("a", "p"), ("a", "q"), ("b", "q"), ("c", "")]
    assert [r[:2] for r in rows("inner", radius=1)] == [("a", "p"), ("a", "q")]
    with pytest.raises(ValueError):
        rows("cross")


def test_medoids_and_edge_sums(spark):
    e = edges_of(spark, [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0), (0, 2, 5.0), (2, 0, 5.0), (3, 4, 1.0), (4, 3, 1.0)])
    groups = spark.createDataFrame([(0, 7), (1, 7), (2, 7), (3, 8), (4, 8)], "clone_ix long, cluster_id int")
    assert {r["cluster_id"]: r["medoid"] for r in E.medoids(e, groups).collect()} == {7: 1, 8: 3}
    assert as_dict(E.add_edges(e, edges_of(spark, [(0, 1, 2.0)]))) == {(0, 1): 3.0}


def test_dedup_and_ids(spark):
    cells = spark.createDataFrame([("v1", "j", "A", 1), ("v1", "j", "A", 2), ("v0", "j", "B", 5), (None, "j", "C", 9)], "v string, j string, cdr3 string, count int")
    got = [(r["clone_id"], r["cdr3"], r["count"]) for r in C.deduplicate(cells).orderBy("clone_id").collect()]
    assert got == [(1, "B", 5), (2, "A", 3)]
    assert C.incomplete(cells).count() == 1
    assert C.deduplicate(cells.drop("count")).agg(F.sum("count")).first()[0] == 3
    floats = C.deduplicate(cells.withColumn("count", F.col("count") / 10))
    assert floats.schema["count"].dataType.typeName() == "double"
    assert C.deduplicate(cells.limit(0)).count() == 0


def test_query_text():
    assert C.sql_of_query("qpublic == True & K > 1") == "qpublic = true  AND  K > 1"
    assert C.sql_of_query("x == 'a & b' | ~ok") == "x = 'a & b'  OR   NOT ok"


def test_repertoire(spark):
    genes = spark.createDataFrame([("TRBV1*01", "human", "B", "V", "ABCDEFGHIJ", "1-3;4-6;7-9")], "id string, organism string, chain string, region string, aligned_protseq string, cdr_columns string")
    cells = spark.createDataFrame([("CASSF", "TRBV1*01", 1), ("CASSF", "TRBV1*01", 1), ("CAXF", "TRBV9*01", 1)], "cdr3_b_aa string, v_b_gene string, count int")
    r = C.Repertoire.from_cells(cells, "human", ["beta"], genes)
    row = r.clones.collect()
    assert len(row) == 1 and row[0]["cdr1_b_aa"] == "ABC" and row[0]["pmhc_b_aa"] == "GHI" and row[0]["count"] == 2
    assert as_dict(r.edges("beta")) == {(1, 1): 0.0}
    with pytest.raises(ValueError):
        C.Repertoire.from_cells(cells, "cat", ["beta"])
    with pytest.raises(ValueError):
        C.Repertoire.from_cells(cells, "human", ["epsilon"])
    with pytest.raises(ValueError):
        C.Repertoire.from_cells(cells.drop("v_b_gene"), "human", ["beta"])


def test_tests(spark):
    df = spark.createDataFrame([(10, 100, 10, 1000)], "ct_0 int, ct_1 int, ct_2 int, ct_3 int")
    assert df.select(N.odds_ratio().alias("x")).first()["x"] == 10.0
    assert df.select(N.odds_ratio(pseudo=1.0).alias("x")).first()["x"] == pytest.approx(11 * 1001 / (101 * 11))

    def brute_fisher(a, b, c, d):
        n, row, col = a + b + c + d, a + b, a + c
        p = {x: math.comb(row, x) * math.comb(n - row, col - x) / math.comb(n, col) for x in range(max(0, row + col - n), min(row, col) + 1)}
        return sum(v for v in p.values() if v <= p[a] * (1 + 1e-7))

    tables = [(3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 5, 0), (7, 0, 2, 9), (1, 1, 1, 1)]
    t = spark.createDataFrame(tables, df.schema).withColumn("pvalue", N.fisher_p("ct_0", "ct_1", "ct_2", "ct_3"))
    for r in adjusted(t).collect():
        assert r["pvalue"] == pytest.approx(brute_fisher(*r[:4]))
        assert r["pvalue"] <= r["FDRq"] + 1e-9 <= r["FWERp"] + 2e-9 <= 1 + 3e-9
    chi = spark.createDataFrame([(10, 20, 30, 5)], df.schema).withColumn("x", N.chi2()).withColumn("p", N.chi2_p("x")).first()
    e = [30 * 40 / 65, 30 * 25 / 65, 35 * 40 / 65, 35 * 25 / 65]
    assert chi["x"] == pytest.approx(sum((abs(o - x) - 0.5) ** 2 / x for o, x in zip((10, 20, 30, 5), e)))
    assert 0 < chi["p"] < 0.001


def test_pruning(spark):
    rows = [(i, list(s)) for i, s in enumerate(["ABC", "ACD", "AD", "BE", "BC"])]
    ranked = spark.createDataFrame(rows, "rank int, neighbors array<string>")
    assert [r["novel"] for r in N.nonredundant(ranked, "rank", "neighbors").orderBy("rank").collect()] == [True, True, False, True, False]
    assert [r["novel"] for r in N.nonredundant(ranked, "rank", "neighbors", 2).orderBy("rank").collect()] == [True, False, False, False, False]


def test_ecdf(spark):
    left = spark.createDataFrame([(0,), (1,)], "clone_ix long")
    w = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 1.0)], "clone_ix long, weight double")
    e = edges_of(spark, [(0, 0, 0.0), (0, 1, 2.0), (0, 2, 4.0), (1, 1, 0.0)])
    got = lambda **k: {(r["left_ix"], r["threshold"]): r["ecdf"] for r in R.distance_ecdf(e, left, w, **k).collect()}
    assert got(thresholds=[0, 2, 5]) == {(0, 0): 0.25, (0, 2): 0.75, (0, 5): 1.0, (1, 0): 0.5, (1, 2): 0.5, (1, 5): 0.5}
    assert got() == {(0, 0): 0.25, (0, 2): 0.75, (0, 4): 1.0, (1, 0): 0.5}
    assert got(thresholds=[2], absolute=True, pseudo_count=1)[0, 2] == 1.0
    assert got(thresholds=[2], skip_self=True)[0, 2] == pytest.approx(2 / 3)
    assert {r["left_ix"]: r["radius"] for r in R.radii(R.distance_ecdf(e, left, w, [0, 2, 5]), 0.5).collect()} == {0: 0.0, 1: 5.0}


def test_breadth(spark):
    long = spark.createDataFrame([("k1", "x", "t1", 0.0, 3, True), ("k2", "x", "t1", 2.0, 3, True), ("k1", "y", "t1", 1.0, 1, False)], "feature_key string, clone string, tag string, dist double, count_hit int, MOTIF boolean")
    (r,) = R.breadth_and_depth(long, 100, 8, None, ["clone"]).collect()
    assert r["breadth"] == 0.02 and r["depth"] == pytest.approx(math.log2(4) + math.log2(2) - 3) and r["SE"] == pytest.approx(0.02 * math.sqrt(0.01 + 0.5))
    assert R.breadth_and_depth(long, 100, 8, ["tag"], ["clone"], motif=True).first()["n_clones"] == 1
    assert R.breadth_and_depth(long, 100, 8, ["tag"], ["clone"], exact=True).first()["n_clones"] == 1


def test_diversity(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate((5, 3, 1, 1))], "g string, k int, count long")
    z = {r["order"]: r for r in diversity.generalised_simpson(df, ["g"], "count", [2, 3]).collect()}
    n = 10
    for order in (2, 3):
        want = sum(c / n * np.prod([1 - (c - 1) / (n - k) for k in range(1, order)]) for c in (5, 3, 1, 1))
        assert z[order]["Z"] == pytest.approx(want) and z[order]["lower"] < want < z[order]["upper"]
    assert z[2]["Z"] == pytest.approx(1 - sum(c * (c - 1) for c in (5, 3, 1, 1)) / (n * (n - 1)))
    assert diversity.simpson(df, ["g"], "count").first()["simpson"] == pytest.approx(1 - 36 / 100)
    clones = df.select(F.col("k").cast("long").alias("clone_ix"), "count")
    e = edges_of(spark, [(0, 0, 0.0), (0, 1, 5.0), (1, 0, 5.0), (2, 3, 50.0), (3, 2, 50.0)])
    assert diversity.fuzzy_diversity(e, clones, "count", 10).first()["fuzzy"] == pytest.approx(1 - 15 / 100)
    full = e.union(edges_of(spark, [(i, i, 0.0) for i in (1, 2, 3)]))
    near = sum(a * b for i, a in enumerate((5, 3, 1, 1)) for j, b in enumerate((5, 3, 1, 1)) if i == j or {i, j} == {0, 1}) / 100
    assert diversity.fuzzy_sampled(full, clones, "count", 10, 2, 4000).first()["fuzzy"] == pytest.approx(1 - near, abs=0.04)


def test_linkage():
    x = np.array([0.0, 1, 3, 10, 11.5])
    d = abs(x[:, None] - x)
    assert [round(h, 6) for h in cluster.linkage(d)[:, 2]] == [1, 1.5, 3, 11.5]
    assert [round(h, 6) for h in cluster.linkage(d, "single")[:, 2]] == [1, 1.5, 2, 7]
    assert cluster.linkage(d, "ward")[0, 2] == 1 and len(set(cluster.cut_tree(cluster.linkage(d), 5, 3))) == 2


def test_clusters_of_parts(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "clone_ix long")
    near = [(0, 1, 1.0), (1, 2, 2.0), (3, 4, 1.0)]
    e = edges_of(spark, near + [(b, a, d) for a, b, d in near])
    got = {r["ix"]: r["cluster_id"] for r in cluster.hierarchical(e, nodes, 2).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5}
    sizes = [(r["size"], r["members"]) for r in cluster.clusters_of(spark.createDataFrame(list(got.items()), "ix long, cluster_id long")).orderBy("rank").collect()]
    assert sizes[0] == (2, [0, 1]) and len(sizes) == 4


def test_patterns(spark):
    pairs = spark.createDataFrame([(1, "CASSGADFF", "CASSGADFF"), (1, "CASSGADFF", "CASSGQDFF"), (1, "CASSGADFF", "CASSGDFF")], "g int, c string, m string")
    letters = motifs.aligned_letters(pairs, "g", "c", "m")
    assert motifs.patterns(letters, "g", 4, 2).first()["regex"] == "(G[AQ]?D)"
    f = motifs.frequencies(letters, "g").filter("place = 4").collect()
    assert [(r["letter"], r["frequency"]) for r in f] == [("G", 1.0)]


_T = background.Recombination.trimmed
MODEL = background.Recombination(
    v={"V1*01": _T("TGTGCCAGC", right=[0.4, 0.3, 0.2, 0.1], palindrome=1), "V2*01": _T("TGTGCA", right=[0.5, 0.3, 0.2])},
    d={"D1*01": _T("GGGAC", [0.5, 0.3, 0.2], [0.6, 0.4], 1)}, j={"J1*01": _T("GAGCAGTTC", left=[0.6, 0.4]), "J2*01": _T("TTT", left=[0.7, 0.3])},
    p_v={"V1*01": 0.6, "V2*01": 0.4}, p_dj={("D1*01", "J1*01"): 0.7, ("D1*01", "J2*01"): 0.3}, p_insert_vd=[0.5, 0.3, 0.2], p_insert_dj=[0.6, 0.3, 0.1],
    markov_vd=[[0.4, 0.3, 0.2, 0.1], [0.1, 0.4, 0.3, 0.2], [0.25] * 4, [0.3, 0.2, 0.1, 0.4]], markov_dj=[[0.1, 0.2, 0.3, 0.4], [0.25] * 4, [0.7, 0.1, 0.1, 0.1], [0.2, 0.3, 0.4, 0.1]],
)


def test_trims_with_palindromes():
    assert dict(_T("ACG", right=[0.5, 0.5], palindrome=1)) == {"ACGC": 0.5, "ACG": 0.5}
    assert dict(_T("ACG", left=[0.5, 0.25, 0.25], palindrome=2)) == {"GTACG": 0.5, "TACG": 0.25, "ACG": 0.25}


def test_generation_probability_is_the_sum_of_events():
    """All events of the model, spelled out one by one."""
    want: dict[str, float] = {}

    def inserts(p, chain, reverse):
        first = MODEL.first(chain)
        for n, q in enumerate(p):
            for w in itertools.product(range(4), repeat=n):
                r = q
                for k, b in enumerate(w):
                    r *= first[b] if k == 0 else chain[w[k - 1]][b]
                yield "".join("ACGT"[b] for b in (w[::-1] if reverse else w)), r

    one, two = list(inserts(MODEL.p_insert_vd, MODEL.markov_vd, False)), list(inserts(MODEL.p_insert_dj, MODEL.markov_dj, True))
    for (v, pv), ((d, j), pdj) in itertools.product(MODEL.p_v.items(), MODEL.p_dj.items()):
        for (a, pa), (b, pb), (c, pc), (x, px), (y, py) in itertools.product(MODEL.v[v], MODEL.d[d], MODEL.j[j], one, two):
            nt = a + x + b + y + c
            if len(nt) % 3 == 0:
                aa = background.residues(nt)
                want[aa] = want.get(aa, 0.0) + pv * pdj * pa * pb * pc * px * py
    for aa in random.Random(1).sample(sorted(k for k in want if "*" not in k and k), 25):
        assert background.generation_probability(aa, MODEL) == pytest.approx(want[aa], rel=1e-9), aa
        split = [background.generation_probability(aa, MODEL, v, j) for v in MODEL.p_v for j in MODEL.j]
        assert sum(split) == pytest.approx(want[aa], rel=1e-9)
    assert background.generation_probability("CAXF", MODEL) == 0.0 == background.generation_probability("", MODEL)


def test_backgrounds(spark):
    usage = spark.createDataFrame([("V1*01", "J1*01", 3), ("V2*01", "J2*01", 1)], "v_reps string, j_reps string, n long")
    made = background.matched_background(usage, MODEL, 40)
    again = background.matched_background(usage, MODEL, 40)
    rows = sorted(made.collect())
    assert rows == sorted(again.collect()) and 1 <= len(rows) <= 40
    assert all(r["cdr3"][0] == "C" and r["cdr3"][-1] in "FVW" and "*" not in r["cdr3"] for r in rows)
    assert background.generate(usage.withColumn("v_reps", F.lit("V9")), MODEL).count() == 0
    ref = spark.createDataFrame([(f"V{i % 2}", f"J{i % 3}", f"C{i}F", f"s{i % 5}") for i in range(60)], "v_reps string, j_reps string, cdr3 string, subject string")
    flat = background.flat_background(ref, 30)
    assert {r["count"] for r in flat.groupBy("v_reps", "j_reps").count().collect()} == {5}
    tables = C.stratified_usage(ref)
    assert all(t.agg(F.sum(t.columns[-1])).first()[0] == pytest.approx(1) for t in tables.values())
    assert background.subject_sample(ref, 20).groupBy("subject").count().agg(F.max("count")).first()[0] == 4
    p = background.with_generation_probability(spark.createDataFrame([("CASF",), (None,)], "cdr3 string"), MODEL, "cdr3").collect()
    assert {r["cdr3"]: r["pgen"] for r in p}[None] is None
