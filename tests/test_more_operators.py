"""Quartiles without gathering, draws by sorted ranges, tallies of several traits, changed codes, unknown genes, all against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloneframe.functions import sequences as S
from cloneframe.operators import clones as C, diversity, neighbors as N


def test_five_numbers(spark):
    rng = random.Random(2)
    rows = [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 9)) for _ in range(301)] + [("ties", float(rng.choice([1, 1, 1, 2, 0, -3]))) for _ in range(200)]
    rows += [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None), ("two", None), (None, 5.0), (None, 7.0)]
    got = {r["g"]: [r[c] for c in ("q0", "q25", "q50", "q75", "q100")] for r in N.five_numbers(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v").collect()}
    groups = defaultdict(list)
    for g, v in rows:
        groups[g] += [v] if v is not None else []
    assert set(got) == set(groups) and got["none"] == [None] * 5
    for g, v in groups.items():
        if v:
            assert got[g] == pytest.approx(np.quantile(v, [0, 0.25, 0.5, 0.75, 1], method="midpoint").tolist(), rel=1e-12), g
    plan = N.five_numbers(spark.createDataFrame(rows, "g string, v double"), ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_draws_follow_counts(spark):
    """One clone has most of all counts; two strings are near only if equal."""
    counts = [5000, 300, 1, 0, 299]
    clones = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "clone_ix long, count long")
    none = spark.createDataFrame([], "left_ix long, right_ix long, dist double")
    p = np.array(counts) / sum(counts)
    got = [diversity.fuzzy_sampled(none, clones.repartition(k), "count", 1, 3, 20_000).first()["fuzzy"] for k in (1, 4)]
    assert got[0] == got[1] == pytest.approx(1 - (p**3).sum(), abs=0.01)
    assert diversity.fuzzy_sampled(none, clones.filter("count = 0"), "count", 1, 3, 10).first()["fuzzy"] is None


@pytest.mark.parametrize("stratum", [None, "s"])
def test_tallies(spark, stratum):
    rng = random.Random(7)
    clones = [(i, rng.choice(["x", "y", "z", None]), rng.choice([1, 2]), rng.choice(["p", "q", "r"]), rng.randint(1, 9)) for i in range(40)]
    edges = [(i, rng.randrange(40), 1.0) for i in range(12) for _ in range(4)]
    edges = list({(a, b): (a, b, d) for a, b, d in edges}.values())
    df = N.tallies(spark.createDataFrame(edges, "left_ix long, right_ix long, dist double"), spark.createDataFrame(clones, "clone_ix long, t string, u int, s string, count long"), ["t", "u"], stratum=stratum)
    got = sorted(tuple(map(str, r)) for r in df.collect())
    want = []
    for centre in {a for a, *_ in edges}:
        near = {b for a, b, _ in edges if a == centre}
        for k, trait in ((1, "t"), (2, "u")):
            known = [c for c in clones if c[k] is not None]
            for level in {c[k] for c in known if c[0] in near}:
                for s in sorted({c[3] for c in known if c[0] in near}) if stratum else [None]:
                    own = [c for c in known if s is None or c[3] == s]
                    cell = lambda has, inside: sum(c[4] for c in own if (c[k] == level) == has and (c[0] in near) == inside)
                    want.append((centre, trait, level, *([s] if stratum else []), cell(False, True), cell(False, False), cell(True, True), cell(True, False)))
    assert got == sorted(tuple(map(str, r)) for r in want)


def test_changed_code(spark):
    code = S.changed_code({"TGA": "W", "AGA": "*"})
    df = spark.createDataFrame([("TGAAGATTT",), ("TGRxx",), (None,)], "s string")
    assert [r[0] for r in df.coalesce(1).select(S.translated(F.col("s"), 1, code)).collect()] == ["W*F", "W", None]
    assert df.coalesce(1).select(S.translated(F.col("s"))).first()[0] == "*RF"
    with pytest.raises(ValueError):
        S.changed_code({"TGX": "W"})


def test_unknown_genes(spark):
    clones = spark.createDataFrame([("TRBV1*01",), ("TRBV1*01",), ("TRBV9*01",), (None,)], "v_b_gene string")
    genes = spark.createDataFrame([("TRBV1*01", "mouse", "B", "V"), ("TRBV9*01", "human", "B", "V")], "id string, organism string, chain string, region string")
    assert [tuple(r) for r in C.unknown_genes(clones, genes, "beta", "human").collect()] == [("TRBV1*01", 2)]
