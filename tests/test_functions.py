import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloneframe.functions import metrics as M
from cloneframe.functions import sequences as S
from cloneframe.operators.radii import safe_block


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) and v and isinstance(v[0], str) else 'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_sequences(spark):
    assert one(spark, S.reverse_complement("s"), s="ATGC") == "GCAT"
    assert one(spark, S.reverse_complement("s"), s="AT.GC") == "GC.AT"
    assert one(spark, S.reverse_complement("s"), s="ATXX") is None
    assert one(spark, S.translated("s"), s="tgtgccagcagttaa") == "CASS*"
    assert one(spark, S.translated("s", 2), s="atgtgccagc") == "CAS"
    assert one(spark, S.translated("s"), s="TTYTTNGTN###") == "FXV#"
    assert one(spark, S.translated("s", -1), s="GCAC") == "V"
    assert one(spark, S.valid_cdr3("s"), s="CASSF") and one(spark, S.valid_cdr3("s"), s="") and not one(spark, S.valid_cdr3("s"), s="CASX*")
    assert one(spark, S.allele_01("s"), s="TRBV30*02") == "TRBV30*01"
    with pytest.raises(ValueError):
        S.translated("s", 4)


def test_loops_of_an_alignment(spark):
    aligned = "....TSG......FNG...VVL....DGL"
    got = one(spark, S.cdrs_of("s", F.lit("5-16;20-29")), s=aligned)
    assert got == ["TSG......FNG", "VVL....DGL"]
    assert one(spark, S.cdrs_of("s", F.lit("5-16;20-29"), False), s=aligned) == ["TSGFNG", "VVLDGL"]


def test_summaries(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1), ("b", 100), ("c", 3)], "k string, n int")
    from cloneframe.operators.neighbors import top_n_string

    all_rows = df.withColumn("g", F.lit(1))
    assert top_n_string(all_rows, ["g"], "k", F.col("n"), 2, "s").first()["s"] == "b (88.6%), a (8.8%)"
    assert top_n_string(all_rows, ["g"], "k", F.lit(1), 1, "s").first()["s"] == "b (50.0%)"
    assert one(spark, S.extract_percentage("s", "a"), s="b (88.6%), a (8.8%)") == 8.8
    assert one(spark, S.extract_percentage("s", "z"), s="b (88.6%)") == 0.0
    assert [one(spark, S.midpoint_quantile("a", q), a=[5.0, 1.0, 2.0, 3.0, 4.0]) for q in (0.0, 0.25, 0.5, 0.75, 1.0)] == [1, 2, 3, 4, 5]
    assert one(spark, S.midpoint_quantile("a", 0.25), a=[1.0, 2.0, 3.0, 4.0]) == 1.5


@pytest.mark.parametrize("letters,want", [(["A"], "A"), (["A", "T", "C"], "[ATC]"), (["A", "T", "C", "G"], "."), (["A", "C", "-"], "[AC]?"), (["-"], ".?")])
def test_regex_components(spark, letters, want):
    assert one(spark, S.regex_component("a"), a=letters) == want


def words(n, low=0, high=16):
    rng = random.Random(n)
    return ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY.") for _ in range(rng.randint(low, high))) for _ in range(n)]


@pytest.mark.parametrize("metric", [M.Tcr(), M.Tcr(0, 0, True), M.Tcr(2, 2, True, 6, 2), M.Tcr(0, 0, False)])
def test_native_and_block_agree(spark, metric):
    s = sorted(set(words(45) + ["", "C", "CASSF", "CASSLF"]))
    pairs = spark.createDataFrame([(a, b) for a in s for b in s], "a string, b string")
    got = {(r["a"], r["b"]): r["d"] for r in pairs.withColumn("d", metric.column(F.col("a"), F.col("b"))).collect()}
    block = metric.block(s, s)
    assert all(got[a, b] == block[i, j] for i, a in enumerate(s) for j, b in enumerate(s))
    assert (block == block.T).all() and (np.diag(block) == 0).all() and (block >= 0).all()


def test_tcr_by_hand():
    d = M.Tcr().block(["CASSIGQFF", "CASSLGGQFF"], ["CASSVGQFF", "CASSLGQFF"])
    assert d[0].tolist() == [1, 2]  # I-V and I-L after three letters and before two
    assert d[1, 1] == 4  # one gap, best place


def test_alignment_metrics():
    s = ["CASSLDRGEVFF", "CASSLDRGEVFF", "CASSLDAGEVFF", "CASSLRGEVFF"]
    assert M.Aligned().block(s, s).tolist() == [[0, 0, 1, 1], [0, 0, 1, 1], [1, 1, 0, 2], [1, 1, 2, 0]]
    d = M.Aligned(False).block(s, s)
    assert (np.diag(d) == 0).all() and (d == d.T).all() and d[0, 2] > 0


def test_edit_distance():
    assert M.edit_distance("kitten", "sitting") == 3 and M.edit_distance("", "ab") == 2


def test_spec_checks(spark):
    with pytest.raises(ValueError):
        M.MetricSpec(())
    with pytest.raises(ValueError):
        M.MetricSpec((("a", M.Custom(lambda a, b: 0), 1),)).column(F.col, F.col)
    assert M.default_spec().length_cost() == 12 and len(M.default_spec().parts) == 4
    assert safe_block(10, 10) == 10 and safe_block(100_000, 100_000) == 100
