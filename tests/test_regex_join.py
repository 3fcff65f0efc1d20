"""The pruning regex join against every pattern tried on every string."""

import random
import re

from pyspark.sql import functions as F

from cloneframe.operators import regex_join as J

from .test_scale import cdr3s


def pattern_of(rng, s):
    """A pattern as discovery makes them, of a string without its ends."""
    out = []
    for c in s[3:-2]:
        kind = rng.random()
        part = c if kind < 0.5 else f"[{''.join(sorted({c, *rng.choices('ACDEFGHIKLMN', k=2)}))}]" if kind < 0.8 else "."
        out.append(part + ("?" if rng.random() < 0.1 else ""))
    return f"({''.join(out)})"


ODD = ["", "^CASS", "EQYF$", "^C.*F$", "(A|G)Q", "Q{2}", "a", "[^A]QQ", "(C[ACDEFGHIKLM]S)", ".", "^$", "(.?.?)", "CA?S", "C-S", "(LGQ)", r"\QCASS\E"]


def test_hits_equal_all_pairs_and_few_are_tried(spark):
    rng = random.Random(6)
    strings = sorted({*cdr3s(rng, 1500)})
    pats = [pattern_of(rng, s) for s in rng.sample(strings, 200)]
    rows = [(s, i) for i, s in enumerate(strings + strings[:5] + ["", "C", "ca", None])]
    df = spark.createDataFrame(rows, "s string, i int").repartition(3)
    ps = spark.createDataFrame([(p, k) for k, p in enumerate(pats + ODD + [None, pats[0]])], "p string, k int")
    got = {(r["i"], r["k"]) for r in J.regex_hits(df, ps, "s", "p").collect()}
    want = {(i, k) for s, i in rows if s is not None for k, p in enumerate(pats + ODD + [None, pats[0]]) if p is not None and re.search(p.replace(r"\Q", "").replace(r"\E", ""), s)}
    assert got == want
    s, p = df.select("s").dropna().distinct(), spark.createDataFrame([(x,) for x in set(pats)], "p string")
    tried = J.regex_candidates(s, p, "s", "p")
    hits = tried.filter(F.expr("s rlike p")).count()
    assert hits <= tried.count() < 0.1 * len(set(pats)) * len(strings)


def test_empty_sides(spark):
    df = spark.createDataFrame([("CASS", 1)], "s string, i int")
    ps = spark.createDataFrame([("CA", 1)], "p string, k int")
    assert J.regex_hits(df.limit(0), ps, "s", "p").count() == 0 == J.regex_hits(df, ps.limit(0), "s", "p").count()
    assert J.regex_hits(df, ps, "s", "p").columns == ["p", "s", "i", "k"]
