"""The stand-in tables go over the lines once, and say the same as the plain joins."""

import random

from pyspark.sql import functions as F

from cloneframe.functions import sequences as S
from cloneframe.operators import clones as C, neighbors as N
from cloneframe.plans import queries as Q, testbed as T

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def read_by(df):
    return {f.split("/")[-1] for f in df.inputFiles()} | {f.split("/")[-2] for f in df.inputFiles()}


def test_clones_are_made_once(spark):
    """A query that reads its clones n times must not join all lines n times."""
    c = T.clones(spark, SF)
    target, bulk = T.target_and_bulk(spark, SF)
    for df in (c, target, bulk):
        assert "lineitem.parquet" not in read_by(df)
    plain = T.cells(spark, SF).dropna(subset=T.KEYS)
    for df, where in ((c, "true"), (target, "flag = 'R'"), (bulk, "flag <> 'R'")):
        own = plain.filter(where).groupBy(*T.KEYS).agg(F.sum("count").alias("count"))
        assert rows(df.select(*T.KEYS, "count")) == rows(own)
        assert [tuple(r) for r in df.orderBy("clone_id").select(*T.KEYS).collect()] == [r[:4] for r in rows(own)]
        assert [r[0] for r in df.orderBy("clone_id").select("clone_id").collect()] == list(range(1, own.count() + 1))


def test_growing_tables_are_not_broadcast(spark):
    """Files of parts are far smaller than their rows: a plan must not send them through the driver."""
    assert "BroadcastExchange" not in T.cells(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_carriers(spark):
    c = T.clones(spark, SF)
    who = T.carriers(spark, SF, c)
    assert not {"lineitem.parquet", "orders.parquet"} & read_by(who)
    assert rows(who) == rows(T.cells(spark, SF).join(c, T.KEYS).select("clone_id", "subject").distinct())


def test_numbers_and_usage_read_their_input_once(spark):
    cells = T.cells(spark, SF)
    assert "lineitem.parquet" not in read_by(C.deduplicate(cells.select(*T.KEYS, "count"), T.KEYS))
    assert "lineitem.parquet" not in read_by(C.stratified_usage(cells, "v_b_gene", "j_b_gene")["vj"])
    assert "lineitem.parquet" not in read_by(N.pair_associations(cells, "epitope", "j_b_gene", "count"))


def test_queries_of_clones_do_not_read_lines(spark):
    for name in ("dst13_sparse_add", "pub01_quasi_public", "rad04_rank"):
        assert not {"lineitem.parquet", "orders.parquet"} & read_by(Q.QUERIES[name](spark, SF)), name


def test_codons_by_number(spark):
    """All frames against a plain reading of the table, with ambiguous, gap, unknown, wide and no letters."""
    rng = random.Random(3)
    texts = ["", "A", "AT", "acgtnn", None, "ATGß##", "A\nGTTT", "ééé😀AC"] + ["".join(rng.choices("ACGTRYSWKMN#.xacgt", weights=[9] * 4 + [2] * 7 + [1, 1, 1] + [3] * 4, k=rng.randint(0, 40))) for _ in range(200)]
    table = S.codon_table()

    def plain(s, frame):
        if s is None or (frame < 0 and set(s) - set("acgtnACGTNRYSWKM.")):
            return None
        s = (s if frame > 0 else s[::-1].translate(str.maketrans(S._BASES, S._COMPLEMENTS))).upper()[abs(frame) - 1 :]
        return "".join("#" if "#" in c else table.get(c, "X") for c in (s[i : i + 3] for i in range(0, len(s) - 2, 3)))

    df = spark.createDataFrame([(t,) for t in texts], "s string")
    frames = (1, 2, 3, -1, -2, -3)
    for r in df.select("s", *(S.translated("s", f).alias(str(f)) for f in frames)).collect():
        assert [r[str(f)] for f in frames] == [plain(r["s"], f) for f in frames], r["s"]


def test_translations_are_made_once_and_spread(spark):
    """Two milliseconds a part, in one task, before: a gene table's checks made its columns anew, and a small file is one task."""
    assert "part.parquet" not in read_by(Q.QUERIES["src09_germline_genes"](spark, SF))
    assert "Exchange hashpartitioning(p_partkey" in Q.QUERIES["scal08_frames"](spark, SF)._jdf.queryExecution().executedPlan().toString()
