import datetime

import pytest
from pyspark.sql import functions as F

from cloneframe.functions.metrics import Custom, Edit, MetricSpec
from cloneframe.operators.clones import Repertoire
from cloneframe.sources import readers, writers
from cloneframe.sources.mappings import MAPPINGS
from cloneframe.streaming.search import hit_counts, search_stream

GENES = [("TRBV1*01", "human", "B", "V"), ("TRBJ1*01", "human", "B", "J")]


def test_delimited(spark, tmp_path):
    path = str(tmp_path / "x.tsv")
    (tmp_path / "x.tsv").write_text('a\tb-1\tc\n1\t"x,y"\tz\n2\t\tw\n')
    assert readers.detect_separator(spark, path, ["a", "b-1"]) == "\t"
    rows = readers.read_delimited(spark, path, "\t", ["b-1", "a"]).collect()
    assert [tuple(r) for r in rows] == [("x,y", "1"), (None, "2")]
    with pytest.raises(ValueError):
        readers.detect_separator(spark, path, ["nope"])
    with pytest.raises(KeyError):
        readers.rename(spark.createDataFrame([(1,)], "a int"), {"b": "c"})


def test_immunoseq(spark):
    names = spark.createDataFrame([("TCRBV30", "TRBV30*01", "human"), ("TCRBJ1", None, "human"), ("TCRBV30", "m", "mouse")], "adaptive string, imgt string, species string")
    df = spark.createDataFrame([("CASSF+TCRBV30+TCRBJ1", "0.5", "3"), ("CA*F+TCRBV30+TCRBJ1", "0.1", "1"), ("CASSW+TCRBVX+TCRBJ1", "na", "2")], "bio_identity string, productive_frequency string, templates string")
    got = sorted((r["cdr3_b_aa"], r["v_b_gene"] or "", r["j_b_gene"], r["count"]) for r in readers.read_immunoseq(df, names, count="templates", subject="s").collect())
    assert got == [("CASSF", "TRBV30*01", "NA", 3.0), ("CASSW", "", "NA", 2.0)]
    assert readers.read_immunoseq(df, names, subject="s", valid_only=False).filter("not valid_cdr3").count() == 1


def test_vdjtools(spark):
    genes = spark.createDataFrame(GENES, "id string, organism string, chain string, region string")
    df = spark.createDataFrame([("2", "0.1", "CASSF", "TRBV1", "TRBJ1", "tgt"), ("2", "0.1", "CASF", "TRBV1", "TRBJ1", "tgt"), ("1", "0.1", "CASSF", "TRBV7", "TRBJ1", "tgt")], "count string, freq string, cdr3aa string, v string, j string, cdr3nt string")
    assert [(r["count"], r["v_b_gene"]) for r in readers.read_vdjtools(df, genes).collect()] == [(2, "TRBV1*01")]
    assert readers.read_vdjtools(df, genes, valid_only=False).count() == 3
    out = readers.first_alleles(spark.createDataFrame([("TRBV1",), ("TRBV9",)], "v string"), genes, "v", "human")
    assert {r["v"] for r in out.collect()} == {"TRBV1*01", None}


def test_pairing(spark):
    rows = [
        (1, "TRA", "CAF", "TRAV1", "TRAJ1", "E", "{'subject.id': 'p1'}", "{'frequency': '3/9'}", "r1"), (1, "TRB", "CBF", "TRBV1", "TRBJ1", "E", "{}", "{}", "r1"),
        (2, "TRA", "CAW", "TRAV1", "TRAJ1", "E", "{}", "{'frequency': ''}", "r1"), (0, "TRA", "C", "v", "j", "E", "{}", "{}", "r1"), (0, "TRB", "C", "v", "j", "E", "{}", "{}", "r1"),
        (3, "TRA", "CAY", "TRAV1", "TRAJ1", "E", "{}", "{}", "r2"), (3, "TRB", "CBY", "TRBV1", "TRBJ1", "E", "{}", "{}", "r2"),
    ]
    df = spark.createDataFrame(rows, "`complex.id` int, Gene string, CDR3 string, V string, J string, Epitope string, Meta string, Method string, Reference string")
    got = sorted((r["complex_id"], r["cdr3_a_aa"], r["cdr3_b_aa"], r["count"], r["subject"]) for r in readers.pair_vdjdb(df).collect())
    assert got == [(1, "CAF", "CBF", 3, "p1"), (3, "CAY", "CBY", 1, None)]
    assert {r["reference"] for r in readers.pair_vdjdb(df, ["Reference"]).collect()} == {"r1", "r2"}


def test_literals(spark):
    rows = [
        ("{'a': 'x', 'k': '3/9'}", "3/9"), ('{"a": "it\'s", "k": "v"}', "v"), ("{'n': \"5'RACE\", 'k': \"q\"}", "q"), ("{'k': None}", None), ('{"k": null}', None), ("{'k': 7, 'z': 1}", "7"),
        ("{'kk': 'no'}", None), ("", None), (None, None), ("{'k': ''}", None), ('{"k": "a\\"b"}', 'a"b'), ("{'x': 'k', 'k':'last'}", "last"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    assert [r["v"] for r in df.select("i", readers.literal_value(F.col("t"), "k").alias("v")).orderBy("i").collect()] == [v for _, v in rows]


# The layouts' columns in their order, as (there, here) lines.
_LAYOUTS = {
    "clones_to_legacy": "clone_id subject cdr3_a_aa cdr3_b_aa count epitope j_a_gene j_b_gene v_a_gene v_b_gene cdr3_a_nucseq cdr3_b_nucseq va_countreps ja_countreps vb_countreps jb_countreps va_gene ja_gene vb_gene jb_gene"
    " | clone_id subject cdr3a cdr3b clone_size epitope ja_rep jb_rep va_rep vb_rep cdr3a_nucseq cdr3b_nucseq va_countreps ja_countreps vb_countreps jb_countreps va_gene ja_gene vb_gene jb_gene",
    "clones_to_legacy_alpha": "clone_id subject cdr3_a_aa count epitope j_a_gene v_a_gene cdr3_a_nucseq cdr3_b_nucseq va_countreps ja_countreps va_gene ja_gene"
    " | clone_id subject cdr3a clone_size epitope ja_rep va_rep cdr3a_nucseq cdr3b_nucseq va_countreps ja_countreps va_gene ja_gene",
    "clones_to_legacy_delta": "clone_id subject cdr3_d_aa count epitope j_d_gene v_d_gene cdr3_d_nucseq vb_countreps jb_countreps vb_gene jb_gene"
    " | clone_id subject cdr3b clone_size epitope jb_rep vb_rep cdr3b_nucseq vb_countreps jb_countreps vb_gene jb_gene",
    "raw_to_cells": "id epitope subject cdr3a cdr3b ja_gene va_gene jb_gene vb_gene | id epitope subject cdr3_a_aa cdr3_b_aa j_a_gene v_a_gene j_b_gene v_b_gene",
    "subset_to_motif_all_chains": "subject epitope v_a_gene v_g_gene j_a_gene j_g_gene v_b_gene v_d_gene j_b_gene j_d_gene cdr3_a_aa cdr3_g_aa cdr3_b_aa cdr3_d_aa"
    " | subject epitope va_rep va_rep ja_rep ja_rep vb_rep vb_rep jb_rep jb_rep cdr3a cdr3a cdr3b cdr3b",
}


def test_mappings():
    assert len(MAPPINGS) == 14
    for name, lines in _LAYOUTS.items():
        there, here = (x.split() for x in lines.split("|"))
        assert list(MAPPINGS[name].items()) == list(zip(there, here)), name
    # The others follow from these: the legacy layout turned round, beta and gamma as delta and alpha, both as the pair.
    assert list(MAPPINGS["legacy_to_clones"].items()) == [(b, a) for a, b in MAPPINGS["clones_to_legacy"].items()]
    letters = lambda m, old, new: [(a.replace(f"_{old}_", f"_{new}_"), b) for a, b in m.items()]
    assert list(MAPPINGS["clones_to_legacy_beta"].items()) == letters(MAPPINGS["clones_to_legacy_delta"], "d", "b")
    assert list(MAPPINGS["clones_to_legacy_gamma"].items()) == [x for x in letters(MAPPINGS["clones_to_legacy_alpha"], "a", "g") if x[0] != "cdr3_b_nucseq"]
    pair = [(a.replace("_a_", "_g_").replace("_b_", "_d_"), b) for a, b in MAPPINGS["clones_to_legacy"].items()]
    assert list(MAPPINGS["clones_to_legacy_gamma_delta"].items()) == pair
    own = [(f"{g}{x}_{k}", f"{g}{y}_{k}") for k in ("countreps", "gene") for x, y in ("ga", "db") for g in "vj"]
    assert list(MAPPINGS["clones_to_legacy_gamma_delta_own_letters"].items()) == [*pair[:12], *own, *pair[12:]]
    motif = "subject epitope v_a_gene j_a_gene v_b_gene j_b_gene cdr3_a_aa cdr3_b_aa".split()
    assert list(MAPPINGS["clones_to_motif"]) == list(MAPPINGS["subset_to_motif"]) == motif
    vdjdb = ["complex.id", "Gene", "CDR3", "V", "J", "Species", "MHC A", "MHC B", "MHC class", "Epitope", "Epitope gene", "Epitope species", "Reference", "Method", "Meta", "CDR3fix", "Score"]
    assert list(MAPPINGS["vdjdb_alpha"]) == list(MAPPINGS["vdjdb_beta"]) == vdjdb


def test_bulk_loader_and_html(spark, tmp_path):
    names = spark.createDataFrame([("V", "TRBV1*01", "human"), ("J", "TRBJ1*01", "human")], "adaptive string, imgt string, species string")
    genes = spark.createDataFrame([("TRBV1*01", "human", "B", "V", "ABCDEFGH", "1-2;3-4;5-6")], "id string, organism string, chain string, region string, aligned_protseq string, cdr_columns string")
    (tmp_path / "in.tsv").write_text("bio_identity\tproductive_frequency\ttemplates\tmore\nCASSF+V+J\t0.5\t3\tx\nCA*F+V+J\t0.1\t1\ty\nCASF+Q+J\tbad\t1\tz\n")
    full = readers.load_bulk(spark, str(tmp_path / "in.tsv"), names, genes, str(tmp_path / "least"), str(tmp_path / "full")).collect()
    assert sorted((r["cdr3_b_aa"], r["cdr1_b_aa"], r["subject"], r["epitope"], r["count"]) for r in full) == [("CASF", None, "in.tsv", "X", None), ("CASSF", "AB", "in.tsv", "X", 0.5)]
    assert readers.read_delimited(spark, str(tmp_path / "least")).columns == ["cdr3_b_aa", "v_b_gene", "j_b_gene", "productive_frequency", "templates"]
    df = spark.createDataFrame([(2, "<b>", None), (1, "a&'c", 3)], "rank int, x string, y int")
    writers.write_html(df, str(tmp_path / "page"), title="T")
    page = "".join(f.read_text().replace("\n", "") for f in sorted((tmp_path / "page").glob("part-*")))
    head = "<html><head><meta charset='utf-8'><title>T</title></head><body><table><tr><th>rank</th><th>x</th><th>y</th></tr>"
    rows = "<tr><td>1</td><td>a&amp;&#x27;c</td><td>3</td></tr><tr><td>2</td><td>&lt;b&gt;</td><td>None</td></tr>"
    assert page == head + rows + "</table></body></html>"


def test_genes_and_fragments(spark):
    columns = "id string, organism string, chain string, region string, nucseq string, frame int, aligned_protseq string, cdr_columns string, cdrs string"
    good = spark.createDataFrame([("TRBV1*01", "human", "B", "V", "gctgcttgtgatgaa", 1, "AA.CDE", "1-3;4-5", "AA.;CD"), ("TRBJ1*01", "human", "B", "J", "cgctgct", 2, "AA", None, None)], columns)
    assert readers.read_genes(good).count() == 2
    with pytest.raises(Exception, match="spell the protein"):
        readers.read_genes(good.withColumn("nucseq", F.lit("tttttttttttttttttt"))).count()
    assert readers.read_genes(good.withColumn("nucseq", F.lit("ttt")), translate=False).count() == 2
    with pytest.raises(Exception, match="stored loops"):
        readers.read_genes(good.withColumn("cdrs", F.lit("XX;CD"))).count()
    e = spark.createDataFrame([(0, 0, 1.0)], "left_ix long, right_ix long, dist double")
    assert sorted(r["left_ix"] for r in readers.stitched([e, e, e], [2, 3, 1]).collect()) == [0, 2, 5]
    assert sorted(r["right_ix"] for r in readers.stitched([e, e], [4, 4], 1).collect()) == [0, 4]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "x int, y array<string>")
    writers.write_delimited(df, str(tmp_path / "t"))
    assert [tuple(r) for r in readers.read_delimited(spark, str(tmp_path / "t")).collect()] == [("1", '["a","b"]')]
    clones = spark.createDataFrame([("CASSF", "V", 2)], "cdr3_b_aa string, v_b_gene string, count int")
    r = Repertoire.from_cells(clones, "human", ["beta"])
    writers.save(r, str(tmp_path / "r"))
    back = writers.load(spark, str(tmp_path / "r"))
    assert back.specs == r.specs and back.clones.collect() == r.clones.select(back.clones.columns).collect() and back.chains == ("beta",)
    with pytest.raises(ValueError):
        writers.save(Repertoire(clones, ("beta",), "human", {"beta": MetricSpec((("cdr3_b_aa", Custom(len), 1),))}), str(tmp_path / "q"))


def test_stream_search(spark, tmp_path):
    when = datetime.datetime(2024, 1, 1)
    rows = [("CASSF", "V1", 3, when), ("CASTF", "V1", 2, when), ("CASSF", "V2", 1, when), ("CAQQQQF", "V1", 1, when)]
    spark.createDataFrame(rows, "cdr3_b_aa string, v_b_gene string, count int, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cdr3_b_aa string, v_b_gene string, count int, ts timestamp").parquet(str(tmp_path / "in"))
    search = spark.createDataFrame([(7, "CASSF", "V1", 1, "S.F")], "clone_ix long, cdr3_b_aa string, v_b_gene string, radius int, regex string")
    hits = search_stream(stream, search, MetricSpec((("cdr3_b_aa", Edit(), 1),)), ["v_b_gene"])
    counts = hit_counts(hits, "ts", "1 hour", "10 minutes")
    q = counts.writeStream.format("memory").queryName("found").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["left_ix"], r["n_hits"], r["sum_count"]) for r in spark.table("found").collect()] == [(7, 2, 5)]
