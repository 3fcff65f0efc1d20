"""Registered queries of sources, sinks, gene lookups and the operators that the others do not reach, each with the same in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.metrics import Aligned, Custom, Edit, MetricSpec, edit_distance
from ..operators import background, clones as C, cluster, discovery, diversity, edges as E, neighbors as N, radii as R
from ..operators.ranks import adjusted, ranked
from ..sources import readers, writers
from ..sources.mappings import MAPPINGS
from ..sources.store import new_path, written
from . import testbed as T
from .queries import _CODE_SQL, _FISHER, _GRID, _tally, _TALLY, EDIT, edges_sql, edit_edges, query

# Sources and sinks ----------------------------------------------------------------------------------------------------------------


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name FROM part")
def src01_read_columns(spark, d):
    """A table written with tabs, its separator found from the header, and two of its columns read."""
    path = new_path(spark)
    writers.write_delimited(T.table(spark, d, "part"), path)
    sep = readers.detect_separator(spark, path, ["p_name", "p_partkey"])
    return readers.read_delimited(spark, path, sep, ["p_partkey", "p_name"])


@query("SELECT p_brand, count(*)::BIGINT AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY p_brand")
def snk03_folder_of_fragments(spark, d):
    """Fragments appended to one folder under one header, read as a whole."""
    path, part = new_path(spark), T.table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    for k in range(3):
        writers.write_delimited(part.filter(F.col("p_partkey") % 3 == k), path, ",", "append")
    return readers.read_delimited(spark, path, ",").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum(F.col("p_size").cast("long")).alias("size"))


#: A vendor's export from parts: a stop letter in some CDR3s, dirty numbers, names of which some are unknown and one has no translation.
_EXPORT = """x AS (SELECT p_partkey, (CASE WHEN p_size % 11 = 0 THEN '*' ELSE '' END) || 'C' || translate(upper(p_name), 'BJOUXZ ', 'ADEFGHI') || 'F' AS c, p_brand AS b, p_type AS t,
  CASE WHEN p_size % 7 = 0 THEN 'na' ELSE CAST(p_size AS VARCHAR) || '.5' END AS f, CAST(p_partkey % 9 AS VARCHAR) AS k FROM part),
names AS (SELECT DISTINCT p_brand AS a, CASE WHEN p_brand = 'Brand#3' THEN 'NA' ELSE 'TRBV' || substr(p_brand, 7) || '*01' END AS i FROM part WHERE p_brand <> 'Brand#4' UNION ALL SELECT DISTINCT p_type, 'TRBJ-' || p_type || '*01' FROM part)"""


def _export(spark, d):
    p = T.table(spark, d, "part")
    cdr3 = F.concat(F.when(F.col("p_size") % 11 == 0, "*").otherwise(""), F.lit("C"), F.translate(F.upper("p_name"), "BJOUXZ ", "ADEFGHI"), F.lit("F"))
    rows = p.select(
        F.concat_ws("+", cdr3, "p_brand", "p_type").alias("bio_identity"),
        F.when(F.col("p_size") % 7 == 0, "na").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5"))).alias("productive_frequency"), (F.col("p_partkey") % 9).cast("string").alias("templates"),
    )
    v = p.filter("p_brand <> 'Brand#4'").select(F.col("p_brand").alias("adaptive"), F.when(F.col("p_brand") != "Brand#3", F.concat(F.lit("TRBV"), F.expr("substr(p_brand, 7)"), F.lit("*01"))).alias("imgt"))
    j = p.select(F.col("p_type").alias("adaptive"), F.concat(F.lit("TRBJ-"), "p_type", F.lit("*01")).alias("imgt"))
    return rows, v.union(j).distinct().withColumn("species", F.lit("human"))


_IMMUNO = f"""{_EXPORT}, y AS (SELECT c AS cdr3_b_aa, v.i AS v_b_gene, j.i AS j_b_gene, TRY_CAST(k AS DOUBLE) AS count, TRY_CAST(f AS DOUBLE) AS productive_frequency, k AS templates
FROM x LEFT JOIN names v ON b = v.a LEFT JOIN names j ON t = j.a WHERE regexp_full_match(c, '[ACDEFGHIKLMNPQRSTVWY]*'))"""


@query(f"WITH {_IMMUNO} SELECT cdr3_b_aa, v_b_gene, j_b_gene, count, productive_frequency, 'x' AS subject, 'X' AS epitope, true AS valid_cdr3 FROM y")
def src03_immunoseq(spark, d):
    rows, names = _export(spark, d)
    return readers.read_immunoseq(rows, names, count="templates", subject="x")


def _germline(spark, d):
    """A germline table over the names of ``_EXPORT``, its loops cut from md5 letters."""
    _, names = _export(spark, d)
    aligned = F.translate(F.md5("imgt"), "0123456789abcdef", ".CDEFGHIKLMN.QRS")
    known = names.filter("imgt is not null and imgt <> 'TRBV7*01'")
    return known.select(
        F.col("imgt").alias("id"), F.lit("human").alias("organism"), F.lit("B").alias("chain"), F.expr("substr(imgt, 4, 1)").alias("region"), aligned.alias("aligned_protseq"), F.lit("3-8;12-15;20-24").alias("cdr_columns")
    )


def _loops_sql(v: str) -> str:
    aligned = f"translate(md5({v}), '0123456789abcdef', '.CDEFGHIKLMN.QRS')"
    known = f"{v} <> 'NA' AND {v} <> 'TRBV7*01'"
    return ", ".join(f"CASE WHEN {known} THEN substr({aligned}, {a}, {n}) END AS {c}_b_aa" for c, a, n in (("cdr1", 3, 6), ("cdr2", 12, 4), ("pmhc", 20, 5)))


@query(f"""WITH {_IMMUNO} SELECT cdr3_b_aa, v_b_gene, j_b_gene, productive_frequency::DOUBLE AS productive_frequency, templates::BIGINT AS templates, productive_frequency::DOUBLE AS count, {_loops_sql('v_b_gene')} FROM y""")
def src04_bulk_loader(spark, d):
    """A bulk file read, named, given loops, written as the least and the full table; the full one is read back."""
    rows, names = _export(spark, d)
    raw, least, full = (new_path(spark) for _ in range(3))
    writers.write_delimited(rows, raw)
    out = readers.load_bulk(spark, raw, names, _germline(spark, d), least, full, subject="x")
    return out.select("cdr3_b_aa", "v_b_gene", "j_b_gene", "productive_frequency", "templates", "count", "cdr1_b_aa", "cdr2_b_aa", "pmhc_b_aa")


@query(f"""WITH {_IMMUNO} SELECT cdr3_b_aa, v_b_gene, j_b_gene, CAST(productive_frequency AS VARCHAR) AS productive_frequency, templates FROM y""")
def snk01_least_table(spark, d):
    rows, names = _export(spark, d)
    raw, least, full = (new_path(spark) for _ in range(3))
    writers.write_delimited(rows, raw)
    readers.load_bulk(spark, raw, names, _germline(spark, d), least, full, subject="x")
    return readers.read_delimited(spark, least)


@query(f"WITH {_IMMUNO} SELECT cdr3_b_aa, v_b_gene, {_loops_sql('v_b_gene')} FROM y")
def scal01_infer_cdrs(spark, d):
    rows, names = _export(spark, d)
    cells = readers.read_immunoseq(rows, names, subject="x")
    return C.infer_cdrs(cells.select("cdr3_b_aa", "v_b_gene"), _germline(spark, d), "beta", "human")


@query("""WITH k AS (SELECT DISTINCT p_brand FROM part WHERE p_brand <> 'Brand#9'), x AS (SELECT p_partkey, p_size::BIGINT AS count, p_size / 50.0::DOUBLE AS freq, CASE WHEN p_size % 5 = 0 THEN 'CAF' WHEN p_size % 5 = 1 THEN 'CASXF' ELSE 'CASSLF' END AS c, p_brand AS v, p_type AS j FROM part)
SELECT count, round(freq, 9) AS freq, c AS cdr3_b_aa, v || '*01' AS v_b_gene, j || '*01' AS j_b_gene, 'tgc' AS cdr3_b_nucseq, v <> 'Brand#9' AS valid_v, true AS valid_j, p_size_ok AS valid_cdr3
FROM (SELECT *, regexp_full_match(c, '[ACDEFGHIKLMNPQRSTVWY]*') AND length(c) >= 5 AS p_size_ok FROM x)""")
def src05_vdjtools(spark, d):
    p = T.table(spark, d, "part")
    size = F.col("p_size")
    rows = p.select(
        size.cast("string").alias("count"), (size / 50).cast("string").alias("freq"), F.when(size % 5 == 0, "CAF").when(size % 5 == 1, "CASXF").otherwise("CASSLF").alias("cdr3aa"),
        F.col("p_brand").alias("v"), F.col("p_type").alias("j"), F.lit("tgc").alias("cdr3nt"),
    )
    names = p.filter("p_brand <> 'Brand#9'").select(F.concat("p_brand", F.lit("*01")).alias("id")).union(p.select(F.concat("p_type", F.lit("*01")))).distinct()
    out = readers.read_vdjtools(rows, names.withColumn("organism", F.lit("human")), valid_only=False)
    return out.withColumn("freq", F.round("freq", 9))


def _complexes(spark, d):
    """Order lines as a VDJb-like export: the first line of an order is the TRA row, the second the TRB row; dictionaries as Python or as JSON writes them."""
    li = T.table(spark, d, "lineitem").filter("l_linenumber <= 2")
    key, n = F.col("l_orderkey"), F.col("l_quantity").cast("long").cast("string")
    python = F.concat(F.lit("{'note': \"5'RACE\", 'x': None, 'subject.id': 's"), F.col("l_suppkey").cast("string"), F.lit("'}"))
    json = F.concat(F.lit('{"note": "it\'s", "subject.id": "s'), F.col("l_suppkey").cast("string"), F.lit('"}'))
    return li.select(
        key.alias("complex.id"), F.when(F.col("l_linenumber") == 1, "TRA").otherwise("TRB").alias("Gene"), F.concat(F.lit("C"), F.col("l_partkey").cast("string")).alias("CDR3"),
        F.lit("v").alias("V"), F.lit("j").alias("J"), F.lit("E").alias("Epitope"), F.when(key % 2 == 0, python).otherwise(json).alias("Meta"),
        F.when(key % 5 == 0, "{}").when(key % 5 == 1, "not one").otherwise(F.concat(F.lit("{'identification': '', 'frequency': '"), n, F.lit("/99'}"))).alias("Method"), F.concat(F.lit("r"), (key % 7).cast("string")).alias("Reference"),
    )


_PAIRED = """SELECT a.l_orderkey AS complex_id, 'C' || a.l_partkey AS cdr3_a_aa, 'C' || b.l_partkey AS cdr3_b_aa, 's' || a.l_suppkey AS subject,
CASE WHEN a.l_orderkey % 5 < 2 THEN 1 ELSE a.l_quantity::BIGINT END AS count, a.l_orderkey % 5 <> 1 AS readable{} FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2 WHERE a.l_orderkey <> 0"""


@query(_PAIRED.format(""))
def src06_vdjdb_pairs(spark, d):
    return readers.pair_vdjdb(_complexes(spark, d)).select("complex_id", "cdr3_a_aa", "cdr3_b_aa", "subject", "count", "readable")


@query(_PAIRED.format(", 'r' || (a.l_orderkey % 7) AS reference"))
def src07_vdjdb_studies(spark, d):
    return readers.pair_vdjdb(_complexes(spark, d), ["Reference"]).select("complex_id", "cdr3_a_aa", "cdr3_b_aa", "subject", "count", "readable", "reference")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def src06_literal_value(spark, d):
    return T.table(spark, d, "events").select("event_id", readers.literal_value(F.col("props"), "k").alias("k"))


@query(f"WITH {T.CLONES} SELECT clone_id, cdr3_b_aa AS cdr3b, j_b_gene AS jb_rep, v_b_gene AS vb_rep, count AS clone_size FROM clones")
def src08_legacy_mapping(spark, d):
    return readers.rename(T.clones(spark, d), MAPPINGS["clones_to_legacy_beta"], allow_missing=True)


_NT9 = "translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_AA9 = f"array_to_string(list_transform(range(0, 10), lambda i: substr({_CODE_SQL}, 16 * (instr('TCAG', substr(nt, 3 * i + 1, 1)) - 1) + 4 * (instr('TCAG', substr(nt, 3 * i + 2, 1)) - 1) + instr('TCAG', substr(nt, 3 * i + 3, 1)), 1)), '')"


@query(f"""WITH g AS (SELECT p_partkey, substr({_NT9}, 1, 30) AS nt FROM part), a AS (SELECT p_partkey, {_AA9} AS aa FROM g), b AS (SELECT p_partkey, substr(aa, 1, 3) || '.' || substr(aa, 4) AS aligned FROM a)
SELECT 'G' || p_partkey AS id, substr(aligned, 2, 4) || ';' || substr(aligned, 7, 3) AS cdrs FROM b""")
def src09_germline_genes(spark, d):
    """A germline table whose stored loops and proteins are checked against its alignment and nucleotides."""
    nt = F.substring(F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 30)
    aa = S.translated(nt, 1)
    aligned = F.concat(F.substring(aa, 1, 3), F.lit("."), F.substring(aa, 4, 99))
    # Written, as a gene table is: its checks would make its columns anew wherever they name them.
    table = T.spread(T.table(spark, d, "part").select("p_partkey"), "p_partkey").select(
        F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("id"), F.lit("human").alias("organism"), F.lit("B").alias("chain"), F.lit("V").alias("region"), nt.alias("nucseq"), F.lit("1").alias("frame"),
        aligned.alias("aligned_protseq"), F.lit("2-5;7-9").alias("cdr_columns"), F.concat_ws(";", F.substring(aligned, 2, 4), F.substring(aligned, 7, 3)).alias("cdrs"),
    )
    return readers.read_genes(written(table)).select("id", "cdrs")


@query(f"WITH {T.CLONES}, {edges_sql('clones', 'clones', 2)} SELECT left_ix + CASE WHEN left_ix % 2 = 1 THEN 100000 ELSE 0 END AS left_ix, right_ix, dist FROM edges")
def src12_stitched_fragments(spark, d):
    """Edges in two fragments, the second one's rows moved by the first one's size."""
    c = T.clones(spark, d)
    e = edit_edges(c, c, 2)
    return readers.stitched([e.filter("left_ix % 2 = 0"), e.filter("left_ix % 2 = 1")], [100_000, 1])


@query(f"WITH {T.CLONES}, {edges_sql('clones', 'clones', 2)} SELECT * FROM edges")
def snk02_edges_written(spark, d):
    c, path = T.clones(spark, d), new_path(spark)
    writers.write_edges(edit_edges(c, c, 2), path)
    return spark.read.parquet(path)


@query(f"WITH {T.CLONES} SELECT clone_id, {', '.join(T.KEYS)}, count FROM clones")
def snk04_saved_repertoire(spark, d):
    path = new_path(spark)
    writers.save(C.Repertoire.from_cells(T.cells(spark, d).select(*T.KEYS, "count"), "human", ["beta"]), path)
    return writers.load(spark, path).clones


@query("""WITH r AS (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rank FROM part GROUP BY p_brand)
SELECT '<tr><td>' || p_brand || '</td><td>' || n || '</td><td>' || rank || '</td></tr>' AS value FROM r""")
def snk05_html_rows(spark, d):
    """The rows of a report page, as they stand in the files."""
    path = new_path(spark)
    brands = T.table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    writers.write_html(ranked(brands, [F.desc("n"), "p_brand"]), path)
    return spark.read.text(path).filter("value like '<tr><td>%'")


# Genes and strings ------------------------------------------------------------------------------------------------------------------


@query(f"WITH {_EXPORT} SELECT p_partkey, i AS v FROM x LEFT JOIN names ON b = a")
def scal05_vendor_names(spark, d):
    _, names = _export(spark, d)
    return readers.crosswalk(T.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("v")), names, "v", "human")


@query("SELECT p_partkey, CASE WHEN p_brand NOT IN ('Brand#3', 'Brand#4') THEN 'TRBV' || substr(p_brand, 7) || '*01' END AS v FROM part")
def scal05_allele_of_any(spark, d):
    """Names with allele *00, or none, as the allele that the table knows."""
    _, names = _export(spark, d)
    v = F.concat(F.lit("TRBV"), F.expr("substr(p_brand, 7)"), F.when(F.col("p_size") % 2 == 0, "*00").otherwise(""))
    return readers.gene_without_allele(T.table(spark, d, "part").select("p_partkey", v.alias("v")), names, "v", "human")


@query("SELECT p_partkey, CASE WHEN p_brand NOT IN ('Brand#3', 'Brand#4', 'Brand#7') THEN 'TRBV' || substr(p_brand, 7) || '*01' END AS v FROM part")
def scal06_first_alleles(spark, d):
    v = F.concat(F.lit("TRBV"), F.expr("substr(p_brand, 7)"))
    return readers.first_alleles(T.table(spark, d, "part").select("p_partkey", v.alias("v")), _germline(spark, d), "v", "human")


_TOP_STRING = f"""s AS (SELECT j_b_gene, v_b_gene, sum(count)::DOUBLE AS w FROM clones GROUP BY ALL),
r AS (SELECT *, 100 * w / sum(w) OVER (PARTITION BY j_b_gene) AS p, row_number() OVER (PARTITION BY j_b_gene ORDER BY w DESC, v_b_gene) AS k FROM s)"""


@query(f"WITH {T.CLONES}, {_TOP_STRING} SELECT j_b_gene, coalesce(max(round(p + 1e-9, 1)) FILTER (v_b_gene = 'Brand#12' AND k <= 9), 0)::DOUBLE AS share FROM r GROUP BY j_b_gene")
def scal09_percentage(spark, d):
    top = N.top_n_string(T.clones(spark, d), ["j_b_gene"], "v_b_gene", F.col("count"), 9, "summary")
    return top.select("j_b_gene", S.extract_percentage("summary", "Brand#12").alias("share"))


@query("""WITH p AS (SELECT p_partkey, translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM part), q AS (SELECT p_partkey, f, CASE WHEN f > 0 THEN substr(s, f) ELSE substr(reverse(translate(s, 'ACGT', 'TGCA')), -f) END AS nt FROM p, (VALUES (1), (3), (-1), (-2)) AS v(f))
SELECT p_partkey, f::INT AS frame, array_to_string(list_transform(range(0, length(nt) // 3), lambda i: substr(""" + _CODE_SQL + """, 16 * (instr('TCAG', substr(nt, 3 * i + 1, 1)) - 1) + 4 * (instr('TCAG', substr(nt, 3 * i + 2, 1)) - 1) + instr('TCAG', substr(nt, 3 * i + 3, 1)), 1)), '') AS aa FROM q""")
def scal08_frames(spark, d):
    nt = F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    frames = F.array(*(F.struct(F.lit(f).alias("frame"), S.translated(nt, f).alias("aa")) for f in (1, 3, -1, -2)))
    return T.spread(T.table(spark, d, "part").select("p_partkey"), "p_partkey").select("p_partkey", F.explode(frames).alias("x")).select("p_partkey", "x.*")


# Aggregates -------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {T.CELLS} SELECT {', '.join(T.KEYS)}, subject, epitope, flag, sum(count)::BIGINT AS count FROM cells GROUP BY ALL")
def agg02_inferred_keys(spark, d):
    """All columns but counts and ids make a clone; ids that stand there are not kept."""
    cells = T.cells(spark, d).withColumns({"cell_id": F.monotonically_increasing_id(), "clone_id": F.lit(1)})
    return C.deduplicate(cells, number=False)


@query(f"""WITH {T.CLONES}, {edges_sql('clones', 'clones', 2)} SELECT left_ix, count(*)::BIGINT AS n, round(sqrt(avg(count::DOUBLE * count)), 6) AS rms FROM edges JOIN clones ON right_ix = clone_id GROUP BY left_ix""")
def agg06_any_summary(spark, d):
    """A Python function over overlapping groups."""
    c = T.clones(spark, d)
    groups = edit_edges(c, c, 2).select("left_ix", F.col("right_ix").alias("clone_id"))

    def rms(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"left_ix": [pdf["left_ix"].iloc[0]], "n": [len(pdf)], "rms": [round(float((pdf["count"].astype(float) ** 2).mean() ** 0.5), 6)]})

    return N.summarise(c.select("clone_id", "count"), groups, "left_ix", "clone_id", "left_ix long, n long, rms double", rms)


@query(f"""WITH {T.CLONES}, {edges_sql('clones', 'clones', 2)}, s AS (SELECT left_ix, j_b_gene, sum(count)::DOUBLE AS w FROM edges JOIN clones ON right_ix = clone_id GROUP BY ALL),
r AS (SELECT *, 100 * w / sum(w) OVER (PARTITION BY left_ix) AS p, row_number() OVER (PARTITION BY left_ix ORDER BY w DESC, j_b_gene) AS k FROM s),
x AS (SELECT left_ix, cdr3_b_aa, sum(count)::DOUBLE AS w FROM edges JOIN clones ON right_ix = clone_id GROUP BY ALL), y AS (SELECT *, 100 * w / sum(w) OVER (PARTITION BY left_ix) AS p, row_number() OVER (PARTITION BY left_ix ORDER BY w DESC, cdr3_b_aa) AS k FROM x)
SELECT left_ix, j_b_gene, cdr3_b_aa FROM (SELECT left_ix, string_agg(j_b_gene || ' (' || printf('%.1f', round(p + 1e-9, 1)) || '%)', ', ' ORDER BY k) AS j_b_gene FROM r WHERE k <= 3 GROUP BY left_ix)
JOIN (SELECT left_ix, cdr3_b_aa || ' (' || printf('%.1f', round(p + 1e-9, 1)) || '%)' AS cdr3_b_aa FROM y WHERE k = 1) USING (left_ix)""")
def agg08_summaries_of_members(spark, d):
    c = T.clones(spark, d)
    return N.member_summary(edit_edges(c, c, 2), c, {"j_b_gene": 3, "cdr3_b_aa": 1}, clone_id="clone_id")


@query(f"""WITH {T.CELLS}, n AS (SELECT *, nullif(epitope, '1-URGENT') AS e, nullif(v_b_gene, 'Brand#1') AS v FROM cells)
SELECT v, cdr3_b_aa, first(e ORDER BY count DESC, subject, flag, e) FILTER (e IS NOT NULL) AS e, first(count ORDER BY count DESC) AS count FROM n WHERE v IS NOT NULL GROUP BY v, cdr3_b_aa""")
def agg11_first_known(spark, d):
    """The first value that isn't null of each column; rows with a null key vanish."""
    n = T.cells(spark, d).withColumns({"e": F.nullif("epitope", F.lit("1-URGENT")), "v": F.nullif("v_b_gene", F.lit("Brand#1"))})
    return C.first_values(n, ["v", "cdr3_b_aa"], [-F.col("count"), "subject", "flag"], ["e", "count"])


# Distances --------------------------------------------------------------------------------------------------------------------------


_STRINGS = f"{T.CLONES}, d AS (SELECT DISTINCT cdr3_b_aa AS s FROM clones), p AS (SELECT a.s, b.s AS t FROM d a, d b)"


@query(f"WITH RECURSIVE {_STRINGS}, {T.places_sql('p')} SELECT s AS left_ix, t AS right_ix, places::DOUBLE AS dist FROM al WHERE places <= 4")
def dst04_nw_hamming(spark, d):
    """Differing places after a global alignment."""
    s = T.clones(spark, d).select("cdr3_b_aa", F.col("cdr3_b_aa").alias("ix")).distinct()
    return E.radius_join(s, s, MetricSpec((("cdr3_b_aa", Aligned(), 1),)), 4, "ix", "ix")


@query(f"WITH RECURSIVE {_STRINGS}, {T.places_sql('p')} SELECT s AS left_ix, t AS right_ix, (5 * (length(s) + length(t)) // 2 - score)::DOUBLE AS dist FROM al WHERE 5 * (length(s) + length(t)) // 2 - score <= 20")
def dst05_nw_score(spark, d):
    """Dissimilarity of alignment scores."""
    s = T.clones(spark, d).select("cdr3_b_aa", F.col("cdr3_b_aa").alias("ix")).distinct()
    return E.radius_join(s, s, MetricSpec((("cdr3_b_aa", Aligned(False), 1),)), 20, "ix", "ix")


@query(f"WITH {T.CLONES}, s AS (SELECT DISTINCT cdr3_b_aa AS s FROM clones) SELECT a.s AS left_ix, b.s AS right_ix, levenshtein(a.s, b.s)::DOUBLE AS dist FROM s a, s b WHERE levenshtein(a.s, b.s) <= 3")
def dst07_user_metric(spark, d):
    """Any Python function as the metric, here Levenshtein's."""
    s = T.clones(spark, d).select("cdr3_b_aa", F.col("cdr3_b_aa").alias("ix")).distinct()
    return E.radius_join(s, s, MetricSpec((("cdr3_b_aa", Custom(edit_distance), 1),)), 3, "ix", "ix")


@query(f"""WITH {T.CLONES}, p AS (SELECT a.s, b.s AS t, 3 * {T.tcr_sql('a.s', 'b.s')} AS d FROM (SELECT DISTINCT cdr3_b_aa AS s FROM clones) a, (SELECT DISTINCT cdr3_b_aa AS s FROM clones) b)
SELECT l.clone_id AS left_ix, count(*)::BIGINT AS n, sum(d)::DOUBLE AS sum_dist FROM clones l JOIN p ON p.s = l.cdr3_b_aa JOIN clones r ON p.t = r.cdr3_b_aa WHERE d <= 12 GROUP BY l.clone_id""")
def dst09_chain_distances(spark, d):
    """The default distance of a repertoire's declared chain, within a radius."""
    r = C.Repertoire.from_cells(T.cells(spark, d).select(*T.KEYS, "count"), "human", ["beta"], keys=T.KEYS)
    return r.edges("beta", 12).groupBy("left_ix").agg(F.count("*").alias("n"), F.sum("dist").alias("sum_dist"))


@query(f"""WITH {T.CLONES} SELECT l.clone_id AS left_ix, r.clone_id AS right_ix, (levenshtein(l.cdr3_b_aa, r.cdr3_b_aa) + 2 * levenshtein(l.cdr1_b_aa, r.cdr1_b_aa))::DOUBLE AS dist FROM clones l JOIN clones r
ON levenshtein(l.cdr3_b_aa, r.cdr3_b_aa) + 2 * levenshtein(l.cdr1_b_aa, r.cdr1_b_aa) <= 3""")
def dst12_paired_total(spark, d):
    """Two chains' distances in one sum: one metric over both chains' columns, so a pair near in sum is found wherever each part stands."""
    c = T.clones(spark, d)
    return E.radius_join(c, c, MetricSpec((("cdr3_b_aa", Edit(), 1), ("cdr1_b_aa", Edit(), 2))), 3, "clone_id", "clone_id")


# Radii, tests, backgrounds ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {T.CLONES}, {edges_sql('clones', 'clones')}, g AS (SELECT clone_id, count, t FROM clones, (VALUES (0.0), (1.0), (2.0)) AS g(t)), k AS (SELECT count(*) AS k, sum(count) AS s FROM clones),
i AS (SELECT g.clone_id, t, coalesce(sum(b.count), 0) AS x FROM g LEFT JOIN edges ON left_ix = g.clone_id AND right_ix <> left_ix AND dist <= t LEFT JOIN clones b ON right_ix = b.clone_id GROUP BY ALL)
SELECT clone_id AS left_ix, t::DOUBLE AS threshold, round((x + 1) / (s - count + 1), 9) AS share, round((x + 1) / (k - 1 + 1), 9) AS by_rows FROM i JOIN g USING (clone_id, t), k""")
def ecd01_without_self(spark, d):
    """A set against itself, its own rows left out, with a pseudo-count; over the weights and over the number of rows."""
    c = T.clones(spark, d)
    e = edit_edges(c, c)
    of = lambda absolute: R.distance_ecdf(e, c, c, [0.0, 1.0, 2.0], "count", 1.0, True, absolute, "clone_id", "clone_id")
    out = of(False).withColumnRenamed("ecdf", "share").join(of(True).withColumnRenamed("ecdf", "by_rows"), ["left_ix", "threshold"])
    return out.select("left_ix", "threshold", F.round("share", 9).alias("share"), F.round("by_rows", 9).alias("by_rows"))


@query(f"""WITH {T.TWO}, {edges_sql('target', 'bulk')}, e AS (SELECT clone_id AS left_ix, t AS threshold, coalesce((SELECT sum(b.count)::DOUBLE FROM edges e JOIN bulk b ON right_ix = b.clone_id WHERE e.left_ix = target.clone_id AND dist <= t), 0)
  / (SELECT sum(count) FROM bulk) AS ecdf FROM target, (VALUES (0.0), (1.0), (2.0), (3.0)) AS g(t)), p AS (SELECT *, coalesce(lag(ecdf) OVER (PARTITION BY left_ix ORDER BY threshold), 0) AS before FROM e)
SELECT left_ix, threshold::DOUBLE AS x, round(before, 9) AS y, 0 AS corner FROM p UNION ALL SELECT left_ix, threshold, round(ecdf, 9), 1 FROM p""")
def ecd02_step_vectors(spark, d):
    target, bulk = T.target_and_bulk(spark, d)
    e = R.distance_ecdf(edit_edges(target, bulk), target, bulk, _GRID, "count", left_id="clone_id", right_id="clone_id")
    return R.step_vectors(e).withColumn("y", F.round("y", 9))


@query(f"""WITH {T.TWO}, {edges_sql('target', 'bulk')} SELECT dist, round(pow(10, avg(log10(count))), 6) AS gmean FROM edges JOIN bulk ON right_ix = clone_id GROUP BY dist""")
def ecd02_geometric_mean(spark, d):
    target, bulk = T.target_and_bulk(spark, d)
    n = edit_edges(target, bulk).join(bulk.select(F.col("clone_id").alias("right_ix"), "count"), "right_ix")
    return n.groupBy("dist").agg(F.round(R.geometric_mean(F.col("count")), 6).alias("gmean"))


@query(f"WITH {_TALLY}, {_FISHER} SELECT left_ix, round(pvalue, 6) AS pvalue FROM v")
def tst04_fisher_p(spark, d):
    return _tally(spark, d).select("left_ix", F.round(N.fisher_p("ct_0", "ct_1", "ct_2", "ct_3"), 6).alias("pvalue"))


@query("""WITH t AS (SELECT p_partkey, round(p_retailprice / 10000.0, 3)::DOUBLE AS p FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS r, count(*) OVER () AS n FROM t)
SELECT p_partkey, p, round(least(1, max((n - r + 1) * p) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING)), 9) AS "FWERp", round(least(1, min(n * p / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS "FDRq" FROM r""")
def tst04_corrections(spark, d):
    """Both corrections over many tests, equal p among them."""
    t = T.table(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") / 10000.0, 3).cast("double").alias("p"))
    out = adjusted(t, "p")
    return out.select("p_partkey", "p", F.round("FWERp", 9).alias("FWERp"), F.round("FDRq", 9).alias("FDRq"))


_STRATA = f"""WITH {T.CELLS}, s AS (SELECT subject, coalesce(sum(count) FILTER (j_b_gene = 'PROMO' AND epitope = '1-URGENT'), 0)::DOUBLE AS a, coalesce(sum(count) FILTER (j_b_gene = 'PROMO' AND epitope <> '1-URGENT'), 0)::DOUBLE AS b,
coalesce(sum(count) FILTER (j_b_gene <> 'PROMO' AND epitope = '1-URGENT'), 0)::DOUBLE AS c, coalesce(sum(count) FILTER (j_b_gene <> 'PROMO' AND epitope <> '1-URGENT'), 0)::DOUBLE AS d FROM cells GROUP BY subject), n AS (SELECT *, a + b + c + d AS n, a + b AS r, a + c AS k FROM s),
o AS (SELECT sum(a * d / n) / sum(b * c / n) AS psi FROM n)"""


@query(f"""{_STRATA}, q AS (SELECT *, 1 - psi AS p2, n - r - k + psi * (r + k) AS p1, -psi * r * k AS p0 FROM n, o WHERE r > 0 AND k > 0 AND r < n AND k < n),
e AS (SELECT *, (-p1 + sqrt(p1 * p1 - 4 * p2 * p0)) / (2 * p2) AS e FROM q), v AS (SELECT *, 1 / (1 / e + 1 / (r - e) + 1 / (k - e) + 1 / (n - r - k + e)) AS v FROM e)
SELECT 'all' AS scope, round(max(psi), 6) AS "OR_mh", count(*)::BIGINT AS strata, round(sum((a - e) * (a - e) / v) - pow(sum(a - e), 2) / sum(v), 6) AS breslow_day FROM v""")
def tst04_breslow_day(spark, d):
    p, u = F.col("j_b_gene") == "PROMO", F.col("epitope") == "1-URGENT"
    cell = lambda w: F.sum(F.when(w, F.col("count")).otherwise(0))
    s = T.cells(spark, d).groupBy("subject").agg(cell(p & u).alias("ct_0"), cell(p & ~u).alias("ct_1"), cell(~p & u).alias("ct_2"), cell(~p & ~u).alias("ct_3"))
    out = N.breslow_day(s.withColumn("scope", F.lit("all")), ["scope"])
    return out.select("scope", F.round("OR_mh", 6).alias("OR_mh"), "strata", F.round("breslow_day", 6).alias("breslow_day"))


@query(f"""WITH {T.CELLS}, c AS (SELECT DISTINCT v_b_gene, j_b_gene, cdr3_b_aa, subject FROM cells), g AS (SELECT v_b_gene, j_b_gene, count(*) AS n FROM c GROUP BY ALL), m AS (SELECT least(min(n), ceil(450.0 / count(*))) AS m, count(*) AS pairs FROM g),
s AS (SELECT subject, count(*) AS n FROM c GROUP BY subject), w AS (SELECT v_b_gene, j_b_gene, sum(1.0 / (s.n * (SELECT count(*) FROM s))) AS w FROM c JOIN s USING (subject) GROUP BY ALL)
SELECT v_b_gene, j_b_gene, m::BIGINT AS n, round(w / (1.0 / pairs), 6) AS weights FROM w, m""")
def bkg03_flat_background(spark, d):
    """As many rows of each V-J pair, weighted by what the pair should be; rows are a seeded draw, so sizes and weights are compared."""
    c = T.cells(spark, d).select("v_b_gene", "j_b_gene", "cdr3_b_aa", "subject").distinct()
    flat = background.flat_background(c, 450, "v_b_gene", "j_b_gene")
    return flat.groupBy("v_b_gene", "j_b_gene").agg(F.count("*").alias("n"), F.round(F.max("weights"), 6).alias("weights"))


@query(f"WITH {T.CELLS}, c AS (SELECT DISTINCT v_b_gene, j_b_gene, cdr3_b_aa, subject FROM cells), k AS (SELECT ceil(300.0 / count(DISTINCT subject)) AS k FROM c) SELECT subject, least(count(*), max(k))::BIGINT AS n FROM c, k GROUP BY subject")
def bkg06_subject_sample(spark, d):
    c = T.cells(spark, d).select("v_b_gene", "j_b_gene", "cdr3_b_aa", "subject").distinct()
    return background.subject_sample(c, 300).groupBy("subject").agg(F.count("*").alias("n"))


@query("SELECT 5000::BIGINT AS n, count(*) > 0 AS all_known, max(p_partkey) > min(p_partkey) AS spread FROM part")
def smp01_with_replacement(spark, d):
    """Draws with replacement: as many as asked for, of rows that are there, from all of the table."""
    p = T.table(spark, d, "part").select("p_partkey")
    drawn = background.sample(p, 5000, replace=True)
    ends = p.agg(F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"))
    known = drawn.join(p, "p_partkey", "left_semi").count()
    mid = (F.col("lo") + F.col("hi")) / 2
    return drawn.crossJoin(F.broadcast(ends)).agg(F.count("*").alias("n"), (F.count("*") == known).alias("all_known"), F.avg((F.col("p_partkey") > mid).cast("double")).between(0.4, 0.6).alias("spread"))


# Trees ------------------------------------------------------------------------------------------------------------------------------


def _tree(spark, d):
    c = T.clones(spark, d)
    e = edit_edges(c, c, 3)
    return c, e, cluster.agglomerate(e, c, 3, "complete", "clone_id")[1]


@query()
def tst02_tree_nodes(spark, d):
    """The tally and exact test at every node of a complete linkage (its tree is tested against the same linkage in memory)."""
    c, _, members = _tree(spark, d)
    trait = c.withColumn("trait", F.when(F.col("j_b_gene") == "PROMO", "x").otherwise("y"))
    return discovery.node_differences(members.select("node", "ix"), trait, "trait", clone_id="clone_id")


@query()
def clu04_tree_nodes(spark, d):
    """Size, mean distance and diversity of every node of a complete linkage."""
    c, e, members = _tree(spark, d)
    return discovery.group_statistics(members.select("node", "ix"), e, c, cuts=(1, 2, 3), clone_id="clone_id")


def _levels_sql(trait: str, tail: str) -> str:
    """Pearson's statistic of a trait's levels in and out of each V gene, with p and its corrections."""
    return f"""WITH {T.CLONES}, x AS (SELECT *, {trait} AS t FROM clones), z AS (SELECT v_b_gene AS node, count(*) AS size FROM clones GROUP BY 1 HAVING count(*) >= 3), o AS (SELECT v_b_gene AS node, t, sum(count)::DOUBLE AS x FROM x GROUP BY ALL),
a AS (SELECT t, sum(count)::DOUBLE AS a FROM x GROUP BY 1), n AS (SELECT sum(count)::DOUBLE AS n FROM x), k AS (SELECT node, sum(x) AS k FROM o GROUP BY node),
f AS (SELECT z.node, size, a.a, coalesce(x, 0) AS x, a.a * k / n AS e, a.a - a.a * k / n AS f FROM z JOIN k USING (node) CROSS JOIN a CROSS JOIN n LEFT JOIN o ON o.node = z.node AND o.t = a.t),
s AS (SELECT node, size, sum((x - e) * (x - e) / e + (x - e) * (x - e) / f) AS s FROM f GROUP BY node, size), q AS (SELECT node, size, s, s / 2 AS h FROM s), p AS (SELECT *, {tail} AS p FROM q),
r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM p)
SELECT node, size::BIGINT AS size, 'chi2' AS test, round(s, 6) AS statistic, round(p, 9) AS pvalue, round(least(1, max((m - r + 1) * p) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING)), 9) AS "FWERp",
round(least(1, min(m * p / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS "FDRq" FROM r"""


def _levels(spark, d, trait: str):
    c = T.clones(spark, d).withColumn("trait", F.expr(trait))
    out = discovery.node_differences(c.select(F.col("v_b_gene").alias("node"), F.col("clone_id").alias("ix")), c, "trait", clone_id="clone_id")
    return out.select("node", "size", "test", F.round("statistic", 6).alias("statistic"), *(F.round(x, 9).alias(x) for x in ("pvalue", "FWERp", "FDRq")))


#: Five degrees: the tail of one degree by a series or a fraction, and two more terms.
_FIVE = """(CASE WHEN h < 4 THEN 1 - 2 / sqrt(pi()) * sqrt(h) * exp(-h) * list_reduce(range(80, 0, -1), lambda s, i: 1 + s * h / (i + 0.5), 1.0::DOUBLE)
ELSE exp(-h) / (sqrt(pi()) * list_reduce(range(80, 0, -1), lambda t, i: sqrt(h) + i / (2 * t), sqrt(h))) END) + exp(-h) * (2 * sqrt(h / pi()) + 4 * h * sqrt(h / pi()) / 3)"""
_THREE = "CASE left(j_b_gene, 1) WHEN 'S' THEN 'small or standard' WHEN 'P' THEN 'promo' ELSE 'other' END"


@query(_levels_sql("j_b_gene", _FIVE))
def clu04_many_levels(spark, d):
    """The choice of test by levels: six, so Pearson's statistic of every group with five degrees."""
    return _levels(spark, d, "j_b_gene")


@query(_levels_sql(_THREE, "exp(-h)"))
def clu04_three_levels(spark, d):
    """Three levels: two degrees."""
    return _levels(spark, d, _THREE)


# Single linkage, associations, several traits, higher orders, codes --------------------------------------------------------------------


@query(f"""WITH RECURSIVE {T.CLONES}, {edges_sql('clones', 'clones', 1)}, reach AS (SELECT clone_id AS a, clone_id AS b FROM clones UNION SELECT a, right_ix FROM reach JOIN edges ON left_ix = b),
c AS (SELECT b AS ix, min(a) AS cluster_id FROM reach GROUP BY b), g AS (SELECT cluster_id, list_sort(list(ix)) AS m, count(*)::BIGINT AS size FROM c GROUP BY cluster_id)
SELECT cluster_id, array_to_string(m, ',') AS members, size, row_number() OVER (ORDER BY size DESC, cluster_id)::BIGINT AS rank FROM g""")
def clu02_single_linkage(spark, d):
    """Single linkage cut at one edit, as clusters with their members, largest first."""
    c = T.clones(spark, d)
    out = cluster.clusters_of(cluster.hierarchical(edit_edges(c, c, 1), c, 1, "single", "clone_id"))
    return out.withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


@query(f"""WITH {T.CELLS}, n AS (SELECT sum(count) AS n FROM cells), r AS (SELECT v_b_gene AS a, sum(count) AS r FROM cells GROUP BY ALL), k AS (SELECT j_b_gene AS b, sum(count) AS c FROM cells GROUP BY ALL),
x AS (SELECT v_b_gene AS a, j_b_gene AS b, sum(count) AS x FROM cells GROUP BY ALL), ct AS (SELECT a || '/' || b AS left_ix, a, b, coalesce(x, 0)::BIGINT AS ct_0, (r - coalesce(x, 0))::BIGINT AS ct_1, (c - coalesce(x, 0))::BIGINT AS ct_2, (n - r - c + coalesce(x, 0))::BIGINT AS ct_3
  FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN x USING (a, b)), {_FISHER}, w AS (SELECT *, row_number() OVER (ORDER BY pvalue) AS i, count(*) OVER () AS m FROM v JOIN ct USING (left_ix))
SELECT a, b, ct_0 AS n_11, round(pvalue, 6) AS pvalue, round(least(1, max((m - i + 1) * pvalue) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)), 6) AS "FWERp",
round(least(1, min(m * pvalue / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS "FDRq" FROM w""")
def tst05_exact_tests(spark, d):
    """The exact test of every pair of V and J genes, with corrections over all of them."""
    out = discovery.gene_associations(T.cells(spark, d), ["v_b_gene", "j_b_gene"], "count")
    return out.select("a", "b", "n_11", *(F.round(c, 6).alias(c) for c in ("pvalue", "FWERp", "FDRq")))


_TRAITS = f"""{T.CLONES}, {edges_sql('clones', 'clones', 2)}, o AS (SELECT clone_id AS right_ix, count AS n, cdr1_b_aa AS st, unnest([{{'trait': 'j_b_gene', 'level': j_b_gene}}, {{'trait': 'half', 'level': CASE WHEN count % 2 = 0 THEN 'even' ELSE 'odd' END}}], recursive := true) FROM clones),
near AS (SELECT left_ix, trait, level, st, sum(n) AS x FROM edges JOIN o USING (right_ix) GROUP BY ALL), lv AS (SELECT trait, level, st, sum(n) AS w FROM o GROUP BY ALL), wh AS (SELECT trait, st, sum(w) AS a FROM lv GROUP BY ALL)"""


@query(f"""WITH {_TRAITS}, nx AS (SELECT left_ix, trait, level, sum(x) AS x FROM near GROUP BY ALL), i AS (SELECT left_ix, trait, sum(x) AS i FROM nx GROUP BY ALL), l AS (SELECT trait, level, sum(w) AS w FROM lv GROUP BY ALL), h AS (SELECT trait, sum(a) AS a FROM wh GROUP BY ALL)
SELECT left_ix, trait, level, (i - x)::BIGINT AS ct_0, (a - w - i + x)::BIGINT AS ct_1, x::BIGINT AS ct_2, (w - x)::BIGINT AS ct_3 FROM nx JOIN i USING (left_ix, trait) JOIN l USING (trait, level) JOIN h USING (trait)""")
def tst01_several_traits(spark, d):
    """The cells of every level of two traits at every neighbourhood, in one pass."""
    c = T.clones(spark, d).withColumn("half", F.when(F.col("count") % 2 == 0, "even").otherwise("odd"))
    return N.tallies(edit_edges(c, c, 2), c, ["j_b_gene", "half"], clone_id="clone_id")


@query(f"""WITH {T.CELLS}, {T.clones_sql('clones0')}, clones AS (SELECT * REPLACE (left(j_b_gene, 1) AS cdr1_b_aa) FROM clones0), {_TRAITS.replace(T.CLONES + ', ', '')}, i AS (SELECT left_ix, trait, st, sum(x) AS i FROM near GROUP BY ALL),
z AS (SELECT left_ix, trait, level, st, coalesce(x, 0) AS x, i, coalesce(w, 0) AS w, a FROM (SELECT DISTINCT left_ix, trait, level FROM near) JOIN i USING (left_ix, trait) LEFT JOIN near USING (left_ix, trait, level, st) LEFT JOIN lv USING (trait, level, st) JOIN wh USING (trait, st)),
ct AS (SELECT left_ix, trait, level, (i - x)::DOUBLE AS c0, (a - w - i + x)::DOUBLE AS c1, x::DOUBLE AS c2, (w - x)::DOUBLE AS c3, a::DOUBLE AS n FROM z WHERE trait = 'half')
SELECT left_ix, trait, level, round(sum(c0 * c3 / n) / nullif(sum(c1 * c2 / n), 0), 6) AS "OR_mh" FROM ct GROUP BY ALL""")
def tst04_traits_by_stratum(spark, d):
    """The common odds ratio over strata (here the first letter of the J gene) of every level of a trait at every neighbourhood."""
    c = T.clones(spark, d).withColumns({"half": F.when(F.col("count") % 2 == 0, "even").otherwise("odd"), "stratum": F.substring("j_b_gene", 1, 1)})
    cells = N.tallies(edit_edges(c, c, 2), c, ["half"], clone_id="clone_id", stratum="stratum")
    out = N.mantel_haenszel(cells, ["left_ix", "trait", "level"])
    return out.select("left_ix", "trait", "level", F.round("OR_mh", 6).alias("OR_mh"))


@query(f"""WITH {T.CLONES}, s AS (SELECT cdr3_b_aa AS s, sum(count)::DOUBLE AS c FROM clones GROUP BY 1), d AS (SELECT a.s, b.s AS t, a.c AS x, b.c AS y, levenshtein(a.s, b.s) <= 99 AS near FROM s a, s b)
SELECT greatest(0, round(1 - sum(d.x * d.y * s.c) FILTER (d.near AND e.near AND f.near) / power((SELECT sum(c) FROM s), 3), 9))::DOUBLE AS fuzzy FROM d JOIN s ON true JOIN d e ON e.s = d.s AND e.t = s.s JOIN d f ON f.s = d.t AND f.t = s.s""")
def div05_third_order(spark, d):
    """Draws of three strings by count, of which not all pairs are near: at a threshold that takes all pairs in, so the share is exact."""
    s = T.clones(spark, d).groupBy("cdr3_b_aa").agg(F.sum("count").alias("count")).withColumnRenamed("cdr3_b_aa", "ix").withColumn("cdr3_b_aa", F.col("ix"))
    e = E.radius_join(s, s, EDIT, 99, "ix", "ix")
    return diversity.fuzzy_sampled(e, s, "count", 99, 3, 20_000, clone_id="ix").select(F.round("fuzzy", 9).alias("fuzzy"))


_MITO = "concat(substr(" + _CODE_SQL + ", 1, 14), 'WW', substr(" + _CODE_SQL + ", 17, 18), 'M', substr(" + _CODE_SQL + ", 36, 11), '**', substr(" + _CODE_SQL + ", 49))"


@query("""WITH p AS (SELECT p_partkey, translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS nt FROM part)
SELECT p_partkey, array_to_string(list_transform(range(0, 10), lambda i: substr(""" + _MITO + """, 16 * (instr('TCAG', substr(nt, 3 * i + 1, 1)) - 1) + 4 * (instr('TCAG', substr(nt, 3 * i + 2, 1)) - 1) + instr('TCAG', substr(nt, 3 * i + 3, 1)), 1)), '') AS aa FROM p""")
def scal08_changed_code(spark, d):
    """Another genetic code: that of vertebrate mitochondria."""
    nt = F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    code = S.changed_code({"TGA": "W", "ATA": "M", "AGA": "*", "AGG": "*"})
    return T.spread(T.table(spark, d, "part").select("p_partkey"), "p_partkey").select("p_partkey", S.translated(nt, 1, code).alias("aa"))


@query(f"WITH {T.CLONES} SELECT v_b_gene AS gene, count(*)::BIGINT AS n FROM clones WHERE right(v_b_gene, 1) NOT IN ('1', '3') GROUP BY v_b_gene")
def scal01_unknown_genes(spark, d):
    """Genes that the table lacks, with the clones that name them; here the table has every brand that ends in 1 or 3."""
    c = T.clones(spark, d)
    genes = c.filter(F.substring("v_b_gene", -1, 1).isin("1", "3")).select(F.col("v_b_gene").alias("id"), F.lit("human").alias("organism"), F.lit("B").alias("chain"), F.lit("V").alias("region")).distinct()
    return C.unknown_genes(c, genes, "beta", "human")
