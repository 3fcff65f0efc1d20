"""The registered queries of the repertoire operators, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.metrics import Edit, Hamming, MetricSpec, Tcr
from ..operators import background, clones as C, cluster, discovery, diversity, edges as E, motifs, neighbors as N, radii as R
from ..operators.ranks import adjusted, ranked
from ..operators.regex_join import regex_hits
from ..sources import readers
from ..sources.store import written
from . import testbed as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EDIT = MetricSpec((("cdr3_b_aa", Edit(), 1),))
TCR = MetricSpec((("cdr3_b_aa", Tcr(), 3), ("cdr1_b_aa", Tcr(0, 0, True), 1)))
RADIUS = 36
V = ["v_b_gene"]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def edit_edges(left: DataFrame, right: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs of one V gene within a few edits, by parts of their strings."""
    return E.edit_join(left, right, "cdr3_b_aa", radius, V, "clone_id", "clone_id")


def all_edges(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of a V gene: for queries that ask for each of them."""
    return E.native_join(left, right, EDIT, 99, V, "clone_id", "clone_id")


def edges_sql(left: str, right: str, radius: int = 3, name: str = "edges") -> str:
    """Edit-distance edges within a V gene."""
    return f"""{name} AS (SELECT l.clone_id AS left_ix, r.clone_id AS right_ix, levenshtein(l.cdr3_b_aa, r.cdr3_b_aa)::DOUBLE AS dist
  FROM {left} l JOIN {right} r USING (v_b_gene) WHERE levenshtein(l.cdr3_b_aa, r.cdr3_b_aa) <= {radius})"""


# Flagship ---------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {T.TWO}, {edges_sql('target', 'bulk')}
SELECT clone_id, count(right_ix)::BIGINT AS n_hits, coalesce(sum(b_count), 0)::BIGINT AS sum_count FROM target
LEFT JOIN (SELECT left_ix, right_ix, bulk.count AS b_count FROM edges JOIN bulk ON right_ix = bulk.clone_id) ON left_ix = clone_id GROUP BY clone_id""")
def m0_search_bulk(spark, d):
    """Clones of one repertoire searched in another: neighbours and their counts."""
    target, bulk = T.target_and_bulk(spark, d)
    hit = edit_edges(target, bulk).join(bulk.select(F.col("clone_id").alias("right_ix"), F.col("count").alias("_n")), "right_ix")
    per = hit.groupBy(F.col("left_ix").alias("clone_id")).agg(F.count("*").alias("n_hits"), F.sum("_n").alias("sum_count"))
    return target.select("clone_id").join(per, "clone_id", "left").fillna(0)


# Rows: filters, aggregates, strings ---------------------------------------------------------------------------------------------


@query(f"WITH {T.CELLS} SELECT {', '.join(T.KEYS)}, sum(count)::BIGINT AS count FROM cells GROUP BY {', '.join(T.KEYS)}")
def agg01_dedup(spark, d):
    return C.deduplicate(T.cells(spark, d).select(*T.KEYS, "count"), T.KEYS, number=False)


@query(f"WITH {T.CLONES} SELECT clone_id, {', '.join(T.KEYS)}, count FROM clones")
def agg01_clone_id(spark, d):
    return T.clones(spark, d)


@query(f"""WITH {T.CELLS}, n AS (SELECT nullif(v_b_gene, 'Brand#1') AS v_b_gene, j_b_gene, cdr3_b_aa, count FROM cells)
SELECT v_b_gene, j_b_gene, cdr3_b_aa, sum(count)::BIGINT AS count FROM n WHERE v_b_gene IS NOT NULL GROUP BY ALL""")
def agg01_null_keys(spark, d):
    c = T.cells(spark, d).withColumn("v_b_gene", F.nullif("v_b_gene", F.lit("Brand#1")))
    return C.deduplicate(c.select("v_b_gene", "j_b_gene", "cdr3_b_aa", "count"), number=False)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 AND o_custkey < 700")
def flt01_is_gt_lt(spark, d):
    o = T.table(spark, d, "orders")
    return C.filter_lt(C.filter_gt(C.filter_is(o, "o_orderstatus", "O"), "o_totalprice", 100000), "o_custkey", 700).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_type FROM part WHERE p_type IN ('PROMO', 'SMALL') AND contains('ECONOMY PROMO', p_type)")
def flt02_in_substring(spark, d):
    return C.filter_in(C.filter_in(T.table(spark, d, "part"), "p_type", ["PROMO", "SMALL"]), "p_type", "ECONOMY PROMO").select("p_partkey", "p_type")


@query("SELECT event_id FROM events WHERE (event_type = 'click' AND value > 10) OR NOT (user_id < 100)")
def flt03_query_expr(spark, d):
    return C.filter_query(T.table(spark, d, "events"), "(event_type == 'click' & value > 10) | ~(user_id < 100)").select("event_id")


@query("SELECT event_id FROM (SELECT *, nullif(event_type, 'error') AS t FROM events) WHERE t IS NULL OR user_id IS NULL")
def flt05_incomplete(spark, d):
    return C.incomplete(T.table(spark, d, "events").withColumn("t", F.nullif("event_type", F.lit("error"))), ["t", "user_id"]).select("event_id")


@query(f"""WITH {T.CELLS}, s AS (SELECT v_b_gene, list_distinct(list(subject)) AS a, list_distinct(list(subject) FILTER (epitope = '1-URGENT')) AS b FROM cells GROUP BY v_b_gene)
SELECT v_b_gene, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS inside, len(list_filter(a, lambda x: NOT list_contains(coalesce(b, []), x))) < 3 AS almost FROM s""")
def flt06_subsets(spark, d):
    s = T.cells(spark, d).groupBy("v_b_gene").agg(F.collect_set("subject").alias("a"), F.collect_set(F.when(F.col("epitope") == "1-URGENT", F.col("subject"))).alias("b"))
    return s.select("v_b_gene", C.is_subset(F.col("b"), F.col("a")).alias("inside"), C.is_almost_subset(F.col("a"), F.col("b"), 3).alias("almost"))


@query(f"WITH {T.CLONES} SELECT v_b_gene, j_b_gene, count(*)::BIGINT AS n FROM clones GROUP BY ALL")
def agg03_vj_usage(spark, d):
    return C.gene_usage(T.clones(spark, d), ["v_b_gene", "j_b_gene"])


def _shares_sql(weight: str) -> str:
    return f"""WITH {T.CLONES}, s AS (SELECT j_b_gene, v_b_gene, sum({weight})::DOUBLE AS w FROM clones GROUP BY ALL),
    r AS (SELECT *, 100 * w / sum(w) OVER (PARTITION BY j_b_gene) AS percent, row_number() OVER (PARTITION BY j_b_gene ORDER BY w DESC, v_b_gene) AS rank FROM s)
    SELECT j_b_gene, v_b_gene, round(percent, 6) AS percent, rank::INT AS rank FROM r WHERE rank <= 3"""


@query(_shares_sql("count"))
def agg04_top_n(spark, d):
    return N.top_n_shares(T.clones(spark, d), ["j_b_gene"], "v_b_gene", F.col("count"), 3).withColumn("percent", F.round("percent", 6))


@query(_shares_sql("1"))
def agg05_occurs_n(spark, d):
    return N.top_n_shares(T.clones(spark, d), ["j_b_gene"], "v_b_gene", F.lit(1), 3).withColumn("percent", F.round("percent", 6))


@query(f"""WITH {T.CLONES}, s AS (SELECT j_b_gene, v_b_gene, sum(count)::DOUBLE AS w FROM clones GROUP BY ALL),
r AS (SELECT *, 100 * w / sum(w) OVER (PARTITION BY j_b_gene) AS p, row_number() OVER (PARTITION BY j_b_gene ORDER BY w DESC, v_b_gene) AS k FROM s)
SELECT j_b_gene, string_agg(v_b_gene || ' (' || printf('%.1f', round(p + 1e-9, 1)) || '%)', ', ' ORDER BY k) AS summary FROM r WHERE k <= 3 GROUP BY j_b_gene""")
def agg04_top_n_string(spark, d):
    return N.top_n_string(T.clones(spark, d), ["j_b_gene"], "v_b_gene", F.col("count"), 3, "summary")


@query(f"""WITH {T.CLONES}, s AS (SELECT v_b_gene, list_sort(list(count)) AS a FROM clones GROUP BY v_b_gene)
SELECT v_b_gene, {', '.join(f"(a[floor((len(a) - 1) * {q})::INT + 1] + a[ceil((len(a) - 1) * {q})::INT + 1]) / 2 AS q{int(100 * q)}" for q in (0.0, 0.25, 0.5, 0.75, 1.0))} FROM s""")
def agg07_five_numbers(spark, d):
    return N.five_numbers(T.clones(spark, d), ["v_b_gene"], "count")


@query(f"WITH {T.CELLS} SELECT cdr3_b_aa, count(DISTINCT subject)::BIGINT AS n_levels, CASE WHEN count(DISTINCT subject) > 35 THEN 'public' ELSE 'private' END AS public FROM cells GROUP BY cdr3_b_aa")
def agg09_publicity(spark, d):
    return N.publicity(T.cells(spark, d), ["cdr3_b_aa"], "subject", 35)


@query(f"WITH {T.CELLS} SELECT v_b_gene, cdr3_b_aa, epitope, count FROM cells QUALIFY row_number() OVER (PARTITION BY v_b_gene, cdr3_b_aa ORDER BY count DESC, epitope, subject, j_b_gene, flag) = 1")
def agg11_first_per_group(spark, d):
    w = Window.partitionBy("v_b_gene", "cdr3_b_aa").orderBy(F.desc("count"), "epitope", "subject", "j_b_gene", "flag")
    return T.cells(spark, d).withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("v_b_gene", "cdr3_b_aa", "epitope", "count")


@query(f"""WITH {T.CLONES} SELECT clone_id, round(count / (count(*) OVER (PARTITION BY v_b_gene, j_b_gene) / count(*) OVER ()), 6) AS weights FROM clones""")
def agg13_usage_weights(spark, d):
    return C.usage_weights(T.clones(spark, d), ["v_b_gene", "j_b_gene"], "count").select("clone_id", F.round("weights", 6).alias("weights"))


_STRAT = f"""{T.CELLS}, s AS (SELECT subject, count(*) AS n FROM cells GROUP BY subject), w AS (SELECT v_b_gene AS v, j_b_gene AS j, 1.0 / (n * (SELECT count(*) FROM s)) AS w FROM cells JOIN s USING (subject)),
vj AS (SELECT v, j, sum(w) AS "pVJ" FROM w GROUP BY ALL), pv AS (SELECT v, sum(w) AS "pV" FROM w GROUP BY ALL), pj AS (SELECT j, sum(w) AS "pJ" FROM w GROUP BY ALL)"""


@query(f'WITH {_STRAT} SELECT v, j, round("pVJ", 9) AS "pVJ" FROM vj')
def agg15_stratified_usage(spark, d):
    t = C.stratified_usage(T.cells(spark, d), "v_b_gene", "j_b_gene")["vj"]
    return t.select(F.col("v_b_gene").alias("v"), F.col("j_b_gene").alias("j"), F.round("pVJ", 9).alias("pVJ"))


@query(f"""WITH {_STRAT}, p AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN 'unknown' ELSE p_brand END AS v, p_type AS j FROM part)
SELECT p_partkey, round(coalesce("pV", (SELECT min("pV") FROM pv)), 9) AS "pV", round(coalesce("pJ", (SELECT min("pJ") FROM pj)), 9) AS "pJ", round(coalesce("pVJ", (SELECT min("pVJ") FROM vj)), 9) AS "pVJ"
FROM p LEFT JOIN pv USING (v) LEFT JOIN pj USING (j) LEFT JOIN vj USING (v, j)""")
def agg14_gene_frequencies(spark, d):
    tables = C.stratified_usage(T.cells(spark, d), "v_b_gene", "j_b_gene")
    p = T.table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 40, "unknown").otherwise(F.col("p_brand")).alias("v_b_gene"), F.col("p_type").alias("j_b_gene"))
    out = C.with_gene_frequencies(p, tables, "v_b_gene", "j_b_gene")
    return out.select("p_partkey", *(F.round(c, 9).alias(c) for c in ("pV", "pJ", "pVJ")))


_MD5 = "translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', '{}')"


@query(f"""WITH p AS (SELECT p_partkey, {_MD5.format('.CDEFGHIKLMN.QRS')} AS aligned FROM part)
SELECT p_partkey, substr(aligned, 3, 6) AS g1, substr(aligned, 12, 4) AS g2, replace(substr(aligned, 3, 6), '.', '') AS u1 FROM p""")
def scal02_cdr_substrings(spark, d):
    p = T.table(spark, d, "part").select("p_partkey", F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", ".CDEFGHIKLMN.QRS").alias("aligned"))
    p = p.withColumns({"g": S.cdrs_of("aligned", F.lit("3-8;12-15")), "u": S.cdrs_of("aligned", F.lit("3-8;12-15"), False)})
    return p.select("p_partkey", p["g"][0].alias("g1"), p["g"][1].alias("g2"), p["u"][0].alias("u1"))


@query("SELECT p_partkey, coalesce(regexp_full_match(nullif(upper(p_name), 'RED GEAR'), '[ACDEFGHIKLMNPQRSTVWY]*'), false) AS ok, regexp_replace(p_brand, '[0-9]$', '1') AS allele FROM part")
def scal03_valid_and_allele(spark, d):
    p = T.table(spark, d, "part")
    return p.select("p_partkey", S.valid_cdr3(F.nullif(F.upper("p_name"), F.lit("RED GEAR"))).alias("ok"), S.allele_01("p_brand").alias("allele"))


_NT = _MD5.format("ACGTACGTNRYSWKMA")


@query(f"SELECT p_partkey, reverse(translate({_NT}, 'acgtnACGTNRYSWKM.', 'tgcanTGCANYRSWMK.')) AS rc FROM part")
def scal07_reverse_complement(spark, d):
    nt = F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGTACGTNRYSWKMA")
    return T.table(spark, d, "part").select("p_partkey", S.reverse_complement(nt).alias("rc"))


_PLAIN = "translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_CODE_SQL = "'FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG'"


@query(f"""WITH p AS (SELECT p_partkey, {_PLAIN} AS nt FROM part)
SELECT p_partkey, array_to_string(list_transform(range(0, 10), lambda i: substr({_CODE_SQL}, 16 * (instr('TCAG', substr(nt, 3 * i + 2, 1)) - 1) + 4 * (instr('TCAG', substr(nt, 3 * i + 3, 1)) - 1) + instr('TCAG', substr(nt, 3 * i + 4, 1)), 1)), '') AS aa FROM p""")
def scal08_translate(spark, d):
    nt = F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    return T.spread(T.table(spark, d, "part").select("p_partkey"), "p_partkey").select("p_partkey", S.translated(nt, 2).alias("aa"))


@query("""SELECT a.l_orderkey AS complex_id, a.l_suppkey AS sa, b.l_suppkey AS sb FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2""")
def src06_pair_chains(spark, d):
    """The pairing of two chains by complex id: a filtered self-join."""
    li = T.table(spark, d, "lineitem")
    a = li.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("complex_id"), F.col("l_suppkey").alias("sa"))
    return a.join(li.filter("l_linenumber = 2").select(F.col("l_orderkey").alias("complex_id"), F.col("l_suppkey").alias("sb")), "complex_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS n FROM events")
def src06_unpack_literals(spark, d):
    e = T.table(spark, d, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    return e.select("event_id", e["m"]["k"].alias("k"), F.expr("try_cast(m['k'] as double)").alias("n"))


@query("SELECT p_brand AS v, p_type AS j, p_partkey AS id FROM part")
def src08_rename(spark, d):
    return readers.rename(T.table(spark, d, "part"), {"p_brand": "v", "p_type": "j", "absent": "x", "p_partkey": "id"}, allow_missing=True)


@query(f"WITH {T.CLONES} SELECT clone_id, v_b_gene, j_b_gene, v_b_gene AS vb_gene, j_b_gene AS jb_gene FROM clones")
def prj02_legacy_fields(spark, d):
    return C.legacy_fields(T.clones(spark, d).select("clone_id", "v_b_gene", "j_b_gene"), ["beta"])


# Distances and joins ------------------------------------------------------------------------------------------------------------


@query(f"WITH {T.CLONES}, {edges_sql('clones', 'clones')} SELECT * FROM edges")
def dst06_edit_pairs(spark, d):
    c = T.clones(spark, d)
    return edit_edges(c, c)


@query(f"""WITH {T.CLONES}, s AS (SELECT DISTINCT cdr3_b_aa AS s FROM clones) SELECT a.s AS s, b.s AS t, hamming(a.s, b.s)::INT AS dist FROM s a JOIN s b ON length(a.s) = length(b.s)""")
def dst04_hamming_pairs(spark, d):
    s = T.clones(spark, d).select(F.col("cdr3_b_aa").alias("s"), F.length("cdr3_b_aa").alias("n")).distinct()
    return s.join(s.select(F.col("s").alias("t"), "n"), "n").select("s", "t", Hamming().column(F.col("s"), F.col("t")).alias("dist"))


def _tcr_pairs_sql(m: Tcr) -> str:
    return f"WITH {T.CLONES}, s AS (SELECT DISTINCT cdr3_b_aa AS s FROM clones) SELECT a.s AS s, b.s AS t, {T.tcr_sql('a.s', 'b.s', m)}::BIGINT AS dist FROM s a, s b"


def _all_pairs(spark, d, m):
    """Distinct strings, by their blocks; the strings are a dimension."""
    s = T.clones(spark, d).select(F.col("cdr3_b_aa"), F.col("cdr3_b_aa").alias("ix")).distinct()
    out = E.radius_join(s, s, MetricSpec((("cdr3_b_aa", m, 1),)), None, "ix", "ix")
    return out.select(F.col("left_ix").alias("s"), F.col("right_ix").alias("t"), F.col("dist").cast("long").alias("dist"))


@query(_tcr_pairs_sql(Tcr()))
def dst03_tcr_gap_free(spark, d):
    return _all_pairs(spark, d, Tcr())


@query(_tcr_pairs_sql(Tcr(0, 0, True)))
def dst03_tcr_gap_fixed(spark, d):
    return _all_pairs(spark, d, Tcr(0, 0, True))


_PAIRS = f"""d3 AS (SELECT a.s, b.s AS t, {T.tcr_sql('a.s', 'b.s')} AS d FROM (SELECT DISTINCT cdr3_b_aa AS s FROM cells) a, (SELECT DISTINCT cdr3_b_aa AS s FROM cells) b),
d1 AS (SELECT a.s, b.s AS t, {T.tcr_sql('a.s', 'b.s', Tcr(0, 0, True))} AS d FROM (SELECT DISTINCT cdr1_b_aa AS s FROM cells) a, (SELECT DISTINCT cdr1_b_aa AS s FROM cells) b)"""


def _tcr_edges_sql(left: str, right: str, radius: int = RADIUS, same_v: bool = False) -> str:
    return f"""{_PAIRS}, edges AS (SELECT l.clone_id AS left_ix, r.clone_id AS right_ix, (3 * d3.d + d1.d)::DOUBLE AS dist FROM {left} l JOIN d3 ON d3.s = l.cdr3_b_aa
    JOIN d1 ON d1.s = l.cdr1_b_aa JOIN {right} r ON d3.t = r.cdr3_b_aa AND d1.t = r.cdr1_b_aa{' AND l.v_b_gene = r.v_b_gene' if same_v else ''} WHERE 3 * d3.d + d1.d <= {radius})"""


@query(f"WITH {T.CLONES}, {_tcr_edges_sql('clones', 'clones', 12)} SELECT left_ix, count(*)::BIGINT AS n, sum(dist)::DOUBLE AS sum_dist FROM edges GROUP BY left_ix")
def dst11_radius_join(spark, d):
    """The weighted distance over two columns as a radius join over all genes, by blocks."""
    c = T.clones(spark, d)
    e = E.radius_join(c, c, TCR, 12, "clone_id", "clone_id")
    return e.groupBy("left_ix").agg(F.count("*").alias("n"), F.sum("dist").alias("sum_dist"))


@query(f"WITH {T.CLONES}, {_tcr_edges_sql('clones', 'clones', RADIUS, True)} SELECT * FROM edges")
def dst02_weighted_sum(spark, d):
    """The same metric as a native expression within a V gene."""
    c = T.clones(spark, d)
    return E.native_join(c, c, TCR, RADIUS, V, "clone_id", "clone_id")


@query(f"""WITH {T.CLONES}, {edges_sql('clones', 'clones', 3, 'a')}, {edges_sql('clones', 'clones', 2, 'b')} SELECT left_ix, right_ix, a.dist + b.dist AS dist FROM a JOIN b USING (left_ix, right_ix)""")
def dst13_sparse_add(spark, d):
    c = T.clones(spark, d)
    return E.add_edges(edit_edges(c, c), edit_edges(c, c, 2))


@query(f"""WITH {T.CLONES}, {edges_sql('clones', 'clones', 99)}, m AS (SELECT clone_id, v_b_gene, j_b_gene FROM clones),
s AS (SELECT a.v_b_gene || '/' || a.j_b_gene AS g, left_ix, sum(dist) AS s FROM edges JOIN m a ON left_ix = a.clone_id JOIN m b ON right_ix = b.clone_id AND a.j_b_gene = b.j_b_gene GROUP BY ALL),
n AS (SELECT v_b_gene || '/' || j_b_gene AS g, count(*) AS n, min(clone_id) AS f FROM clones GROUP BY ALL)
SELECT g, CASE WHEN n < 3 THEN f ELSE (SELECT left_ix FROM s WHERE s.g = n.g ORDER BY s, left_ix LIMIT 1) END AS medoid FROM n""")
def dst17_medoid(spark, d):
    c = T.clones(spark, d)
    groups = c.select("clone_id", F.concat_ws("/", "v_b_gene", "j_b_gene").alias("g"))
    return E.medoids(all_edges(c, c), groups, "g", "clone_id")


def _join_sql(how: str, by_row: bool = False) -> str:
    radius = "a.clone_id % 3 + 1" if by_row else "3"
    kept = f"""e AS (SELECT left_ix, right_ix, dist FROM edges JOIN target a ON left_ix = a.clone_id WHERE dist <= {radius}
    QUALIFY row_number() OVER (PARTITION BY left_ix ORDER BY dist, right_ix) <= 2)"""
    kind = {"inner": ("JOIN", "JOIN"), "left": ("LEFT JOIN", "LEFT JOIN"), "outer": ("LEFT JOIN", "FULL JOIN")}[how]
    return f"""WITH {T.TWO}, {edges_sql('target', 'bulk')}, {kept} SELECT a.clone_id AS clone_id_x, a.cdr3_b_aa AS cdr3_b_aa_x, b.clone_id AS clone_id_y, b.cdr3_b_aa AS cdr3_b_aa_y, dist
    FROM target a {kind[0]} e ON left_ix = a.clone_id {kind[1]} bulk b ON right_ix = b.clone_id"""


def _join(spark, d, how, **kw):
    target, bulk = T.target_and_bulk(spark, d)
    cols = ["clone_id", "cdr3_b_aa"]
    return E.join_by_distance(edit_edges(target, bulk), target.withColumn("radius", F.col("clone_id") % 3 + 1), bulk, how, "clone_id", "clone_id", 2, left_cols=cols, right_cols=cols, **kw)


@query(_join_sql("inner"))
def jon01_inner_topn(spark, d):
    return _join(spark, d, "inner")


@query(_join_sql("left"))
def jon02_left(spark, d):
    return _join(spark, d, "left")


@query(_join_sql("outer"))
def jon03_outer(spark, d):
    return _join(spark, d, "outer")


@query(_join_sql("inner", True))
def jon04_variable_radius(spark, d):
    return _join(spark, d, "inner", radius_col="radius")


@query(f"WITH {T.CLONES}, {edges_sql('clones', 'clones')} SELECT left_ix, array_to_string(list_sort(list(right_ix)), ',') AS neighbors, count(*)::BIGINT AS k_neighbors FROM edges GROUP BY left_ix")
def jon05_neighbor_lists(spark, d):
    c = T.clones(spark, d)
    return E.neighbor_lists(edit_edges(c, c)).withColumn("neighbors", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ","))


@query(f"WITH {T.CLONES}, {edges_sql('clones', 'clones', 99)} SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY left_ix ORDER BY dist, right_ix) <= 4")
def jon08_knn(spark, d):
    c = T.clones(spark, d)
    return E.nearest(all_edges(c, c), 4)


@query(f"WITH {T.CELLS} SELECT v, j FROM (SELECT DISTINCT v_b_gene AS v FROM cells), (SELECT DISTINCT j_b_gene AS j FROM cells)")
def jon11_expand_grid(spark, d):
    c = T.cells(spark, d)
    return c.select(F.col("v_b_gene").alias("v")).distinct().crossJoin(c.select(F.col("j_b_gene").alias("j")).distinct())


@query(f"""WITH {T.CLONES}, p AS (SELECT DISTINCT '^C' || substr(cdr3_b_aa, 2, 2) || '.*' || substr(cdr3_b_aa, length(cdr3_b_aa) - 2, 1) || '.F$' AS pattern FROM clones), s AS (SELECT DISTINCT cdr3_b_aa FROM clones)
SELECT pattern, count(*)::BIGINT AS hits FROM p JOIN s ON regexp_matches(cdr3_b_aa, pattern) GROUP BY pattern""")
def jon12_regex_hits(spark, d):
    s = T.clones(spark, d).select("cdr3_b_aa").distinct()
    p = s.select(F.expr("'^C' || substr(cdr3_b_aa, 2, 2) || '.*' || substr(cdr3_b_aa, length(cdr3_b_aa) - 2, 1) || '.F$'").alias("pattern")).distinct()
    return regex_hits(s, p, "cdr3_b_aa", "pattern").groupBy("pattern").agg(F.count("*").alias("hits"))


@query(f"WITH {T.TWO} SELECT cdr3_b_aa, v_b_gene, j_b_gene FROM target EXCEPT SELECT cdr3_b_aa, v_b_gene, j_b_gene FROM bulk")
def jon13_anti(spark, d):
    target, bulk = T.target_and_bulk(spark, d)
    keys = ["cdr3_b_aa", "v_b_gene", "j_b_gene"]
    return target.select(keys).join(bulk.select(keys), keys, "left_anti")


# Radii, tabulation, breadth -------------------------------------------------------------------------------------------------------

_GRID = [0.0, 1.0, 2.0, 3.0]
_ECDF = f"""ecdf AS (SELECT clone_id AS left_ix, t AS threshold, coalesce((SELECT sum(b.count)::DOUBLE FROM edges e JOIN bulk b ON right_ix = b.clone_id WHERE e.left_ix = target.clone_id AND dist <= t), 0)
  / (SELECT sum(count) FROM bulk) AS ecdf FROM target, (VALUES (0.0), (1.0), (2.0), (3.0)) AS g(t))"""


@query(f"WITH {T.TWO}, {edges_sql('target', 'bulk')}, {_ECDF} SELECT left_ix, threshold::DOUBLE AS threshold, round(ecdf, 9) AS ecdf FROM ecdf")
def ecd01_weighted_ecdf(spark, d):
    target, bulk = T.target_and_bulk(spark, d)
    e = R.distance_ecdf(edit_edges(target, bulk), target, bulk, _GRID, "count", left_id="clone_id", right_id="clone_id")
    return e.withColumn("ecdf", F.round("ecdf", 9))


@query(f"WITH {T.TWO}, {edges_sql('target', 'bulk')}, {_ECDF} SELECT left_ix, coalesce(max(threshold) FILTER (ecdf <= 0.003), 0)::DOUBLE AS radius FROM ecdf GROUP BY left_ix")
def rad01_radii(spark, d):
    target, bulk = T.target_and_bulk(spark, d)
    return R.radii(R.distance_ecdf(edit_edges(target, bulk), target, bulk, _GRID, "count", left_id="clone_id", right_id="clone_id"), 0.003)


_RAD2 = f"""{T.TWO}, {edges_sql('target', 'bulk')}, {edges_sql('target', 'target', 3, 'own')}, w AS (SELECT clone_id, count / 25.0 AS weight FROM bulk),
ecdf AS (SELECT clone_id AS left_ix, t AS threshold, coalesce((SELECT sum(weight) FROM edges e JOIN w ON right_ix = w.clone_id WHERE e.left_ix = target.clone_id AND dist <= t), 0) / (SELECT count(*) FROM bulk) AS ecdf
  FROM target, (VALUES (0.0), (1.0), (2.0), (3.0)) AS g(t)),
r AS (SELECT left_ix, coalesce(max(threshold) FILTER (ecdf <= 0.05), 0)::DOUBLE AS radius FROM ecdf GROUP BY left_ix),
n AS (SELECT left_ix, radius, (SELECT count(*) FROM own WHERE own.left_ix = r.left_ix AND dist <= radius)::DOUBLE AS h,
  coalesce((SELECT sum(weight) FROM edges e JOIN w ON right_ix = w.clone_id WHERE e.left_ix = r.left_ix AND dist <= radius), 0)::DOUBLE AS b, (SELECT count(*) FROM target)::DOUBLE AS n1, (SELECT count(*) FROM bulk)::DOUBLE AS n2 FROM r)"""


@query(f"""WITH {_RAD2} SELECT left_ix, radius, h::BIGINT AS target_hits, round(b, 6) AS bkgd_weighted, round(((h + 1) / (n1 + 2)) / ((b + 1) / (n2 + 2)), 6) AS "RR_weighted",
round(((1 + h) * (1 + n2 - b)) / ((1 + b) * (1 + n1 - h)), 6) AS "OR_weighted" FROM n""")
def rad02_background_control(spark, d):
    target, bulk = T.target_and_bulk(spark, d)
    bulk = bulk.withColumn("weight", F.col("count") / 25.0)
    out = R.background_control(edit_edges(target, target), edit_edges(target, bulk), target, bulk, 0.05, _GRID, target_id="clone_id", background_id="clone_id")
    return out.select("left_ix", "radius", "target_hits", *(F.round(c, 6).alias(c) for c in ("bkgd_weighted", "RR_weighted", "OR_weighted")))


_P = "'(' || substr(cdr3_b_aa, 4, 1) || '[' || substr(cdr3_b_aa, 5, 1) || 'AGS].?' || substr(cdr3_b_aa, 7, 2) || ')'"
_CHI_OF = lambda h, b: f"({_yates(f'1 + {h}', f'1 + n1 - {h}', f'1 + {b}', f'1 + n2 - {b}')})"


def _yates(a: str, c: str, b: str, d: str) -> str:
    """The corrected statistic of rows (a, c) and (b, d)."""
    n = f"({a} + {b} + {c} + {d})"
    cells = ((a, f"({a} + {c})", f"({a} + {b})"), (c, f"({a} + {c})", f"({c} + {d})"), (b, f"({b} + {d})", f"({a} + {b})"), (d, f"({b} + {d})", f"({c} + {d})"))
    return " + ".join(f"power(greatest(abs({x} - {r} * {k} / {n}) - 0.5, 0), 2) / ({r} * {k} / {n})" for x, r, k in cells)


@query(f"""WITH {_RAD2.replace("coalesce(max(threshold) FILTER (ecdf <= 0.05), 0)", "least(coalesce(max(threshold) FILTER (ecdf <= 0.05), 0), 2)")}, pats AS (SELECT clone_id AS left_ix, {_P} AS regex FROM target WHERE clone_id % 5 <> 0),
tre AS (SELECT regex, count(*)::DOUBLE AS th FROM (SELECT DISTINCT regex FROM pats) JOIN target ON regexp_matches(target.cdr3_b_aa, regex) GROUP BY regex),
bre AS (SELECT regex, count(*) AS bh, sum(weight)::DOUBLE AS bw FROM (SELECT DISTINCT regex FROM pats) JOIN bulk ON regexp_matches(bulk.cdr3_b_aa, regex) JOIN w USING (clone_id) GROUP BY regex),
m AS (SELECT n.*, regex, coalesce(th, 0) AS th, coalesce(bh, 0) AS bh, coalesce(bw, 0) AS bw FROM n LEFT JOIN pats USING (left_ix) LEFT JOIN tre USING (regex) LEFT JOIN bre USING (regex))
SELECT left_ix, radius, regex, th::BIGINT AS target_re_hits, bh::BIGINT AS bkgd_re_hits, round(bw, 6) AS bkgd_re_weighted, round((th + 1) / (n1 + 2), 9) AS "TR_re", round((bw + 1) / (n2 + 2), 9) AS "BR_re_weighted",
round(((h + 1) / (n1 + 2)) / ((bw + 1) / (n2 + 2)), 6) AS "RR_re_weighted", round(((1 + th) * (1 + n2 - bw)) / ((1 + bw) * (1 + n1 - th)), 6) AS "OR_re_weighted",
round({_CHI_OF("h", "b")}, 6) AS chi2dist, round({_CHI_OF("th", "bw")}, 6) AS chi2re, round(0.75 * {_CHI_OF("th", "bw")} + 0.25 * {_CHI_OF("h", "b")}, 6) AS chi2joint FROM m""")
def rad02_regex_control(spark, d):
    """Statistics of each centre's pattern beside those of its radius, joined by weights; radii are held at 2, and every fifth centre has no pattern."""
    target, bulk = T.target_and_bulk(spark, d)
    bulk = bulk.withColumn("weight", F.col("count") / 25.0)
    stats = R.background_control(edit_edges(target, target), edit_edges(target, bulk), target, bulk, 0.05, _GRID, target_id="clone_id", background_id="clone_id", most=2)
    pats = target.filter("clone_id % 5 <> 0").select(F.col("clone_id").alias("left_ix"), F.expr(_P).alias("regex"))
    out = R.regex_control(stats, pats, target, bulk, "cdr3_b_aa", beta_re=0.75, beta_dist=0.25)
    rounded = ["bkgd_re_weighted", "RR_re_weighted", "OR_re_weighted", "chi2dist", "chi2re", "chi2joint"]
    return out.select("left_ix", "radius", "regex", "target_re_hits", "bkgd_re_hits", *(F.round(c, 9).alias(c) for c in ("TR_re", "BR_re_weighted")), *(F.round(c, 6).alias(c) for c in rounded))


_SEARCH = f"""{T.TWO}, {edges_sql('target', 'bulk')}, f AS (SELECT *, count / (SELECT sum(count) FROM bulk) AS productive_frequency FROM bulk),
s AS (SELECT *, (clone_id % 3 + 1)::INT AS radius, '(' || substr(cdr3_b_aa, 3, 2) || '.?[A-M])' AS regex FROM target),
hit AS (SELECT s.clone_id AS left_ix, right_ix, s.cdr3_b_aa, s.v_b_gene, s.j_b_gene, radius, dist, f.count AS c, f.productive_frequency AS p, f.cdr3_b_aa AS hit3, regexp_matches(f.cdr3_b_aa, regex) AS motif
  FROM edges JOIN s ON left_ix = s.clone_id JOIN f ON right_ix = f.clone_id WHERE dist <= radius)"""


def _hits(spark, d):
    target, bulk = T.target_and_bulk(spark, d)
    total = bulk.agg(F.sum("count").alias("_t"))
    bulk = bulk.crossJoin(F.broadcast(total)).withColumn("productive_frequency", F.col("count") / F.col("_t")).drop("_t")
    search = target.withColumn("radius", (F.col("clone_id") % 3 + 1).cast("int")).withColumn("regex", F.expr("'(' || substr(cdr3_b_aa, 3, 2) || '.?[A-M])'"))
    hit = R.hits(edit_edges(target, bulk), search, bulk, ["cdr3_b_aa", "v_b_gene", "j_b_gene"], ["count", "productive_frequency", "v_b_gene"], "cdr3_b_aa", "clone_id", "clone_id")
    return search, hit


@query(f"""WITH {_SEARCH} SELECT clone_id AS left_ix, coalesce(sum(c), 0)::BIGINT AS radius_count, round(coalesce(sum(p), 0), 9) AS radius_freq, coalesce(sum(c) FILTER (motif), 0)::BIGINT AS motif_count,
round(coalesce(sum(p) FILTER (motif), 0), 9) AS motif_freq, coalesce(sum(c) FILTER (dist = 0), 0)::BIGINT AS exact_count, round(coalesce(sum(p) FILTER (dist = 0), 0), 9) AS exact_freq, count(right_ix)::BIGINT AS n_hits
FROM s LEFT JOIN hit ON left_ix = clone_id GROUP BY clone_id""")
def tab01_tabulate(spark, d):
    search, hit = _hits(spark, d)
    out = R.tabulate(hit, search, search_id="clone_id")
    return out.withColumns({c: F.round(c, 9) for c in ("radius_freq", "motif_freq", "exact_freq")})


@query(f"""WITH {_SEARCH} SELECT left_ix, right_ix, cdr3_b_aa || '+' || v_b_gene || '+' || j_b_gene || '+' || radius AS feature_key, hit3 AS cdr3_b_aa_hit, dist, motif AS "MOTIF" FROM hit""")
def tab03_long_form(spark, d):
    _, hit = _hits(spark, d)
    return R.long_form(hit, "cdr3_b_aa", "v_b_gene", "j_b_gene").select("left_ix", "right_ix", "feature_key", "cdr3_b_aa_hit", "dist", "MOTIF")


@query(f"""WITH {_SEARCH}, o AS (SELECT *, j_b_gene AS tag FROM hit QUALIFY row_number() OVER (PARTITION BY right_ix ORDER BY j_b_gene, dist, left_ix) = 1)
SELECT tag, round(count(*) / 5000.0, 9)::DOUBLE AS breadth, round(sum(log2(1 + c)) - log2(90000), 6) AS depth, round(count(*) / 5000.0 * sqrt(1 / 5000.0 + 1.0 / count(*)), 9) AS "SE" FROM o GROUP BY tag""")
def brd01_breadth_depth(spark, d):
    _, hit = _hits(spark, d)
    out = R.breadth_and_depth(hit.withColumn("tag", F.col("j_b_gene")), 5000, 90000, ["tag"], ["right_ix"], tie="left_ix")
    return out.select("tag", *(F.round(c, n).alias(c) for c, n in (("breadth", 9), ("depth", 6), ("SE", 9))))


# Tests -----------------------------------------------------------------------------------------------------------------------------

_TALLY = f"""{T.CLONES}, {edges_sql('clones', 'clones')}, x AS (SELECT *, j_b_gene = 'PROMO' AS t FROM clones), g AS (SELECT sum(count) FILTER (t) AS x1, sum(count) FILTER (NOT t) AS x0 FROM x),
tally AS (SELECT left_ix, coalesce(sum(count) FILTER (NOT t), 0)::BIGINT AS ct_0, coalesce(sum(count) FILTER (t), 0)::BIGINT AS ct_2 FROM edges JOIN x ON right_ix = clone_id GROUP BY left_ix),
ct AS (SELECT left_ix, ct_0, (x0 - ct_0)::BIGINT AS ct_1, ct_2, (x1 - ct_2)::BIGINT AS ct_3 FROM tally, g)"""


def _tally(spark, d):
    c = T.clones(spark, d)
    return N.tally(edit_edges(c, c), c, F.col("j_b_gene") == "PROMO", clone_id="clone_id")


@query(f"""WITH {_TALLY} SELECT *, round(CASE WHEN ct_1 * ct_2 = 0 THEN 1e9 ELSE ct_0 * ct_3 / (ct_1 * ct_2) END, 6)::DOUBLE AS odds, round((ct_0 / (ct_0 + ct_2)) / (ct_1 / (ct_1 + ct_3)), 6) AS rr FROM ct""")
def tst01_tally(spark, d):
    odds = N.odds_ratio()
    return _tally(spark, d).withColumns({"odds": F.round(F.when(odds == float("inf"), 1e9).otherwise(odds), 6), "rr": F.round(N.relative_rate(), 6)})


def _chi_sql(cells=("ct_0", "ct_1", "ct_2", "ct_3")) -> str:
    a, b, c, d = cells
    n = f"({a} + {b} + {c} + {d})"
    terms = []
    for x, r, k in ((a, f"({a} + {b})", f"({a} + {c})"), (b, f"({a} + {b})", f"({b} + {d})"), (c, f"({c} + {d})", f"({a} + {c})"), (d, f"({c} + {d})", f"({b} + {d})")):
        e = f"({r}::DOUBLE * {k} / {n})"
        terms.append(f"pow(abs({x} - {e}) - least(0.5, abs({x} - {e})), 2) / {e}")
    return " + ".join(terms)


@query(f"WITH {_TALLY} SELECT left_ix, round({_chi_sql()}, 6) AS chi2 FROM ct")
def tst04_chi2_yates(spark, d):
    return _tally(spark, d).select("left_ix", F.round(N.chi2(), 6).alias("chi2"))


_FISHER = """f AS (SELECT *, ct_0 + ct_1 + ct_2 + ct_3 AS n, ct_0 + ct_1 AS r, ct_0 + ct_2 AS k FROM ct),
u AS (SELECT left_ix, n, r, k, ct_0 AS x0, unnest(range(greatest(0, r + k - n), least(r, k) + 1)) AS x FROM f),
l AS (SELECT left_ix, x, x0, lgamma(r + 1) + lgamma(n - r + 1) + lgamma(k + 1) + lgamma(n - k + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(r - x + 1) - lgamma(k - x + 1) - lgamma(n - r - k + x + 1) AS p FROM u),
o AS (SELECT left_ix, max(p) FILTER (x = x0) AS p0 FROM l GROUP BY left_ix), v AS (SELECT left_ix, least(1, sum(exp(p)) FILTER (p <= p0 + 1e-7)) AS pvalue FROM l JOIN o USING (left_ix) GROUP BY left_ix)"""


@query(f"""WITH {_TALLY}, {_FISHER}, w AS (SELECT *, row_number() OVER (ORDER BY pvalue, left_ix) AS r, count(*) OVER () AS m FROM v)
SELECT ct.*, round(pvalue, 6) AS pvalue, round(least(1, max((m - r + 1) * pvalue) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING)), 6) AS "FWERp",
round(least(1, min(m * pvalue / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS "FDRq" FROM ct JOIN w USING (left_ix)""")
def tst04_fisher(spark, d):
    """Two-sided exact tests with both corrections."""
    out = adjusted(_tally(spark, d).withColumn("pvalue", N.fisher_p("ct_0", "ct_1", "ct_2", "ct_3")))
    return out.withColumns({c: F.round(c, 6) for c in ("pvalue", "FWERp", "FDRq")})


@query(f"""WITH {T.CELLS}, s AS (SELECT subject, sum(count) FILTER (j_b_gene = 'PROMO' AND epitope = '1-URGENT')::DOUBLE AS a, sum(count) FILTER (j_b_gene = 'PROMO' AND epitope <> '1-URGENT')::DOUBLE AS b,
sum(count) FILTER (j_b_gene <> 'PROMO' AND epitope = '1-URGENT')::DOUBLE AS c, sum(count) FILTER (j_b_gene <> 'PROMO' AND epitope <> '1-URGENT')::DOUBLE AS d FROM cells GROUP BY subject), n AS (SELECT *, a + b + c + d AS n FROM s)
SELECT 'all' AS scope, round(sum(a * d / n) / sum(b * c / n), 6) AS "OR_mh", round(pow(sum(a - (a + b) * (a + c) / n), 2) / sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))), 6) AS cmh FROM n""")
def tst04_mantel_haenszel(spark, d):
    p, u = F.col("j_b_gene") == "PROMO", F.col("epitope") == "1-URGENT"
    cell = lambda w: F.sum(F.when(w, F.col("count")).otherwise(0))
    s = T.cells(spark, d).groupBy("subject").agg(cell(p & u).alias("ct_0"), cell(p & ~u).alias("ct_1"), cell(~p & u).alias("ct_2"), cell(~p & ~u).alias("ct_3"))
    out = N.mantel_haenszel(s.withColumn("scope", F.lit("all")), ["scope"])
    return out.select("scope", F.round("OR_mh", 6).alias("OR_mh"), F.round("cmh", 6).alias("cmh"))


@query(f"WITH {T.CELLS}, {T.clones_sql('clones')}, {edges_sql('clones', 'clones')}, u AS (SELECT DISTINCT clone_id, subject FROM cells JOIN clones USING ({', '.join(T.KEYS)})) SELECT left_ix, count(DISTINCT subject)::BIGINT AS nsubject, count(DISTINCT subject) > 30 AS qpublic FROM edges JOIN u ON right_ix = clone_id GROUP BY left_ix")
def agg10_nsubject(spark, d):
    c = T.clones(spark, d)
    who = T.carriers(spark, d, c)
    out = N.members(edit_edges(c, c), who, ["subject"], "clone_id").groupBy("left_ix").agg(F.count_distinct("subject").alias("nsubject"))
    return out.withColumn("qpublic", F.col("nsubject") > 30)


@query(f"""WITH {T.CLONES}, {edges_sql('clones', 'clones')}, s AS (SELECT left_ix, j_b_gene, sum(count)::DOUBLE AS w FROM edges JOIN clones ON right_ix = clone_id GROUP BY ALL),
r AS (SELECT *, 100 * w / sum(w) OVER (PARTITION BY left_ix) AS p, row_number() OVER (PARTITION BY left_ix ORDER BY w DESC, j_b_gene) AS k FROM s)
SELECT left_ix, j_b_gene AS top_j, round(p, 6) AS percent FROM r WHERE k = 1""")
def agg08_member_summary(spark, d):
    c = T.clones(spark, d)
    m = N.members(edit_edges(c, c), c, ["j_b_gene", "count"], "clone_id")
    out = N.top_n_shares(m, ["left_ix"], "j_b_gene", F.col("count"), 1)
    return out.select("left_ix", F.col("j_b_gene").alias("top_j"), F.round("percent", 6).alias("percent"))


def greedy_sql(ranked: str, least: int = 1) -> str:
    """The greedy walk over a table (g, rank, s): sets share members within a group g only, so each group is walked by itself."""
    return f"""pos AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY rank) AS i FROM {ranked}),
walk AS (SELECT g, 0::BIGINT AS i, NULL::BIGINT AS rank, NULL::BOOLEAN AS novel, []::BIGINT[][] AS kept FROM (SELECT DISTINCT g FROM pos)
  UNION ALL SELECT w.g, p.i, p.rank, NOT x.inside, CASE WHEN x.inside THEN w.kept ELSE list_append(w.kept, p.s) END FROM walk w JOIN pos p ON p.g = w.g AND p.i = w.i + 1,
  LATERAL (SELECT len(list_filter(w.kept, lambda k: len(p.s) - len(list_intersect(p.s, k)) < {least})) > 0 AS inside) x),
novel AS (SELECT rank, novel FROM walk WHERE i > 0)"""


_SETS = f"""{T.CLONES}, {edges_sql('clones', 'clones', 2)}, n AS (SELECT left_ix, v_b_gene AS g, list_sort(list(right_ix)) AS s, count(*)::BIGINT AS k_neighbors FROM edges JOIN clones ON left_ix = clone_id GROUP BY ALL)"""
_WHO = f"""u AS (SELECT DISTINCT clone_id, subject FROM cells JOIN clones USING ({', '.join(T.KEYS)})), p AS (SELECT left_ix, count(DISTINCT subject)::BIGINT AS nsubject FROM edges JOIN u ON right_ix = clone_id GROUP BY left_ix)"""


def _listed(df: DataFrame) -> DataFrame:
    """Neighbours as text, as engines hash lists in their own ways."""
    return df.withColumn("neighbors", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ","))


@query(f"""WITH RECURSIVE {_SETS}, r AS (SELECT *, row_number() OVER (ORDER BY k_neighbors DESC, left_ix)::BIGINT AS rank FROM n), {greedy_sql('r')}
SELECT left_ix, k_neighbors, rank, array_to_string(s, ',') AS neighbors, novel FROM r JOIN novel USING (rank)""")
def set01_nonredundant(spark, d):
    """Greedy pruning of ranked neighbourhoods."""
    c = T.clones(spark, d)
    return _listed(N.nonredundant(ranked(E.neighbor_lists(edit_edges(c, c, 2)), [F.desc("k_neighbors"), "left_ix"]), "rank", "neighbors"))


@query(f"""WITH RECURSIVE {_SETS}, {_WHO}, x AS (SELECT left_ix, v_b_gene AS g, list_sort(list(DISTINCT right_ix)) AS s, count(*)::BIGINT AS k_neighbors FROM (SELECT left_ix, right_ix FROM edges JOIN u ON right_ix = u.clone_id) JOIN clones ON left_ix = clones.clone_id GROUP BY ALL),
r AS (SELECT x.*, nsubject, row_number() OVER (ORDER BY nsubject DESC, k_neighbors DESC, left_ix)::BIGINT AS rank FROM x JOIN p USING (left_ix) WHERE nsubject > 5), {greedy_sql('r')}
SELECT left_ix, k_neighbors, nsubject, array_to_string(s, ',') AS neighbors, true AS qpublic, rank, novel FROM r JOIN novel USING (rank)""")
def pub01_quasi_public(spark, d):
    c = T.clones(spark, d)
    who = T.carriers(spark, d, c)
    return _listed(N.quasi_public(edit_edges(c, c, 2), who, clone_id="clone_id", min_subjects=5))


@query(f"""WITH {T.CELLS}, r AS (SELECT v_b_gene, sum(count) AS n FROM cells GROUP BY v_b_gene), t AS (SELECT sum(n) AS t FROM r), l AS (SELECT CASE WHEN n / t < 0.04 THEN 'Other v_b_gene' ELSE v_b_gene END AS a, v_b_gene FROM r, t)
SELECT 'v_b_gene' AS first, 'j_b_gene' AS second, a, j_b_gene AS b, sum(count)::BIGINT AS n FROM cells JOIN l USING (v_b_gene) GROUP BY ALL""")
def viz01_other_fold(spark, d):
    return motifs.adjacent_pairs(T.cells(spark, d), ["v_b_gene", "j_b_gene"], "count", 0.04)


@query(f"""WITH {T.CELLS}, n AS (SELECT sum(count) AS n FROM cells), r AS (SELECT epitope, sum(count) AS r FROM cells GROUP BY epitope), k AS (SELECT j_b_gene, sum(count) AS c FROM cells GROUP BY j_b_gene),
x AS (SELECT epitope, j_b_gene, sum(count) AS x FROM cells GROUP BY ALL) SELECT epitope, j_b_gene, coalesce(x, 0)::BIGINT AS n_11, (r - coalesce(x, 0))::BIGINT AS n_10, (c - coalesce(x, 0))::BIGINT AS n_01, (n - r - c + coalesce(x, 0))::BIGINT AS n_00
FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN x USING (epitope, j_b_gene)""")
def tst06_pair_counts(spark, d):
    return N.pair_associations(T.cells(spark, d), "epitope", "j_b_gene", "count")


# Diversity, motifs, clusters, backgrounds ----------------------------------------------------------------------------------------------


@query(f"""WITH {T.CELLS}, c AS (SELECT subject, cdr3_b_aa, v_b_gene, sum(count)::DOUBLE AS c FROM cells GROUP BY ALL), n AS (SELECT subject, sum(c) AS n FROM c GROUP BY subject)
SELECT subject, round(1 - sum(pow(c / n, 2)), 9) AS simpson FROM c JOIN n USING (subject) GROUP BY subject""")
def div04_simpson(spark, d):
    c = T.cells(spark, d).groupBy("subject", "cdr3_b_aa", "v_b_gene").agg(F.sum("count").alias("count"))
    return diversity.simpson(c, ["subject"], "count").withColumn("simpson", F.round("simpson", 9))


_BY_GROUP = """c AS (SELECT subject, cdr3_b_aa, v_b_gene, sum(count)::DOUBLE AS c FROM cells GROUP BY ALL), n AS (SELECT subject, sum(c) AS n FROM c GROUP BY subject),
z AS (SELECT subject, r AS "order", n, sum(c / n * list_product([1.0::DOUBLE] || list_transform(range(1, r), lambda k: greatest(0, 1 - (c - 1) / (n - k))))) AS z,
  sum(c / n * pow(h, 2)) AS a, sum(c / n * h) AS b FROM (SELECT *, pow(1 - c / n, r) + r * c / n * pow(1 - c / n, r - 1) - pow(1 - l / n, r) - r * l / n * pow(1 - l / n, r - 1) AS h
  FROM c JOIN n USING (subject) JOIN (SELECT subject, min(c) AS l FROM c GROUP BY subject) USING (subject), (VALUES (2), (3), (5)) AS o(r)) GROUP BY subject, r, n)"""


@query(f'WITH {T.CELLS}, {_BY_GROUP} SELECT subject, "order", round(z, 8) AS "Z", round(sqrt(greatest(0, a - b * b) / n), 8) AS sd, round(1 / (1 - pow(z, 1.0 / "order")), 4) AS effective FROM z')
def div01_simpson_orders(spark, d):
    c = T.cells(spark, d).groupBy("subject", "cdr3_b_aa", "v_b_gene").agg(F.sum("count").alias("count"))
    out = diversity.generalised_simpson(c, ["subject"], "count", [2, 3, 5])
    return out.select("subject", "order", F.round("Z", 8).alias("Z"), F.round("sd", 8).alias("sd"), F.round("effective", 4).alias("effective"))


@query(f"""WITH {T.CELLS}, {_BY_GROUP.replace('subject', 'flag')}, s AS (SELECT *, greatest(0, a - b * b) / n AS v FROM z)
SELECT x."order", round(x.z - y.z, 8) AS difference, round(x.z - y.z - 1.959963984540054 * sqrt(x.v + y.v), 8) AS lower, round(x.z - y.z + 1.959963984540054 * sqrt(x.v + y.v), 8) AS upper
FROM s x JOIN s y ON x."order" = y."order" AND x.flag = 'R' AND y.flag = 'N'""")
def div03_difference(spark, d):
    """Differences of entropies with their intervals."""
    c = T.cells(spark, d).groupBy("flag", "cdr3_b_aa", "v_b_gene").agg(F.sum("count").alias("count"))
    z = diversity.generalised_simpson(c, ["flag"], "count", [2, 3, 5])
    out = diversity.simpson_difference(z.filter("flag = 'R'"), z.filter("flag = 'N'"), [])
    return out.select("order", *(F.round(c, 8).alias(c) for c in ("difference", "lower", "upper")))


@query(f"""WITH {T.CLONES}, {edges_sql('clones', 'clones')} SELECT round(1 - (SELECT sum(a.count::DOUBLE * b.count) FROM edges JOIN clones a ON left_ix = a.clone_id JOIN clones b ON right_ix = b.clone_id WHERE left_ix < right_ix AND dist <= 2) / pow((SELECT sum(count) FROM clones), 2), 9) AS fuzzy""")
def div05_fuzzy(spark, d):
    c = T.clones(spark, d)
    return diversity.fuzzy_diversity(edit_edges(c, c), c, "count", 2, "clone_id").select(F.round("fuzzy", 9).alias("fuzzy"))


@query(f"""WITH {T.CELLS}, l AS (SELECT v_b_gene, p - 1 AS place, substr(cdr3_b_aa, p, 1) AS letter FROM cells, unnest(range(1, length(cdr3_b_aa) + 1)) AS r(p) WHERE length(cdr3_b_aa) = 11),
u AS (SELECT v_b_gene, place, list_sort(list_distinct(list(letter))) AS a FROM l WHERE place BETWEEN 3 AND 8 GROUP BY ALL)
SELECT v_b_gene, '(' || string_agg(CASE WHEN len(a) = 1 THEN a[1] WHEN len(a) <= 5 THEN '[' || array_to_string(a, '') || ']' ELSE '.' END, '' ORDER BY place) || ')' AS regex FROM u GROUP BY v_b_gene""")
def rgx02_regex_build(spark, d):
    """Patterns of the strings of one length of each V gene, by place."""
    s = T.cells(spark, d).filter(F.length("cdr3_b_aa") == 11).select("v_b_gene", "cdr3_b_aa").distinct()
    letters = s.select("v_b_gene", F.posexplode(F.split("cdr3_b_aa", "(?<=.)(?=.)")).alias("place", "letter")).groupBy("v_b_gene", "place", "letter").agg(F.count("*").alias("weight"))
    return motifs.patterns(letters, "v_b_gene", max_ambiguity=5)


@query(f"""WITH RECURSIVE {T.CLONES}, {edges_sql('clones', 'clones', 2)}, x AS (SELECT left_ix, l.cdr3_b_aa AS s, r.cdr3_b_aa AS t FROM edges JOIN clones l ON left_ix = l.clone_id JOIN clones r ON right_ix = r.clone_id),
d AS (SELECT DISTINCT s, t FROM x), {T.alignment_sql('d')}, {T.patterns_sql('x')} SELECT left_ix AS centre, regex FROM pats""")
def rgx03_centroid_regex(spark, d):
    """Members aligned to their centroid, then patterns."""
    c = T.clones(spark, d)
    name = lambda s: c.select(F.col("clone_id").alias(f"{s}_ix"), F.col("cdr3_b_aa").alias(s))
    pairs = edit_edges(c, c, 2).join(name("left"), "left_ix").join(name("right"), "right_ix").select(F.col("left_ix").alias("centre"), "left", "right")
    return motifs.patterns(motifs.aligned_letters(pairs, "centre", "left", "right"), "centre", max_ambiguity=5)


@query()
def clu01_complete_linkage(spark, d):
    c = T.clones(spark, d)
    return cluster.hierarchical(edit_edges(c, c, 2), c, 2, node_id="clone_id")


@query(f"""WITH RECURSIVE {_SETS}, {_WHO}, x AS (SELECT *, j_b_gene = 'PROMO' AS t FROM clones), tot AS (SELECT sum(count) FILTER (t) AS x1, sum(count) FILTER (NOT t) AS x0 FROM x),
tally AS (SELECT left_ix, coalesce(sum(count) FILTER (NOT t), 0)::BIGINT AS ct_0, coalesce(sum(count) FILTER (t), 0)::BIGINT AS ct_2 FROM edges JOIN x ON right_ix = clone_id GROUP BY left_ix),
ct AS (SELECT left_ix, ct_0, (x0 - ct_0)::BIGINT AS ct_1, ct_2, (x1 - ct_2)::BIGINT AS ct_3 FROM tally, tot), chi AS (SELECT left_ix, round({_chi_sql()}, 6) AS chi2joint FROM ct),
r AS (SELECT n.*, nsubject, chi2joint, row_number() OVER (ORDER BY chi2joint DESC, left_ix)::BIGINT AS rank FROM n JOIN p USING (left_ix) JOIN chi USING (left_ix)), {greedy_sql('r')}
SELECT left_ix, k_neighbors, nsubject, chi2joint, array_to_string(s, ',') AS neighbors, rank, novel FROM r JOIN novel USING (rank) WHERE novel AND nsubject > 5""")
def rad04_rank(spark, d):
    c = T.clones(spark, d)
    who = T.carriers(spark, d, c)
    e = written(edit_edges(c, c, 2))
    n = N.members(e, who, ["subject"], "clone_id").groupBy("left_ix").agg(F.count_distinct("subject").alias("nsubject"))
    chi = N.tally(e, c, F.col("j_b_gene") == "PROMO", clone_id="clone_id").select("left_ix", F.round(N.chi2(), 6).alias("chi2joint"))
    return _listed(R.ranked_centres(E.neighbor_lists(e).join(n, "left_ix").join(chi, "left_ix"), min_subjects=5))


@query(f"WITH {T.CELLS}, c AS (SELECT v_b_gene, j_b_gene, cdr3_b_aa, subject FROM cells GROUP BY ALL) SELECT v_b_gene, j_b_gene, least(5, count(*))::BIGINT AS n FROM c GROUP BY ALL")
def smp01_stratified_sample(spark, d):
    """A seeded sample of five of each V-J pair; sizes are compared, as hashes differ between engines."""
    c = T.cells(spark, d).select("v_b_gene", "j_b_gene", "cdr3_b_aa", "subject").distinct()
    return background.stratified_sample(c, ["v_b_gene", "j_b_gene"], 5).groupBy("v_b_gene", "j_b_gene").agg(F.count("*").alias("n"))


@query(f"WITH {T.TWO} SELECT 'target' AS source, cdr3_b_aa, count FROM target UNION ALL SELECT 'bulk', cdr3_b_aa, count FROM bulk")
def sop01_union_all(spark, d):
    target, bulk = T.target_and_bulk(spark, d)
    return target.select(F.lit("target").alias("source"), "cdr3_b_aa", "count").unionByName(bulk.select(F.lit("bulk").alias("source"), "cdr3_b_aa", "count"))


@query(f"WITH {T.CLONES} SELECT clone_id, row_number() OVER (ORDER BY count DESC, clone_id)::INT AS rank FROM clones QUALIFY rank <= 100")
def srt01_top_100(spark, d):
    """A top-k report: the limit is the feature."""
    top = T.clones(spark, d).orderBy(F.desc("count"), "clone_id").limit(100)
    return top.select("clone_id", F.row_number().over(Window.orderBy(F.desc("count"), "clone_id")).alias("rank"))


# Composed analyses ----------------------------------------------------------------------------------------------------------------


@query(f"""WITH {T.CELLS}, n AS (SELECT sum(count)::DOUBLE AS n FROM cells), r AS (SELECT v_b_gene AS a, sum(count) AS r FROM cells GROUP BY ALL), k AS (SELECT j_b_gene AS b, sum(count) AS c FROM cells GROUP BY ALL),
x AS (SELECT v_b_gene AS a, j_b_gene AS b, sum(count) AS x FROM cells GROUP BY ALL), t AS (SELECT a, b, coalesce(x, 0) AS x, r, c, n FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN x USING (a, b))
SELECT 'v_b_gene' AS first, 'j_b_gene' AS second, a, b, x::BIGINT AS n_11, round(r / n, 9) AS p_a, round(x / n, 9) AS p_ab, round(x / r, 9) AS p_b_given_a, round(x * (n - r - c + x) / ((r - x) * (c - x)), 6) AS "OR" FROM t""")
def tst05_vj_association(spark, d):
    out = discovery.gene_associations(T.cells(spark, d), ["v_b_gene", "j_b_gene"], "count", test=False)
    return out.select("first", "second", "a", "b", "n_11", *(F.round(c, 9).alias(c) for c in ("p_a", "p_ab", "p_b_given_a")), F.round("OR", 6).alias("OR"))


_GROUPS = f"{T.CLONES}, {edges_sql('clones', 'clones', 99)}, g AS (SELECT clone_id, v_b_gene || '/' || j_b_gene AS node, count FROM clones)"


@query(f"""WITH {_GROUPS}, s AS (SELECT node, count(*) AS size, sum(count)::DOUBLE AS n FROM g GROUP BY node HAVING count(*) >= 3),
p AS (SELECT a.node, avg(dist) AS m, count(*) FILTER (dist < 3) AS u, sum(a.count::DOUBLE * b.count) FILTER (dist <= 3) AS f FROM edges JOIN g a ON left_ix = a.clone_id JOIN g b ON right_ix = b.clone_id AND a.node = b.node WHERE left_ix < right_ix GROUP BY a.node)
SELECT node, size::BIGINT AS size, round(m, 6) AS mean_dist, round(100 * u / (size * (size - 1) / 2), 6) AS pct_3, round(1 - coalesce(f, 0) / (n * n), 9) AS fuzzy_3 FROM s JOIN p USING (node)""")
def clu04_node_statistics(spark, d):
    c = T.clones(spark, d)
    groups = c.select(F.concat_ws("/", "v_b_gene", "j_b_gene").alias("node"), F.col("clone_id").alias("ix"))
    out = discovery.group_statistics(groups, all_edges(c, c), c, cuts=(3,), clone_id="clone_id")
    return out.select("node", "size", F.round("mean_dist", 6).alias("mean_dist"), F.round("pct_3", 6).alias("pct_3"), F.round("fuzzy_3", 9).alias("fuzzy_3"))


@query(f"""WITH {T.CLONES}, g AS (SELECT v_b_gene AS node, sum(count) FILTER (j_b_gene = 'PROMO') AS x, sum(count) FILTER (j_b_gene <> 'PROMO') AS y FROM clones GROUP BY v_b_gene), t AS (SELECT sum(x) AS tx, sum(y) AS ty FROM g)
SELECT node, y::BIGINT AS ct_0, (ty - y)::BIGINT AS ct_1, x::BIGINT AS ct_2, (tx - x)::BIGINT AS ct_3 FROM g, t""")
def tst02_node_tally(spark, d):
    c = T.clones(spark, d)
    return discovery.group_tally(c.select(F.col("v_b_gene").alias("node"), F.col("clone_id").alias("ix")), c, F.col("j_b_gene") == "PROMO", clone_id="clone_id")


@query()
def clu03_centroids(spark, d):
    """Complete linkage, medoids and publicity (iterative; tested against the same linkage in memory)."""
    c = T.clones(spark, d)
    return discovery.clustered(edit_edges(c, c, 2), c.withColumn("subject", F.col("j_b_gene")), 2, "subject", "complete", "clone_id")


@query(f"""WITH {_SEARCH.replace('dist <= radius', 'dist < radius')}, k AS (SELECT DISTINCT v_b_gene, list(DISTINCT cdr3_b_aa) AS seqs FROM target WHERE j_b_gene = 'PROMO' GROUP BY v_b_gene)
SELECT clone_id AS left_ix, coalesce(sum(c), 0)::BIGINT AS bulk_sum, coalesce(sum(c) FILTER (motif), 0)::BIGINT AS bulk_motif, coalesce(sum(c) FILTER (hit3 = hit.cdr3_b_aa), 0)::BIGINT AS bulk_exact,
coalesce(sum(c) FILTER (list_contains(seqs, hit3)), 0)::BIGINT AS bulk_targets FROM s LEFT JOIN hit ON left_ix = clone_id LEFT JOIN k ON s.v_b_gene = k.v_b_gene GROUP BY clone_id""")
def tab02_centres_in_bulk(spark, d):
    target, bulk = T.target_and_bulk(spark, d)
    seqs = target.filter("j_b_gene = 'PROMO'").groupBy("v_b_gene").agg(F.collect_set("cdr3_b_aa").alias("target_seqs"))
    centres = target.withColumn("radius", (F.col("clone_id") % 3 + 1).cast("int")).withColumn("regex", F.expr("'(' || substr(cdr3_b_aa, 3, 2) || '.?[A-M])'")).join(seqs, "v_b_gene", "left")
    return discovery.centres_in_bulk(edit_edges(target, bulk), centres, bulk, "cdr3_b_aa", "v_b_gene", centre_id="clone_id", bulk_id="clone_id")


@query(f"""WITH RECURSIVE {_RAD2}, near AS (SELECT own.left_ix, own.right_ix FROM own JOIN r USING (left_ix) WHERE dist <= radius),
x AS (SELECT left_ix, l.cdr3_b_aa AS s, m.cdr3_b_aa AS t FROM near JOIN target l ON left_ix = l.clone_id JOIN target m ON right_ix = m.clone_id), d AS (SELECT DISTINCT s, t FROM x), {T.alignment_sql('d')}, {T.patterns_sql('x')},
tre AS (SELECT regex, count(*)::DOUBLE AS th FROM (SELECT DISTINCT regex FROM pats) JOIN target ON regexp_matches(target.cdr3_b_aa, regex) GROUP BY regex),
bre AS (SELECT regex, sum(weight)::DOUBLE AS bw FROM (SELECT DISTINCT regex FROM pats) JOIN bulk ON regexp_matches(bulk.cdr3_b_aa, regex) JOIN w USING (clone_id) GROUP BY regex),
m AS (SELECT n.left_ix, radius, regex, coalesce(th, 0) AS th, coalesce(bw, 0) AS bw, h, b, n1, n2 FROM n LEFT JOIN pats USING (left_ix) LEFT JOIN tre USING (regex) LEFT JOIN bre USING (regex)),
k AS (SELECT left_ix, target.v_b_gene AS g, list_sort(list(right_ix)) AS s, count(*)::BIGINT AS k_neighbors, count(DISTINCT o.j_b_gene)::BIGINT AS nsubject FROM near JOIN target ON left_ix = target.clone_id JOIN target o ON right_ix = o.clone_id GROUP BY ALL),
c AS (SELECT *, {_CHI_OF("th", "bw")} + {_CHI_OF("h", "b")} AS joint FROM m JOIN k USING (left_ix)), q AS (SELECT *, row_number() OVER (ORDER BY round(joint, 9) DESC, left_ix)::BIGINT AS rank FROM c), {greedy_sql('q')}
SELECT left_ix, radius, regex, th::BIGINT AS target_re_hits, round(bw, 6) AS bkgd_re_weighted, round(joint, 3) AS chi2joint, k_neighbors, nsubject, rank, novel FROM q JOIN novel USING (rank) WHERE novel AND nsubject > 1""")
def rad05_find_metaclonotypes(spark, d):
    """The whole discovery: background-controlled radii, motifs by alignment, their own hits, the joint statistic, ranking."""
    target, bulk = T.target_and_bulk(spark, d)
    target, bulk = target.withColumn("subject", F.col("j_b_gene")), bulk.withColumn("weight", F.col("count") / 25.0)
    out = discovery.find_metaclonotypes(target, bulk, edit_edges(target, target), edit_edges(target, bulk), 0.05, _GRID, clone_id="clone_id")
    rounded = (F.round(c, n).alias(c) for c, n in (("bkgd_re_weighted", 6), ("chi2joint", 3)))
    return out.select("left_ix", "radius", "regex", "target_re_hits", *rounded, "k_neighbors", "nsubject", "rank", "novel")


from . import io_queries  # noqa: E402, F401  (adds its queries)
