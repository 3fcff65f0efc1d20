"""Background-controlled radii, tabulation of meta-clonotypes in bulk repertoires, breadth and depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .neighbors import chi2, nonredundant, odds_ratio, rate
from .ranks import ranked
from .regex_join import regex_hits


#: Weights of up to ten digits before the point and eighteen after it are summed as decimals.
_DECIMAL = "decimal(28,18)"


def _exact(weight: str) -> Column:
    """A weight as (exact, rest): a decimal if it is one, else a double. The last digits of a sum of doubles depend on the order of rows, so equal centres would differ; a sum of decimals is exact."""
    w = F.col(weight).cast("double")
    d = w.try_cast(_DECIMAL)
    same = F.coalesce(d.cast("double") == w, F.lit(False))
    return F.struct(F.when(same, d).alias("exact"), F.when(~same, w).alias("rest"))


def _summed(name: str, over=None) -> Column:
    """The sum of such weights, again as (exact, rest)."""
    part = lambda k: F.sum(f"{name}.{k}") if over is None else F.sum(f"{name}.{k}").over(over)
    return F.struct(part("exact").alias("exact"), part("rest").alias("rest"))


def _double(weight: Column) -> Column:
    exact, rest = weight["exact"].cast("double"), weight["rest"]
    return F.coalesce(exact + rest, exact, rest)


def distance_ecdf(
    edges: DataFrame, left: DataFrame, weights: DataFrame, thresholds: list[float] | None = None, weight: str = "weight", pseudo_count: float = 0.0,
    skip_self: bool = False, absolute: bool = False, left_id: str = "clone_ix", right_id: str = "clone_ix",
) -> DataFrame:
    """(left_ix, threshold, ecdf): the weighted share of right rows within each threshold, for every left row.

    Without thresholds, every distance of the left row itself is one. ``skip_self`` leaves out the right row of the same
    id, above and below. ``absolute`` divides by the number of right rows.
    """
    w = weights.select(F.col(right_id).alias("right_ix"), _exact(weight).alias("_w"))
    totals = w.agg((F.count("*").cast("double") if absolute else _double(_summed("_w"))).alias("_total"))
    used = edges.filter("left_ix <> right_ix") if skip_self else edges
    per = used.join(w, "right_ix").groupBy("left_ix", "dist").agg(_summed("_w").alias("_w"))
    lefts = left.select(F.col(left_id).alias("left_ix"))
    base = lefts.crossJoin(F.broadcast(totals))
    if skip_self:
        base = base.join(w.select(F.col("right_ix").alias("left_ix"), _double(F.col("_w")).alias("_own")), "left_ix", "left")
        base = base.withColumn("_total", F.col("_total") - (F.lit(1.0) if absolute else F.coalesce("_own", F.lit(0.0)))).drop("_own")
    if thresholds is None:
        run = Window.partitionBy("left_ix").orderBy("dist").rowsBetween(Window.unboundedPreceding, 0)
        grid = per.select("left_ix", F.col("dist").alias("threshold"), _double(_summed("_w", run)).alias("_in"))
        out = base.join(grid, "left_ix")
    else:
        # One row for each left row and first threshold that takes the distance in, then running sums over the grid.
        steps = F.array(*(F.lit(float(t)) for t in sorted(thresholds)))
        first = per.withColumn("threshold", F.array_min(F.filter(steps, lambda t: t >= F.col("dist")))).filter("threshold is not null")
        sums = first.groupBy("left_ix", "threshold").agg(_summed("_w").alias("_w"))
        run = Window.partitionBy("left_ix").orderBy("threshold").rowsBetween(Window.unboundedPreceding, 0)
        grid = base.withColumn("threshold", F.explode(steps)).join(sums, ["left_ix", "threshold"], "left")
        out = grid.withColumn("_in", F.coalesce(_double(_summed("_w", run)), F.lit(0.0)))
    return out.select("left_ix", "threshold", ((F.col("_in") + pseudo_count) / (F.col("_total") + pseudo_count)).alias("ecdf"))


def geometric_mean(column) -> Column:
    """10 to the mean of log10."""
    return F.pow(F.lit(10.0), F.avg(F.log10(column)))


def step_vectors(ecdf: DataFrame) -> DataFrame:
    """(left_ix, x, y): corners of each row's ECDF as a step line, from (least threshold, 0) on: each threshold twice, before and after its rise."""
    run = Window.partitionBy("left_ix").orderBy("threshold")
    before = F.coalesce(F.lag("ecdf").over(run), F.lit(0.0))
    corner = lambda y, k: F.struct(F.col("threshold").alias("x"), y.alias("y"), F.lit(k).alias("k"))
    steps = ecdf.withColumn("_c", F.array(corner(before, 0), corner(F.col("ecdf"), 1)))
    return steps.select("left_ix", F.explode("_c").alias("_c")).select("left_ix", "_c.x", "_c.y", F.col("_c.k").alias("corner"))


def radii(ecdf: DataFrame, control: float) -> DataFrame:
    """(left_ix, radius): the largest threshold whose ECDF is at most the control level, else 0."""
    return ecdf.groupBy("left_ix").agg(F.coalesce(F.max(F.when(F.col("ecdf") <= control, F.col("threshold"))), F.lit(0.0)).alias("radius"))


def _contrasts(df: DataFrame, hits: str, weighted: str, suffix: str, chi: str, rate_hits: str | None = None) -> DataFrame:
    """Adds rates, relative rate, odds ratio and chi-square of hits among n1 targets against weighted hits among n2 of the background."""
    h, b, n1, n2 = (F.col(c).cast("double") for c in (hits, weighted, "n1", "n2"))
    cells = {"_a": h, "_b": b, "_c": n1 - h, "_d": n2 - b}
    ones = {f"{k}1": F.col(k) + 1 for k in cells}
    out = df.withColumns({f"TR{suffix}": rate(h, n1 - h), f"BR{suffix}_weighted": rate(b, n2 - b), **cells}).withColumns(ones)
    out = out.withColumn(f"RR{suffix}_weighted", F.col(rate_hits or f"TR{suffix}") / F.col(f"BR{suffix}_weighted"))
    return out.withColumns({f"OR{suffix}_weighted": odds_ratio(tuple(cells), 1.0), chi: chi2(("_a1", "_c1", "_b1", "_d1"))}).drop(*cells, *ones)


def background_control(
    target_edges: DataFrame, background_edges: DataFrame, target: DataFrame, background: DataFrame, control: float, thresholds: list[float],
    weight: str = "weight", target_id: str = "clone_ix", background_id: str = "clone_ix", most: float | None = None,
) -> DataFrame:
    """Per target clone: radius, hits in target and background, weighted hits, rates, relative rate, odds ratio and chi-square (``chi2dist``) of the distance hits."""
    background_edges = written(background_edges)  # read for the radii and for the hits
    ecdf = distance_ecdf(background_edges, target, background, thresholds, weight, absolute=True, left_id=target_id, right_id=background_id)
    chosen = radii(ecdf, control)
    chosen = written(chosen.withColumn("radius", F.least("radius", F.lit(float(most)))) if most is not None else chosen)
    w = background.select(F.col(background_id).alias("right_ix"), _exact(weight).alias("_w"))
    near = lambda e: e.join(chosen, "left_ix").filter(F.col("dist") <= F.col("radius"))
    hits = near(target_edges).groupBy("left_ix").agg(F.count("*").alias("target_hits"))
    bg = near(background_edges).join(w, "right_ix").groupBy("left_ix").agg(F.count("*").alias("bkgd_hits"), _double(_summed("_w")).alias("bkgd_weighted"))
    sizes = target.agg(F.count("*").alias("n1")).crossJoin(background.agg(F.count("*").alias("n2")))
    out = chosen.join(hits, "left_ix", "left").join(bg, "left_ix", "left").fillna(0, ["target_hits", "bkgd_hits", "bkgd_weighted"]).crossJoin(F.broadcast(sizes))
    return _contrasts(out, "target_hits", "bkgd_weighted", "", "chi2dist")


def regex_control(
    stats: DataFrame, patterns: DataFrame, target: DataFrame, background: DataFrame, cdr3: str, weight: str = "weight", beta_re: float = 1.0, beta_dist: float = 1.0
) -> DataFrame:
    """Adds to ``background_control`` each centre's ``regex`` from ``patterns`` (left_ix, regex) and its statistics: hits among all target and background clones, weighted hits,
    rates, relative rate (the centre's distance rate TR over the background's regex rate, as published), odds ratio, ``chi2re``, and
    ``chi2joint`` = beta_re chi2re + beta_dist chi2dist. Centres without a pattern have no regex hits."""
    own = patterns.select("left_ix", "regex")
    distinct = own.select("regex").dropna().distinct()

    def counted(clones: DataFrame, sums: list[Column]) -> DataFrame:
        return regex_hits(clones, distinct, cdr3, "regex").groupBy("regex").agg(*sums)

    inside = counted(target.select(cdr3), [F.count("*").alias("target_re_hits")])
    outside = counted(background.select(cdr3, _exact(weight).alias("_w")), [F.count("*").alias("bkgd_re_hits"), _double(_summed("_w")).alias("bkgd_re_weighted")])
    out = stats.join(own, "left_ix", "left").join(inside, "regex", "left").join(outside, "regex", "left").fillna(0, ["target_re_hits", "bkgd_re_hits", "bkgd_re_weighted"])
    out = _contrasts(out, "target_re_hits", "bkgd_re_weighted", "_re", "chi2re", "TR")
    return out.withColumn("chi2joint", beta_re * F.col("chi2re") + beta_dist * F.col("chi2dist"))


def ranked_centres(centres: DataFrame, neighbors: str = "neighbors", by: str = "chi2joint", min_subjects: int = 2, least_difference: int = 1, tie: str = "left_ix") -> DataFrame:
    """Best first, pruned of near-subsets, then those with more subjects than ``min_subjects``: pruning comes first, and the bound is strict."""
    best_first = ranked(centres, [F.desc(by), tie])
    return nonredundant(best_first, "rank", neighbors, least_difference).filter(F.col("novel") & (F.col("nsubject") > min_subjects))


def hits(
    edges: DataFrame, search: DataFrame, bulk: DataFrame, search_cols: list[str], bulk_cols: list[str], cdr3: str, search_id: str = "clone_ix", bulk_id: str = "clone_ix",
    strict: bool = False,
) -> DataFrame:
    """One row per bulk clone within a search row's radius: search columns, bulk columns with ``_hit``, dist, and MOTIF, whether its CDR3 matches the regex."""
    a = search.select(F.col(search_id).alias("left_ix"), *dict.fromkeys([*search_cols, "radius", "regex"]))
    b = bulk.select(F.col(bulk_id).alias("right_ix"), *(F.col(c).alias(f"{c}_hit") for c in dict.fromkeys([*bulk_cols, cdr3])))
    near = F.col("dist") < F.col("radius") if strict else F.col("dist") <= F.col("radius")
    return edges.join(a, "left_ix").filter(near).join(b, "right_ix").withColumn("MOTIF", F.coalesce(F.expr(f"`{cdr3}_hit` rlike regex"), F.lit(False)))


def tabulate(hit: DataFrame, search: DataFrame, count: str = "count", frequency: str = "productive_frequency", cdr3: str = "cdr3_b_aa", search_id: str = "clone_ix", lists: bool = False) -> DataFrame:
    """Per search row, zero-hit rows included: sums of count and frequency within the radius, with the motif as well, and at distance 0."""
    c, f = F.col(f"{count}_hit"), F.col(f"{frequency}_hit")
    total = lambda x, when: F.sum(F.when(when, x))
    parts = {
        "radius_count": F.sum(c), "radius_freq": F.sum(f), "motif_count": total(c, F.col("MOTIF")), "motif_freq": total(f, F.col("MOTIF")),
        "exact_count": total(c, F.col("dist") == 0), "exact_freq": total(f, F.col("dist") == 0), "n_hits": F.count("*"),
    }
    aggregates = [x.alias(n) for n, x in parts.items()]
    if lists:
        aggregates.append(F.sort_array(F.collect_list(F.struct("right_ix", F.col(f"{cdr3}_hit").alias("cdr3"), "dist", c.alias("count"), f.alias("frequency"), "MOTIF"))).alias("hits"))
    out = search.select(F.col(search_id).alias("left_ix")).join(hit.groupBy("left_ix").agg(*aggregates), "left_ix", "left").fillna(0, list(parts))
    return out.withColumn("hits", F.coalesce("hits", F.array().cast(out.schema["hits"].dataType))) if lists else out


def long_form(hit: DataFrame, cdr3: str, v: str, j: str) -> DataFrame:
    """Adds feature_key, CDR3+V+J+radius."""
    return hit.withColumn("feature_key", F.concat_ws("+", cdr3, v, j, F.col("radius").cast("string")))


def breadth_and_depth(
    long: DataFrame, n_total: int, m_total: float, breadth_cols: list[str] | None, clonal_cols: list[str], count: str = "count_hit", motif: bool = False,
    exact: bool = False, tie: str = "feature_key", order: tuple[str, ...] = ("tag", "dist"),
) -> DataFrame:
    """Per group: breadth n/N, depth (sum of log2(1 + count), less log2(M) once) and the breadth's standard error. Each clone counts once, by its first hit in the order given."""
    used = long.filter("MOTIF") if motif else long
    used = used.filter("dist <= 0") if exact else used
    used = used.dropna(subset=clonal_cols)
    first = Window.partitionBy(*clonal_cols).orderBy(*order, tie)
    once = used.withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    groups = breadth_cols or []
    n = F.count("*").cast("double")
    out = once.groupBy(*groups).agg(n.alias("n_clones"), (F.sum(F.log2(1 + F.col(count))) - F.log2(F.lit(float(m_total)))).alias("depth"))
    breadth = F.col("n_clones") / float(n_total)
    return out.withColumns({"breadth": breadth, "SE": breadth * F.sqrt(F.lit(1.0 / n_total) + 1 / F.col("n_clones"))})


def safe_block(n1: int, n2: int, most: float = 1e7) -> int:
    """Left rows of a block whose pairs with all right rows stay under a target."""
    return n1 if n1 * n2 < most else -(-n1 // max(1, -(-n1 * n2 // int(most))))
