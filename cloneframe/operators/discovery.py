"""Composed analyses: associations of genes, tests on trees and clusters, centroids, meta-clonotype discovery and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cluster as K
from . import edges as E
from . import neighbors as N
from . import radii as R
from .ranks import adjusted, ranked


def gene_associations(df: DataFrame, columns: list[str], count: str, test: bool = True) -> DataFrame:
    """Every pair of levels of every two columns: 2 x 2 cells, marginal and conditional shares, odds ratio and, if wanted, exact p with corrections over all tests."""
    out = None
    for i, x in enumerate(columns):
        for y in columns[i + 1 :]:
            part = N.pair_associations(df, x, y, count)
            named = part.select(F.lit(x).alias("first"), F.lit(y).alias("second"), F.col(x).cast("string").alias("a"), F.col(y).cast("string").alias("b"), "n_11", "n_10", "n_01", "n_00")
            out = named if out is None else out.unionByName(named)
    cells = ("n_11", "n_10", "n_01", "n_00")
    n11, n10, n01, n00 = (F.col(c).cast("double") for c in cells)
    n = n11 + n10 + n01 + n00
    out = out.withColumns({
        "p_a": (n11 + n10) / n, "p_b": (n11 + n01) / n, "p_ab": n11 / n, "p_b_given_a": F.try_divide(n11, n11 + n10), "p_a_given_b": F.try_divide(n11, n11 + n01), "OR": N.odds_ratio(cells),
    })
    return adjusted(out.withColumn("pvalue", N.fisher_p(*cells))) if test else out


def group_tally(membership: DataFrame, clones: DataFrame, trait: Column, count: str = "count", clone_id: str = "clone_ix", group: str = "node") -> DataFrame:
    """The tally of neighbourhoods for any membership table (group, ix), such as the nodes of a tree."""
    as_edges = membership.select(F.col(group).alias("left_ix"), F.col("ix").alias("right_ix"))
    return N.tally(as_edges, clones, trait, count, clone_id).withColumnRenamed("left_ix", group)


def node_differences(membership: DataFrame, clones: DataFrame, trait: str, count: str = "count", least: int = 3, clone_id: str = "clone_ix", group: str = "node") -> DataFrame:
    """The test of a trait at every node of at least ``least`` members: (group, size, test, statistic, pvalue, FWERp, FDRq).

    Two levels: Fisher's exact test with the odds ratio. More: the Pearson statistic of levels in and out of the node, with p from levels - 1 degrees of
    freedom. One: nothing to test. The levels are those of the whole table.
    """
    levels = [r[0] for r in clones.select(trait).dropna().distinct().orderBy(trait).limit(3).collect()]
    sizes = membership.groupBy(group).agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    if len(levels) < 2:
        return sizes.select(group, "size", F.lit("none").alias("test"), *(F.lit(None).cast("double").alias(c) for c in ("statistic", "pvalue", "FWERp", "FDRq")))
    if len(levels) == 2:
        t = group_tally(membership, clones, F.col(trait) == levels[1], count, clone_id, group).join(sizes, group)
        out = adjusted(t.withColumn("pvalue", N.fisher_p(*N.CELLS)))
        return out.select(group, "size", F.lit("fishers").alias("test"), N.odds_ratio().alias("statistic"), "pvalue", "FWERp", "FDRq")
    own = clones.filter(F.col(trait).isNotNull()).select(F.col(clone_id).alias("ix"), F.col(trait).alias("_t"), F.col(count).cast("double").alias("_c"))
    inside = membership.join(sizes, group).join(own, "ix").groupBy(group, "size", "_t").agg(F.sum("_c").alias("_in"))
    totals = own.groupBy("_t").agg(F.sum("_c").alias("_all"))
    whole = totals.agg(F.sum("_all").alias("_n"), (F.count("*") - 1).cast("int").alias("_df"))
    # Levels that a node lacks add their expectation inside; so the sum over those that it has is completed from the totals.
    per = inside.join(totals, "_t").crossJoin(F.broadcast(whole))
    size = per.groupBy(group).agg(F.sum("_in").alias("_k"), F.sum("_all").alias("_seen"))
    per = per.join(size, group)
    e = F.col("_all") * F.col("_k") / F.col("_n")
    out = F.col("_all") - e
    term = (F.col("_in") - e) * (F.col("_in") - e) * (F.try_divide(F.lit(1.0), e) + F.coalesce(F.try_divide(F.lit(1.0), out), F.lit(0.0)))
    chi = per.groupBy(group, "size", "_k", "_seen", "_n", "_df").agg(F.sum(term).alias("_x"))
    # An absent level with expectation e inside and all - e outside adds e^2 / e + e^2 / (all - e) = e n / (n - k).
    missing = (F.col("_n") - F.col("_seen")) * F.col("_k") / F.col("_n") * F.try_divide(F.col("_n"), F.col("_n") - F.col("_k"))
    out = chi.select(group, "size", F.lit("chi2").alias("test"), (F.col("_x") + F.coalesce(missing, F.lit(0.0))).alias("statistic"), "_df")
    return adjusted(out.withColumn("pvalue", N.chi2_tail(F.col("statistic"), F.col("_df")))).select(group, "size", "test", "statistic", "pvalue", "FWERp", "FDRq")


def group_statistics(membership: DataFrame, edges: DataFrame, clones: DataFrame, count: str = "count", cuts: tuple[float, ...] = (25, 50, 75), least: int = 3, clone_id: str = "clone_ix", group: str = "node") -> DataFrame:
    """Per group of at least ``least`` members: size, mean distance of its pairs, shares of pairs under each cut, and fuzzy diversity at each.

    ``edges`` must reach as far as the pairs do; absent pairs count as beyond every cut, and are left out of the mean.
    """
    m = membership.select(F.col(group).alias("_g"), F.col("ix")).join(clones.select(F.col(clone_id).alias("ix"), F.col(count).cast("double").alias("_c")), "ix")
    sizes = m.groupBy("_g").agg(F.count("*").alias("size"), F.sum("_c").alias("_n")).filter(F.col("size") >= least)
    a = m.select("_g", F.col("ix").alias("left_ix"), F.col("_c").alias("_a"))
    b = m.select(F.col("_g").alias("_h"), F.col("ix").alias("right_ix"), F.col("_c").alias("_b"))
    inner = edges.filter("left_ix < right_ix").join(a, "left_ix").join(b, "right_ix").filter("_g = _h")
    under = lambda t: F.coalesce(F.sum(F.when(F.col("dist") < t, 1)), F.lit(0))
    near = lambda t: F.coalesce(F.sum(F.when(F.col("dist") <= t, F.col("_a") * F.col("_b"))), F.lit(0.0))
    sums = inner.groupBy("_g").agg(F.avg("dist").alias("mean_dist"), *(under(t).alias(f"_u{t}") for t in cuts), *(near(t).alias(f"_f{t}") for t in cuts))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    out = sizes.join(sums, "_g", "left").fillna(0, [f"_{k}{t}" for t in cuts for k in "uf"])
    return out.select(
        F.col("_g").alias(group), "size", "mean_dist", *((100 * F.col(f"_u{t}") / pairs).alias(f"pct_{t}") for t in cuts),
        *((1 - F.col(f"_f{t}") / (F.col("_n") * F.col("_n"))).alias(f"fuzzy_{t}") for t in cuts),
    )


def cluster_centroids(edges: DataFrame, clones: DataFrame, assigned: DataFrame, subject: str, clone_id: str = "clone_ix", public_over: int = 1) -> DataFrame:
    """(cluster_id, medoid, size, n_levels, public, rank) of a clustering (ix, cluster_id), largest first."""
    groups = assigned.withColumnRenamed("ix", clone_id)
    centre = E.medoids(edges, groups, "cluster_id", clone_id)
    who = N.publicity(groups.join(clones.select(clone_id, subject), clone_id), ["cluster_id"], subject, public_over)
    out = centre.join(groups.groupBy("cluster_id").agg(F.count("*").alias("size")), "cluster_id").join(who, "cluster_id")
    return ranked(out, [F.desc("size"), "cluster_id"])


def clustered(edges: DataFrame, clones: DataFrame, t: float, subject: str, method: str = "ward", clone_id: str = "clone_ix") -> DataFrame:
    """Linkage cut at t, then centroids."""
    return cluster_centroids(edges, clones, K.hierarchical(edges, clones, t, method, node_id=clone_id), subject, clone_id)


def centres_in_bulk(
    edges: DataFrame, centres: DataFrame, bulk: DataFrame, cdr3: str, v: str, count: str = "count", targets: str = "target_seqs", centre_id: str = "clone_ix", bulk_id: str = "clone_ix"
) -> DataFrame:
    """Per centre, zero-hit ones included: bulk counts strictly within the radius, of those with the motif, of equal V and CDR3, and of CDR3s in the centre's own list."""
    hit = R.hits(edges, centres, bulk, [cdr3, v, targets], [cdr3, v, count], cdr3, centre_id, bulk_id, strict=True)
    c = F.col(f"{count}_hit")
    total = lambda w: F.coalesce(F.sum(F.when(w, c)), F.lit(0))
    same = (F.col(cdr3) == F.col(f"{cdr3}_hit")) & (F.col(v) == F.col(f"{v}_hit"))
    sums = hit.groupBy("left_ix").agg(
        F.sum(c).alias("bulk_sum"), total(F.col("MOTIF")).alias("bulk_motif"), total(same).alias("bulk_exact"), total(F.array_contains(targets, F.col(f"{cdr3}_hit"))).alias("bulk_targets")
    )
    return centres.select(F.col(centre_id).alias("left_ix")).join(sums, "left_ix", "left").fillna(0)


def find_metaclonotypes(
    target: DataFrame, background: DataFrame, target_edges: DataFrame, background_edges: DataFrame, control: float, thresholds: list[float], subject: str = "subject",
    cdr3: str = "cdr3_b_aa", weight: str = "weight", clone_id: str = "clone_ix", min_subjects: int = 1, max_ambiguity: int = 5,
    beta_re: float = 1.0, beta_dist: float = 1.0, most: float | None = None,
) -> DataFrame:
    """From a target and a weighted background to ranked centres: radius, rates, motif, statistics of distance and of the motif's own hits with their
    weighted sum ``chi2joint``, neighbours, subjects; best first by ``chi2joint``, pruned of near-subsets."""
    from . import motifs

    stats = R.background_control(target_edges, background_edges, target, background, control, thresholds, weight, clone_id, clone_id, most)
    own = E.within(target_edges, stats.withColumnRenamed("left_ix", clone_id), None, clone_id, "radius")
    name = lambda s: target.select(F.col(clone_id).alias(f"{s}_ix"), F.col(cdr3).alias(f"_{s}"))
    pairs = own.join(name("left"), "left_ix").join(name("right"), "right_ix").select(F.col("left_ix").alias("centre"), "_left", "_right")
    regex = motifs.patterns(motifs.aligned_letters(pairs, "centre", "_left", "_right"), "centre", max_ambiguity=max_ambiguity).withColumnRenamed("centre", "left_ix")
    lists = E.neighbor_lists(own)
    people = N.members(own, target, [subject], clone_id).groupBy("left_ix").agg(F.count_distinct(subject).alias("nsubject"))
    tested = R.regex_control(stats, regex, target, background, cdr3, weight, beta_re, beta_dist)
    # Ranks are by nine decimals. Equal centres tie at any size of the statistic, as the weighted sums behind it are exact.
    out = tested.join(lists, "left_ix").join(people, "left_ix").withColumn("chi2joint", F.round("chi2joint", 9))
    return R.ranked_centres(out, min_subjects=min_subjects)
