"""Neighbourhood aggregates: members, publicity, tallies and their tests, pruning."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.sequences import percent_strings
from ..sources.store import written
from .clones import filter_query
from .ranks import ranked


def members(edges: DataFrame, clones: DataFrame, columns: list[str], clone_id: str = "clone_ix") -> DataFrame:
    """Edges with the right row's columns."""
    return edges.join(clones.select(F.col(clone_id).alias("right_ix"), *columns), "right_ix")


def top_n_string(df: DataFrame, group: list[str], level: str, weight: Column, n: int, name: str) -> DataFrame:
    """(group, name): the n heaviest levels as "b (88.6%), a (8.8%)". Levels are summed before they are gathered."""
    sums = df.groupBy(*group, level).agg(F.sum(weight.cast("double")).alias("w"))
    gathered = sums.groupBy(*group).agg(F.collect_list(F.struct("w", F.col(level).cast("string").alias("k"))).alias("_a"))
    return gathered.select(*group, percent_strings("_a", n).alias(name))


def top_n_shares(df: DataFrame, group: list[str], level: str, weight: Column, n: int) -> DataFrame:
    """(group, level, percent, rank): the same as rows."""
    sums = df.groupBy(*group, level).agg(F.sum(weight.cast("double")).alias("_w"))
    total, order = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(F.desc("_w"), level)
    ranked = sums.withColumns({"percent": 100 * F.col("_w") / F.sum("_w").over(total), "rank": F.row_number().over(order)})
    return ranked.filter(F.col("rank") <= n).select(*group, level, "percent", "rank")


def five_numbers(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Minimum, quartiles by midpoints, maximum of each group; nulls don't count, and a group of nothing else has nulls.

    Distinct values are counted, and ranks run over ranges of values (a quarter of a binary order of magnitude each) before they run within the few ranges that
    hold a wanted rank. No group is gathered.
    """
    v = F.col("_v").cast("double")
    part = F.signum(v) * F.coalesce(F.floor(4 * F.log2(F.abs(v)) + 8000), F.lit(0))
    # A struct's fields are equal if both are null, so null groups join like others.
    counts = written(df.groupBy(F.struct(*group).alias("_g"), F.col(value).alias("_v")).agg(F.count(value).alias("_c")).withColumn("_b", part))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.filter("_c > 0").groupBy("_g", "_b").agg(F.sum("_c").alias("_n"))
    ranges = ranges.withColumns({"_start": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy("_g"))})
    at = lambda q: (F.col("_all") - 1) * F.lit(q)
    names = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}
    wanted = F.array(*(F.struct(F.lit(n).alias("name"), f(at(q)).cast("long").alias("rank")) for n, q in names.items() for f in (F.floor, F.ceil)))
    wanted = ranges.select("_g", "_b", "_start", F.explode(F.filter(wanted, lambda w: (w["rank"] >= F.col("_start")) & (w["rank"] < F.col("_start") + F.col("_n")))).alias("_w"))
    inside = Window.partitionBy("_g", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    held = counts.filter("_c > 0").join(wanted.select("_g", "_b").distinct(), ["_g", "_b"], "left_semi").withColumn("_to", F.sum("_c").over(inside))
    found = wanted.join(held, ["_g", "_b"]).filter((F.col("_w.rank") - F.col("_start") < F.col("_to")) & (F.col("_w.rank") - F.col("_start") >= F.col("_to") - F.col("_c")))
    picked = found.groupBy("_g").agg(*(F.avg(F.when(F.col("_w.name") == n, F.col("_v").cast("double"))).alias(n) for n in names))
    return counts.select("_g").distinct().join(picked, "_g", "left").select("_g.*", *names)


def publicity(df: DataFrame, group: list[str], level: str, n: int = 1) -> DataFrame:
    """(group, n_levels, public): public if more than n distinct levels."""
    out = df.groupBy(*group).agg(F.count_distinct(level).alias("n_levels"))
    return out.withColumn("public", F.when(F.col("n_levels") > n, "public").otherwise("private"))


def member_summary(edges: DataFrame, clones: DataFrame, columns: dict[str, int], count: str = "count", clone_id: str = "clone_ix") -> DataFrame:
    """For each left row, the top-n string of each column by summed count."""
    joined, out = members(edges, clones, [*columns, count], clone_id), None
    for c, n in columns.items():
        part = top_n_string(joined, ["left_ix"], c, F.col(count), n, c)
        out = part if out is None else out.join(part, "left_ix")
    return out


def summarise(df: DataFrame, membership: DataFrame, key: str, member: str, schema: str, f) -> DataFrame:
    """Any ``f(DataFrame of pandas) -> DataFrame`` over groups that may overlap. Groups must fit in a task each."""
    return membership.join(df, member).groupBy(key).applyInPandas(f, schema)


def tally(edges: DataFrame, clones: DataFrame, trait: Column, count: str = "count", clone_id: str = "clone_ix") -> DataFrame:
    """Counts of a binary trait in and out of each neighbourhood: ct_0 (without, in), ct_1 (without, out), ct_2 (with, in), ct_3 (with, out)."""
    own = clones.select(F.col(clone_id).alias("right_ix"), trait.cast("boolean").alias("_t"), F.col(count).alias("_n"))
    side = lambda t: F.sum(F.when(F.col("_t") == t, F.col("_n")).otherwise(0))
    inside = edges.join(own, "right_ix").groupBy("left_ix").agg(side(F.lit(False)).alias("ct_0"), side(F.lit(True)).alias("ct_2"))
    totals = own.agg(side(F.lit(False)).alias("_x0"), side(F.lit(True)).alias("_x1"))
    return inside.crossJoin(F.broadcast(totals)).select("left_ix", "ct_0", (F.col("_x0") - F.col("ct_0")).alias("ct_1"), "ct_2", (F.col("_x1") - F.col("ct_2")).alias("ct_3"))


def tallies(edges: DataFrame, clones: DataFrame, traits: list[str], count: str = "count", clone_id: str = "clone_ix", stratum: str | None = None) -> DataFrame:
    """(left_ix, trait, level[, stratum], ct_0..ct_3): the cells of ``tally`` for each level that a neighbourhood has of each of several traits, in one pass; with a
    ``stratum``, for each stratum that it has, as ``mantel_haenszel`` takes them. Null levels and strata don't count."""
    by = [stratum] if stratum else []
    stacked = F.explode(F.array(*(F.struct(F.lit(t).alias("trait"), F.col(t).cast("string").alias("level")) for t in traits))).alias("_s")
    own = clones.select(F.col(clone_id).alias("right_ix"), *by, F.col(count).alias("_n"), stacked).select("right_ix", *by, "_n", "_s.trait", "_s.level").dropna(subset=["level", *by])
    near = written(edges.select("left_ix", "right_ix").join(own, "right_ix").groupBy("left_ix", "trait", "level", *by).agg(F.sum("_n").alias("ct_2")))
    level = own.groupBy("trait", "level", *by).agg(F.sum("_n").alias("_with"))
    whole = level.groupBy("trait", *by).agg(F.sum("_with").alias("_all"))
    inside = near.groupBy("left_ix", "trait", *by).agg(F.sum("ct_2").alias("_in"))
    rows = near.select("left_ix", "trait", "level").distinct().join(inside, ["left_ix", "trait"])
    rows = rows.join(near, ["left_ix", "trait", "level", *by], "left").join(level, ["trait", "level", *by], "left").join(whole, ["trait", *by]).fillna(0, ["ct_2", "_with"])
    out = rows.withColumns({"ct_0": F.col("_in") - F.col("ct_2"), "ct_3": F.col("_with") - F.col("ct_2")}).withColumn("ct_1", F.col("_all") - F.col("_with") - F.col("ct_0"))
    return out.select("left_ix", "trait", "level", *by, *CELLS)


def _c(names) -> list[Column]:
    return [F.col(n).cast("double") for n in names]


CELLS = ("ct_0", "ct_1", "ct_2", "ct_3")


def odds_ratio(names=CELLS, pseudo: float = 0.0) -> Column:
    """(a / c) / (b / d) of cells a, b, c, d, each with a pseudo-count; infinite where it divides by zero."""
    a, b, c, d = (x + pseudo for x in _c(names))
    return F.when(b * c == 0, F.lit(float("inf"))).otherwise(F.try_divide(a * d, b * c))


def relative_rate(names=CELLS) -> Column:
    """[a / (a + c)] / [b / (b + d)]."""
    a, b, c, d = _c(names)
    return F.try_divide(F.try_divide(a, a + c), F.try_divide(b, b + d))


def rate(pos: Column, neg: Column, pseudo: float = 1.0) -> Column:
    return (pos + pseudo) / (pos + neg + 2 * pseudo)


def chi2(names=CELLS, yates: bool = True) -> Column:
    """The 2 x 2 statistic with the continuity correction of at most one half; null for empty margins."""
    a, b, c, d = _c(names)
    n, total = a + b + c + d, None
    for x, row, col in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)):
        e = F.try_divide(row * col, n)
        off = F.abs(x - e)
        off = off - F.least(F.lit(0.5), off) if yates else off
        term = F.try_divide(off * off, e)
        total = term if total is None else total + term
    return total


#: Terms of the series and of the fraction below: more change no digit.
_TERMS = 70


def chi2_tail(statistic: Column, degrees: Column) -> Column:
    """The upper tail of chi-square for any whole number of degrees from 1 on: null for a null or less.

    With h = x / 2, Q(a + 1) = Q(a) + h^a exp(-h) / gamma(a + 1), so a finite sum leads from exp(-h) for two degrees, or erfc(sqrt(h)) for one,
    to any other. The latter is one minus a power series for small h, and a continued fraction from its end for others.
    """
    h, start = statistic.cast("double") / 2, F.when(degrees % 2 == 0, 1.0).otherwise(0.5)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(_TERMS)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, i: F.struct((a["t"] * h / (i + 0.5)).alias("t"), (a["s"] + a["t"] * h / (i + 0.5)).alias("s")), lambda a: a["s"],
    )
    small = 1 - series * F.exp(-h) * F.sqrt(h) * (2 / math.sqrt(math.pi))
    fraction = F.aggregate(F.sequence(F.lit(_TERMS), F.lit(1), F.lit(-1)), F.sqrt(h), lambda t, i: F.sqrt(h) + i / (2 * t))
    first = F.when(degrees % 2 == 0, F.exp(-h)).when(h < 4, small).otherwise(F.exp(-h) / (fraction * math.sqrt(math.pi)))
    ln = F.ln(h)
    # The logarithm of h^a / gamma(a + 1) goes on from that of a = 1, or of a = 1 / 2.
    zero = F.struct(F.when(degrees % 2 == 0, ln).otherwise(ln / 2 - math.log(math.sqrt(math.pi) / 2)).alias("l"), F.lit(0.0).alias("s"))
    step = lambda a, i: F.struct((a["l"] + ln - F.ln(start + i)).alias("l"), (a["s"] + F.exp(a["l"] - h)).alias("s"))
    steps = F.when(degrees > 2, F.sequence(F.lit(1), F.floor((degrees - 1) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(h.isNull() | (degrees < 1), None).when(h <= 0, 1.0).otherwise(F.least(F.lit(1.0), first + F.aggregate(steps, zero, step, lambda a: a["s"])))


def chi2_p(statistic) -> Column:
    """The upper tail with one degree of freedom."""
    return chi2_tail(F.col(statistic) if isinstance(statistic, str) else statistic, F.lit(1))


def _fisher(a: int, b: int, c: int, d: int) -> float:
    """The sum over all tables of these margins that are no likelier; beyond fifty deviations from the mode and the table nothing is left to add."""
    n, row, col = a + b + c + d, a + b, a + c
    low, high = max(0, row + col - n), min(row, col)
    if low == high:
        return 1.0
    mode = (row + 1) * (col + 1) // (n + 2)
    spread = 50 + int(50 * math.sqrt(row * col / n * (n - row) / n * (n - col) / max(1, n - 1)))
    first, last = max(low, min(a, mode) - spread), min(high, max(a, mode) + spread)
    x = np.arange(first, last, dtype=float)
    steps = np.log((row - x) * (col - x)) - np.log((x + 1) * (n - row - col + x + 1))
    p = np.r_[0.0, np.cumsum(steps)]
    p -= p.max()
    return float(min(1.0, np.exp(p[p <= p[a - first] + 1e-7]).sum() / np.exp(p).sum()))


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided: the probability of tables no likelier than this one; null for a null cell. Equal tables are computed once a batch."""
    known: dict[tuple, float] = {}
    out = []
    for t in zip(a, b, c, d):
        if any(x is None or x != x for x in t):
            out.append(None)
            continue
        if t not in known:
            known[t] = _fisher(*map(int, t))
        out.append(known[t])
    return pd.Series(out, dtype=float)


def mantel_haenszel(df: DataFrame, group: list[str], names=CELLS) -> DataFrame:
    """(group, OR_mh, cmh): the common odds ratio over strata and the statistic without correction."""
    a, b, c, d = _c(names)
    n = a + b + c + d
    sums = df.groupBy(*group).agg(
        F.sum(a * d / n).alias("_r"), F.sum(b * c / n).alias("_s"), F.sum(a - (a + b) * (a + c) / n).alias("_o"),
        F.sum(F.when(n > 1, (a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1)))).alias("_v"),
    )
    return sums.select(*group, F.try_divide("_r", "_s").alias("OR_mh"), F.try_divide(F.col("_o") * F.col("_o"), "_v").alias("cmh"))


def breslow_day(df: DataFrame, group: list[str], names=CELLS, tarone: bool = True) -> DataFrame:
    """(group, OR_mh, strata, breslow_day): do the strata share one odds ratio? Chi-square with strata - 1 degrees of freedom.

    With a stratum's margins and the common odds ratio, the expected first cell solves a quadratic; ``tarone`` subtracts the correction
    for the estimated ratio. Strata with an empty margin say nothing and are left out.
    """
    common = mantel_haenszel(df, group, names).select(*group, "OR_mh")
    a, b, c, d = _c(names)
    full = df.filter((a + b > 0) & (c + d > 0) & (a + c > 0) & (b + d > 0)).join(common, group)
    psi, row, col, n = F.col("OR_mh"), a + b, a + c, a + b + c + d
    # psi = e (n - row - col + e) / ((row - e)(col - e)), as p2 e^2 + p1 e + p0 = 0
    p2, p1, p0 = 1 - psi, n - row - col + psi * (row + col), -psi * row * col
    root = F.sqrt(p1 * p1 - 4 * p2 * p0)
    # The root between the cell's bounds; the linear case by itself.
    e = F.when(F.abs(p2) < 1e-12, -p0 / p1).otherwise((-p1 + root) / (2 * p2))
    full = full.withColumns({"_a": a, "_e": e}).withColumn("_v", 1 / (1 / F.col("_e") + 1 / (row - F.col("_e")) + 1 / (col - F.col("_e")) + 1 / (n - row - col + F.col("_e"))))
    off = F.col("_a") - F.col("_e")
    sums = full.groupBy(*group).agg(F.first("OR_mh").alias("OR_mh"), F.count("*").alias("strata"), F.sum(off * off / F.col("_v")).alias("_x"), F.sum(off).alias("_o"), F.sum("_v").alias("_v"))
    corrected = F.col("_x") - F.try_divide(F.col("_o") * F.col("_o"), "_v") if tarone else F.col("_x")
    return sums.select(*group, "OR_mh", "strata", corrected.alias("breslow_day"))


def pair_associations(df: DataFrame, first: str, second: str, count: str) -> DataFrame:
    """(first, second, n_11, n_10, n_01, n_00) of every pair of levels; levels are distinct values, a small set by nature."""
    cells = written(df.groupBy(first, second).agg(F.sum(count).alias("n_11")))
    rows, cols = cells.groupBy(first).agg(F.sum("n_11").alias("_r")), cells.groupBy(second).agg(F.sum("n_11").alias("_c"))
    total = cells.agg(F.sum("n_11").alias("_n"))
    every = rows.crossJoin(cols).crossJoin(F.broadcast(total)).join(cells, [first, second], "left").withColumn("n_11", F.coalesce("n_11", F.lit(0)))
    return every.select(
        first, second, "n_11", (F.col("_r") - F.col("n_11")).alias("n_10"), (F.col("_c") - F.col("n_11")).alias("n_01"),
        (F.col("_n") - F.col("_r") - F.col("_c") + F.col("n_11")).alias("n_00"),
    )


def nonredundant(df: DataFrame, rank: str, neighbors: str, least_difference: int = 1) -> DataFrame:
    """Adds ``novel``: false where the row's set is (almost) within the set of an earlier kept row, that is with fewer than ``least_difference`` members outside.

    If fewer than that many members are outside, one of any ``least_difference`` members is inside: so a row's possible supersets are found by
    an equi-join on its rarest members, and then checked. A row is settled once an earlier superset is kept, or all are settled as not
    kept; rounds go on until all rows are. Ranks must differ.
    """
    k = F.lit(least_difference)
    rows = written(df.select(F.col(rank).alias("_r"), F.array_distinct(neighbors).alias("_s")))
    items = rows.select("_r", F.explode("_s").alias("_m"))
    often = items.groupBy("_m").agg(F.count("*").alias("_n"))
    rare = items.join(often, "_m").groupBy("_r").agg(F.slice(F.array_sort(F.collect_list(F.struct("_n", "_m"))), 1, least_difference).alias("_few"))
    keys = rare.select(F.col("_r").alias("_late"), F.explode(F.col("_few._m")).alias("_m"))
    pairs = keys.join(items.withColumnRenamed("_r", "_early"), "_m").filter("_early < _late").select("_early", "_late").distinct()
    sets = lambda r, s: rows.select(F.col("_r").alias(r), F.col("_s").alias(s))
    within = pairs.join(sets("_early", "_big"), "_early").join(sets("_late", "_own"), "_late").filter(F.size(F.array_except("_own", "_big")) < k)
    # Sets smaller than that are within any other: all but the first of all are out.
    small = rows.filter(F.size("_s") < k).crossJoin(F.broadcast(rows.agg(F.min("_r").alias("_first")))).filter("_r > _first")
    inside = written(within.select("_early", "_late").union(small.select("_first", "_r")).distinct())
    state = written(rows.select("_r", F.lit(None).cast("boolean").alias("novel")))
    while not state.filter("novel is null").isEmpty():
        known = inside.join(state.select(F.col("_r").alias("_early"), F.col("novel").alias("_k")), "_early").groupBy(F.col("_late").alias("_r"))
        seen = known.agg(F.max(F.coalesce("_k", F.lit(False))).alias("_in"), F.max(F.col("_k").isNull()).alias("_open"))
        settled = F.when(F.coalesce("_in", F.lit(False)), F.lit(False)).when(~F.coalesce("_open", F.lit(False)), F.lit(True))
        state = written(state.join(seen, "_r", "left").select("_r", F.coalesce("novel", settled).alias("novel")))
    return df.join(state.withColumnRenamed("_r", rank), rank).select(*df.columns, "novel")


def quasi_public(
    edges: DataFrame, clones: DataFrame, subject: str = "subject", min_subjects: int = 1, query: str | None = None, summary: dict[str, int] | None = None,
    least_difference: int = 1, clone_id: str = "clone_ix",
) -> DataFrame:
    """Neighbourhoods with their size, subjects and member summaries, ranked, with ``novel`` for those not within a better one. ValueError if the query leaves none."""
    joined = members(edges, clones, [subject], clone_id)
    report = joined.groupBy("left_ix").agg(
        F.count("*").alias("k_neighbors"), F.count_distinct(subject).alias("nsubject"), F.sort_array(F.collect_set("right_ix")).alias("neighbors")
    )
    report = report.withColumn("qpublic", F.col("nsubject") > min_subjects)
    if summary:
        report = report.join(member_summary(edges, clones, summary, clone_id=clone_id), "left_ix")
    report = filter_query(report, query) if query else report.filter("qpublic")
    report = written(report)
    if report.isEmpty():
        raise ValueError("no neighbourhood is left")
    return nonredundant(ranked(report, [F.desc("nsubject"), F.desc("k_neighbors"), "left_ix"]), "rank", "neighbors", least_difference)
