"""Which strings match which patterns, without trying each pattern on each string.

Patterns of this domain are letters, classes of letters and dots, some of them optional. Two or three such places at fixed offsets spell a few literal
combinations, one of which stands in any string that matches. For each pattern the places are chosen whose combinations fewest strings have, by count, and
only strings that share one of its combinations are tried. Patterns that aren't of this form, or have no such places, try every string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

#: Offsets of the second and third letter from the first; a third of 0 means that there are two.
SHAPES = [(1, 2), (1, 3), (2, 3), (1, 0), (2, 0), (3, 0)]
#: A class that spells more letters than this is treated as a dot, and places that spell more combinations than this together are not used.
WIDEST, MOST = 6, 50
_TOKEN = r"(\[[A-Za-z]+\]|[A-Za-z.])([?*]?)"
_SIMPLE = rf"^\^?\(?({_TOKEN})*\)?\$?$"


def _shapes() -> Column:
    return F.explode(F.array(*(F.struct(F.lit(i).alias("shape"), F.lit(b).alias("b"), F.lit(c).alias("c")) for i, (b, c) in enumerate(SHAPES)))).alias("_s")


def string_keys(strings: DataFrame, string: str) -> DataFrame:
    """(string, key): every combination of letters that a distinct string has at the offsets."""
    places = strings.select(string, _shapes()).withColumn("_i", F.explode(F.sequence(F.lit(1), F.length(string))))
    places = places.filter(F.col("_i") + F.greatest("_s.b", "_s.c") <= F.length(string))
    at = lambda k: F.substr(string, F.col("_i") + F.col(k), F.lit(1))
    key = F.concat(F.col("_s.shape").cast("string"), F.lit(":"), F.substr(string, F.col("_i"), F.lit(1)), at("_s.b"), F.when(F.col("_s.c") > 0, at("_s.c")).otherwise(""))
    return places.select(string, key.alias("key")).distinct()


def pattern_keys(patterns: DataFrame, pattern: str) -> DataFrame:
    """(pattern, place, shape, key): for each choice of places that every match must fill side by side, the combinations that it spells."""
    whole = F.regexp_extract_all(F.col(pattern), F.lit(_TOKEN), F.lit(0))
    token = lambda t: F.struct(F.regexp_replace(t, r"[\[\].?*]", "").alias("letters"), t.rlike(r"[?*]$").alias("loose"))
    tokens = patterns.filter(F.col(pattern).rlike(_SIMPLE)).select(pattern, F.transform(whole, token).alias("_t"))
    places = tokens.select(pattern, "_t", _shapes()).withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_t")))).withColumn("_last", F.col("_i") + F.greatest("_s.b", "_s.c")).filter(F.col("_last") < F.size("_t"))
    letters = lambda k: F.split(F.get("_t", F.col("_i") + k)["letters"], "(?<=.)(?=.)")
    usable = lambda x: F.size(x).between(1, WIDEST) & (F.element_at(x, 1) != "")
    first, second, third = letters(F.lit(0)), letters(F.col("_s.b")), F.when(F.col("_s.c") > 0, letters(F.col("_s.c"))).otherwise(F.array(F.lit("")))
    fixed = ~F.exists(F.slice("_t", F.col("_i") + 1, F.col("_last") - F.col("_i") + 1), lambda t: t["loose"])
    few = F.size(first) * F.size(second) * F.size(third) <= MOST
    fit = places.filter(fixed & usable(first) & usable(second) & ((F.col("_s.c") == 0) | usable(third)) & few).select(pattern, F.col("_i").alias("place"), F.col("_s.shape").alias("shape"), first.alias("_x"), second.alias("_y"), third.alias("_z"))
    for c in "xyz":
        fit = fit.withColumn(f"_{c}", F.explode(f"_{c}"))
    return fit.select(pattern, "place", "shape", F.concat(F.col("shape").cast("string"), F.lit(":"), "_x", "_y", "_z").alias("key")).distinct()


def regex_candidates(strings: DataFrame, patterns: DataFrame, string: str, pattern: str) -> DataFrame:
    """(string, pattern) of distinct strings and patterns that are left to be tried."""
    have, spelt = written(string_keys(strings, string)), written(pattern_keys(patterns, pattern))
    counts = have.join(spelt.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("_n"))
    cost = spelt.join(counts, "key", "left").groupBy(pattern, "place", "shape").agg(F.sum(F.coalesce("_n", F.lit(0))).alias("_cost"))
    best = cost.groupBy(pattern).agg(F.min(F.struct("_cost", "shape", "place")).alias("_b")).select(pattern, F.col("_b.place").alias("place"), F.col("_b.shape").alias("shape"))
    found = spelt.join(best, [pattern, "place", "shape"]).select(pattern, "key").join(have, "key").select(string, pattern).distinct()
    rest = patterns.join(best.select(pattern), pattern, "left_anti")
    return found.union(strings.join(rest).select(string, pattern))


def regex_hits(strings: DataFrame, patterns: DataFrame, string: str, pattern: str) -> DataFrame:
    """Each row of ``strings`` with each row of ``patterns`` that it matches (anywhere, unless the pattern has anchors); none for nulls."""
    s, p = (written(df.select(c).dropna().distinct()) for df, c in ((strings, string), (patterns, pattern)))
    hits = regex_candidates(s, p, string, pattern).filter(F.expr(f"`{string}` rlike `{pattern}`"))
    return strings.join(hits, string).join(patterns, pattern)
