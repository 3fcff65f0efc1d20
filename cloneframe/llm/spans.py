"""Matches of an expression with their places, as native columns that are linear in a text's matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one inner sum takes; it bounds what appending copies, not what is summed.
STEP = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(sizes: Column) -> Column:
    """For each element, the sum of all before it. Sums go in steps of ``STEP`` elements, then over the steps: no growing array is copied for each element."""

    def step(k: Column) -> Column:
        last = F.least((k + 1) * STEP, F.size(sizes)) - 1
        return F.aggregate(
            F.sequence(k * STEP, last),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, i: F.struct((acc["at"] + F.get(sizes, i)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        )

    steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / STEP).cast("int")), step)
    whole = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out")),
        lambda acc, s: F.struct((acc["at"] + s["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(s["out"], lambda x: x + acc["at"]))).alias("out")),
        lambda acc: F.flatten(acc["out"]),
    )
    return F.when(F.size(sizes) == 0, F.array().cast("array<int>")).otherwise(whole)


def pieces(text: Column, pattern: str) -> Column:
    """What lies between the leftmost non-overlapping matches, and the matches, in turn: array<string> of odd size that joins to the text."""
    return let(
        F.split(text, pattern, -1),
        lambda gaps: let(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda found: F.flatten(F.transform(gaps, lambda g, i: F.when(i < F.size(found), F.array(g, F.get(found, i))).otherwise(F.array(g)))),
        ),
    )


def matches(text: Column, pattern: str, keep: Callable[[Column], Column], before: int, after: int) -> Column:
    """array<struct(start, end, match, before, after)> of the matches that ``keep`` accepts: places in code points, end exclusive, and
    so many code points on either side. A kept match looks at ``before + after`` pieces at most, so the sides cost no pass over the text."""

    def hits(p: Column) -> Column:
        def sides(starts: Column) -> Column:
            odd = F.filter(F.sequence(F.lit(1), F.size(p) - 1, F.lit(2)), lambda i: keep(F.get(p, i)))

            def hit(i: Column) -> Column:
                match, start = F.get(p, i), F.get(starts, i)
                left = F.transform(F.sequence(F.greatest(i - before - 1, F.lit(0)), i - 1), lambda j: F.right(F.get(p, j), F.lit(before)))
                right = F.transform(F.sequence(i + 1, F.least(i + after + 1, F.size(p) - 1)), lambda j: F.left(F.get(p, j), F.lit(after)))
                return F.struct(
                    start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"),
                    F.right(F.array_join(left, ""), F.lit(before)).alias("before"), F.left(F.array_join(right, ""), F.lit(after)).alias("after"),
                )

            return F.transform(odd, hit)

        return F.when(F.size(p) > 1, let(let(F.transform(p, lambda x: F.length(x)), running), sides))

    return let(pieces(text, pattern), hits)
