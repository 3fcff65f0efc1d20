"""Patterns from aligned members of neighbourhoods."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import align
from ..functions.sequences import regex_component
from ..schema import AMINO_ACIDS


def aligned_letters(pairs: DataFrame, group: str, centroid: str, member: str, weight: str | None = None) -> DataFrame:
    """(group, place, letter, weight): the letters at each place of the centroid; what a member has between places is left out.

    Distinct (centroid, member) pairs are aligned once each.
    """
    distinct = pairs.select(F.col(centroid).alias("c"), F.col(member).alias("m")).dropna().distinct()

    def run(batches):
        for pdf in batches:
            rows = [(c, m, "".join(y for x, y in align(c, m)[1] if x != "-")) for c, m in zip(pdf["c"], pdf["m"])]
            yield pd.DataFrame(rows, columns=["c", "m", "row"])

    rows = distinct.mapInPandas(run, "c string, m string, row string")
    joined = pairs.withColumnsRenamed({centroid: "c", member: "m"}).join(rows, ["c", "m"])
    letters = joined.select(group, F.posexplode(F.split("row", "(?<=.)(?=.)")).alias("place", "letter"), (F.col(weight) if weight else F.lit(1)).alias("_w"))
    return letters.groupBy(group, "place", "letter").agg(F.sum("_w").alias("weight"))


def patterns(letters: DataFrame, group: str, ntrim: int = 3, ctrim: int = 2, max_ambiguity: int = 3) -> DataFrame:
    """(group, regex): one component for each place between the trims, in brackets; letters in the residues' order."""
    order = AMINO_ACIDS + "-"
    per = letters.filter("weight > 0").groupBy(group, "place").agg(F.sort_array(F.collect_set(F.struct(F.instr(F.lit(order), F.col("letter")).alias("o"), "letter"))).alias("_l"))
    per = per.withColumn("_r", regex_component(F.transform("_l", lambda x: x["letter"]), max_ambiguity))
    sizes = per.groupBy(group).agg(F.max("place").alias("_last"))
    used = per.join(sizes, group).filter((F.col("place") >= ntrim) & (F.col("place") <= F.col("_last") - ctrim))
    parts = used.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("place", "_r"))).alias("_p"))
    return parts.select(group, F.concat(F.lit("("), F.array_join(F.transform("_p", lambda x: x["_r"]), ""), F.lit(")")).alias("regex"))


def frequencies(letters: DataFrame, group: str) -> DataFrame:
    """(group, place, letter, weight, frequency): the table behind a sequence logo."""
    total = letters.groupBy(group, "place").agg(F.sum("weight").alias("_t"))
    return letters.join(total, [group, "place"]).select(group, "place", "letter", "weight", (F.col("weight") / F.col("_t")).alias("frequency"))


def fold_rare(df: DataFrame, columns: list[str], count: str, least: float = 0.01) -> DataFrame:
    """Levels under a share of all counts become "Other <column>"."""
    total = df.agg(F.sum(count).alias("_total"))
    for c in columns:
        share = df.groupBy(c).agg(F.sum(count).alias("_s")).crossJoin(F.broadcast(total))
        rare = share.select(F.col(c).alias("_level"), (F.col("_s") / F.col("_total") < least).alias("_rare"))
        df = df.join(rare, df[c] == rare["_level"], "left").withColumn(c, F.when(F.col("_rare"), F.lit(f"Other {c}")).otherwise(F.col(c))).drop("_level", "_rare")
    return df


def adjacent_pairs(df: DataFrame, columns: list[str], count: str, least: float = 0.01) -> DataFrame:
    """(first, second, a, b, n) of each two neighbouring columns after folding."""
    folded, out = fold_rare(df, columns, count, least), None
    for x, y in zip(columns, columns[1:]):
        part = folded.groupBy(F.lit(x).alias("first"), F.lit(y).alias("second"), F.col(x).alias("a"), F.col(y).alias("b")).agg(F.sum(count).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out
