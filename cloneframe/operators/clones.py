"""Clones from cells: keys, deduplication, filters, gene usage and weights."""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import MetricSpec, default_spec
from ..schema import CHAINS, NOT_KEYS, check_chains, check_organism, columns_of, require
from ..sources.store import written


def index_columns(df: DataFrame) -> list[str]:
    """All columns that make a clone: those other than counts and ids."""
    return [c for c in df.columns if c not in NOT_KEYS]


def number_rows(df: DataFrame, keys: list[str], name: str = "clone_id") -> DataFrame:
    """1..N in the order of the keys, without one task that sorts everything.

    Rows are numbered within the values of the first two keys (put genes first, as few rows share one pair), and each
    pair's start is the count of all pairs before it, a running sum over the table of pairs alone.
    """
    prefix, df = keys[:2], written(df)  # counted and numbered: what it is made from may be far larger
    counts = df.groupBy(prefix).agg(F.count("*").alias("_n"))
    before = Window.orderBy(*prefix).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(c).alias(f"_{c}") for c in prefix), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*prefix).orderBy(*keys)
    same = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in prefix))
    return df.withColumn("_own", F.row_number().over(own)).join(starts, same).select(*df.columns, (F.col("_start") + F.col("_own")).alias(name))


def deduplicate(cells: DataFrame, keys: list[str] | None = None, number: bool = True) -> DataFrame:
    """Sums ``count`` by the keys; rows with any null key vanish. ``clone_id`` numbers clones in the order of the keys."""
    keys = keys or index_columns(cells)
    require(cells, keys)
    counted = cells if "count" in cells.columns else cells.withColumn("count", F.lit(1).cast("long"))
    out = counted.dropna(subset=keys).groupBy(*keys).agg(F.sum("count").alias("count"))
    return number_rows(out, keys) if number else out


def incomplete(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The rows that deduplication drops: any key is null."""
    return cells.filter(functools.reduce(operator.or_, (F.col(c).isNull() for c in keys or index_columns(cells))))


def first_values(df: DataFrame, group: list[str], order: list[Column | str], columns: list[str] | None = None) -> DataFrame:
    """Per group the first value that isn't null of each column, by the order given; groups with a null key vanish. One aggregate, no window."""
    others = columns or [c for c in df.columns if c not in group]
    key = F.struct(*((F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(key.alias("k"), F.col(c).alias("v"))))["v"].alias(c)
    return df.dropna(subset=group).groupBy(*group).agg(*(first(c) for c in others))


def filter_is(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == value)


def filter_gt(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) > value)


def filter_lt(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) < value)


def filter_in(df: DataFrame, column: str, values) -> DataFrame:
    """Rows whose value is one of a list; of a string, those whose value is part of it."""
    return df.filter(F.contains(F.lit(values), F.col(column)) if isinstance(values, str) else F.col(column).isin(list(values)))


def sql_of_query(query: str) -> str:
    """A user's comparison expression as SQL: ``&``, ``|``, ``~``, ``==``, True and False; quoted parts stay."""
    words = {"&": " AND ", "|": " OR ", "~": " NOT ", "==": "=", "True": "true", "False": "false"}
    parts = re.split(r"('[^']*'|\"[^\"]*\")", query)
    plain = lambda p: re.sub(r"==|[&|~]|\bTrue\b|\bFalse\b", lambda m: words[m[0]], p)
    return "".join("'" + p[1:-1].replace("'", "''") + "'" if p[:1] in ("'", '"') else plain(p) for p in parts)


def filter_query(df: DataFrame, query: str) -> DataFrame:
    """Each comparison joined by & or | should stand in brackets or bind tighter, as in SQL."""
    return df.filter(sql_of_query(query))


def is_subset(small: Column, large: Column) -> Column:
    return F.size(F.array_except(small, large)) == 0


def is_almost_subset(small: Column, large: Column, least_difference: int) -> Column:
    """Fewer than ``least_difference`` members of ``small`` are missing in ``large``."""
    return F.size(F.array_except(small, large)) < least_difference


def legacy_fields(df: DataFrame, chains: list[str]) -> DataFrame:
    """Gene columns under the old names; gamma takes the place of alpha, delta that of beta."""
    slot = {"alpha": "a", "beta": "b", "gamma": "a", "delta": "b"}
    for chain in chains:
        x = CHAINS[chain]
        for part in "vj":
            if f"{part}_{x}_gene" in df.columns:
                df = df.withColumn(f"{part}{slot[chain]}_gene", F.col(f"{part}_{x}_gene"))
    return df


def gene_usage(clones: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n): rows of each combination."""
    return clones.groupBy(*columns).agg(F.count("*").alias("n"))


def usage_weights(clones: DataFrame, columns: list[str], expected: str, name: str = "weights") -> DataFrame:
    """Adds expected frequency over observed frequency of each combination. Counts are aggregated, then joined, so no combination is gathered whole."""
    usage = gene_usage(clones, columns).withColumnRenamed("n", "_n")
    total = clones.agg(F.count("*").alias("_total"))
    return clones.join(usage.crossJoin(F.broadcast(total)), columns).withColumn(name, F.col(expected) / (F.col("_n") / F.col("_total"))).drop("_n", "_total")


def stratified_usage(background: DataFrame, v: str = "v_reps", j: str = "j_reps", subject: str = "subject") -> dict[str, DataFrame]:
    """Frequencies of V, J and V-J where every subject weighs the same; each table sums to 1."""
    cells = written(background.groupBy(subject, v, j).agg(F.count("*").alias("_c")))
    sizes = cells.groupBy(subject).agg(F.sum("_c").alias("_n"))
    subjects = sizes.agg(F.count("*").alias("_k"))
    weighed = cells.join(sizes, subject).crossJoin(F.broadcast(subjects)).withColumn("w", F.col("_c") / (F.col("_n") * F.col("_k")))
    by = lambda keys, name: weighed.groupBy(*keys).agg(F.sum("w").alias(name))
    return {"vj": by([v, j], "pVJ"), "v": by([v], "pV"), "j": by([j], "pJ")}


def with_gene_frequencies(df: DataFrame, tables: dict[str, DataFrame], v: str = "v_reps", j: str = "j_reps") -> DataFrame:
    """Adds pV, pJ, pVJ; combinations that the tables lack get the smallest frequency there."""
    for key, columns, name in (("v", [v], "pV"), ("j", [j], "pJ"), ("vj", [v, j], "pVJ")):
        least = tables[key].agg(F.min(name).alias("_least"))
        df = df.join(tables[key], columns, "left").crossJoin(F.broadcast(least)).withColumn(name, F.coalesce(name, "_least")).drop("_least")
    return df


def infer_cdrs(clones: DataFrame, genes: DataFrame, chain: str, organism: str, gaps: bool = True) -> DataFrame:
    """Adds the three germline loops of the V gene; genes that the table lacks give null. The table is joined as Spark sees fit: it is small by its nature."""
    from ..functions.sequences import cdrs_of

    names = columns_of(chain)
    kind = {"alpha": "A", "gamma": "A", "beta": "B", "delta": "B"}[chain]
    loops = genes.filter((F.col("organism") == organism) & (F.col("chain") == kind) & (F.col("region") == "V")).select(
        F.col("id").alias(names["v"]), cdrs_of("aligned_protseq", "cdr_columns", gaps).alias("_loops")
    )
    with_loops = clones.join(loops, names["v"], "left")
    for i, part in enumerate(("cdr1", "cdr2", "pmhc")):
        with_loops = with_loops.withColumn(names[part], F.get("_loops", F.lit(i)))
    return with_loops.drop("_loops")


def unknown_genes(clones: DataFrame, genes: DataFrame, chain: str, organism: str) -> DataFrame:
    """(gene, n): the V genes of clones that the gene table lacks, whose loops ``infer_cdrs`` leaves null, and how many clones name them."""
    v = columns_of(chain)["v"]
    kind = {"alpha": "A", "gamma": "A", "beta": "B", "delta": "B"}[chain]
    known = genes.filter((F.col("organism") == organism) & (F.col("chain") == kind) & (F.col("region") == "V")).select(F.col("id").alias("gene"))
    named = clones.groupBy(F.col(v).alias("gene")).agg(F.count("*").alias("n")).filter("gene IS NOT NULL")
    return named.join(known, "gene", "left_anti")


@dataclass(frozen=True)
class Repertoire:
    """An immutable clone table with what it was made from: no matrices are kept, and nothing runs before an action."""

    clones: DataFrame
    chains: tuple[str, ...]
    organism: str
    specs: dict[str, MetricSpec] = field(default_factory=dict)

    #: Clones beyond which all pairs need a radius.
    MOST_DENSE = 10_000

    @classmethod
    def from_cells(cls, cells: DataFrame, organism: str, chains: list[str], genes: DataFrame | None = None, keys: list[str] | None = None) -> Repertoire:
        check_organism(organism)
        check_chains(chains)
        for chain in chains:
            names = columns_of(chain)
            require(cells, [names["cdr3"], names["v"]])
            if genes is not None:
                cells = infer_cdrs(cells, genes, chain, organism)
        clones = deduplicate(cells, keys)
        loops = lambda c: all(columns_of(c)[p] in clones.columns for p in ("cdr1", "cdr2", "pmhc"))
        return cls(clones, tuple(chains), organism, {c: default_spec(CHAINS[c], cdr3_only=not loops(c)) for c in chains})

    def edges(self, chain: str, radius: float | None = None, other: DataFrame | None = None) -> DataFrame:
        from .edges import radius_join

        right = self.clones if other is None else other
        if radius is None and max(self.clones.count(), right.count()) > self.MOST_DENSE:
            raise ValueError(f"more than {self.MOST_DENSE} clones: give a radius")
        return radius_join(self.clones, right, self.specs[chain], radius, left_id="clone_id", right_id="clone_id")
