"""Ranks and running extremes over whole tables without one task that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written


def ranked(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Adds 1..N in the order given, which should leave no ties.

    The sorted table is dealt by ranges and written; a row's rank is its place within its range plus the rows of all ranges before,
    a running sum over one row per range.
    """
    placed = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed.withColumns({"_part": F.shiftright("_at", 33), "_nth": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, "_part").withColumn(name, (F.col("_start") + F.col("_nth") + 1).cast("long")).drop("_part", "_nth", "_start")




def _bucket(p: str) -> Column:
    x = F.col(p)
    return F.when(x >= 0.001, F.floor(x * 1000)).otherwise(F.floor(10 * F.log10(F.greatest(x, F.lit(1e-307))))).cast("long")


def adjusted(df: DataFrame, p: str = "pvalue") -> DataFrame:
    """Adds FWERp (Holm) and FDRq (Benjamini-Hochberg); rows without a p have neither and are no tests.

    Equal p share their results, so the distinct ones are counted first. Running counts and extremes are made within buckets of p and
    carried on over the table of buckets, a few thousand rows whatever the input.
    """
    known = df.filter(F.col(p).isNotNull())
    one = known.groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_c")).withColumn("_b", _bucket("_p"))
    up = Window.partitionBy("_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_b").orderBy("_p").rowsBetween(0, Window.unboundedFollowing)
    sizes = one.groupBy("_b").agg(F.sum("_c").alias("_k"))
    all_before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_k").over(all_before), F.lit(0)).alias("_off"), F.sum("_k").over(Window.partitionBy()).alias("_n"))
    placed = one.join(offsets, "_b").withColumn("_last", F.col("_off") + F.sum("_c").over(up))
    placed = placed.withColumns({"_h": (F.col("_n") - F.col("_last") + F.col("_c")) * F.col("_p"), "_q": F.col("_n") * F.col("_p") / F.col("_last")})
    inner = placed.withColumns({"_h": F.max("_h").over(up), "_q": F.min("_q").over(down)})
    ends = placed.groupBy("_b").agg(F.max("_h").alias("_bh"), F.min("_q").alias("_bq"))
    later = Window.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select("_b", F.max("_bh").over(all_before).alias("_before"), F.min("_bq").over(later).alias("_after"))
    done = inner.join(carried, "_b").select(
        "_p", F.least(F.lit(1.0), F.greatest("_h", "_before")).alias("FWERp"), F.least(F.lit(1.0), F.least("_q", "_after")).alias("FDRq")
    )
    return df.join(done, F.col(p) == F.col("_p"), "left").drop("_p")
