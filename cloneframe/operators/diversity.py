"""Diversity of repertoires: one aggregate per repertoire, whatever its size."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of clones for running sums, at least, and about how many clones one has where there are more.
BUCKETS, BUCKET_ROWS = 256, 1_000_000


def simpson(df: DataFrame, group: list[str], count: str) -> DataFrame:
    """1 - sum of squared shares."""
    sums = df.groupBy(*group).agg(F.sum(count).alias("_n"), F.sum(F.col(count).cast("double") * F.col(count)).alias("_q"))
    return sums.select(*group, (1 - F.col("_q") / (F.col("_n").cast("double") * F.col("_n"))).alias("simpson"))


def generalised_simpson(df: DataFrame, group: list[str], count: str, orders: list[int], alpha: float = 0.05, last: str | None = None) -> DataFrame:
    """(group, order, Z, sd, lower, upper, effective, n): unbiased entropies sum p prod_{k<r} (1 - (c - 1)/(n - k)) of the orders r >= 2.

    The deviation is by the delta method over all categories but the last: with g(p) = (1 - p)^r + r p (1 - p)^(r - 1) and h = g(p) - g(p of the
    last), its square is h' Sigma h / n for the multinomial Sigma, that is (sum p h^2 - (sum p h)^2) / n; the last category's own h is zero. The last is the
    one with the greatest ``last``; without it, the rarest.
    """
    final = F.max_by(count, last) if last else F.min(count)
    totals = df.groupBy(*group).agg(F.sum(count).cast("double").alias("_n"), final.cast("double").alias("_l"))
    x = df.join(totals, group).select("*", F.explode(F.array(*map(F.lit, orders))).alias("order"))
    c, n, p = F.col(count).cast("double"), F.col("_n"), F.col(count).cast("double") / F.col("_n")
    product = F.aggregate(F.sequence(F.lit(1), F.col("order") - 1), F.lit(1.0), lambda a, k: a * F.greatest(F.lit(0.0), 1 - (c - 1) / (n - k)))
    g = lambda p: F.pow(1 - p, F.col("order")) + F.col("order") * p * F.pow(1 - p, F.col("order") - 1)
    h = F.when(p > 0, g(p) - g(F.col("_l") / n)).otherwise(0.0)
    sums = x.groupBy(*group, "order").agg(F.sum(p * product).alias("Z"), F.first("_n").alias("_n"), F.sum(p * h * h).alias("_a"), F.sum(p * h).alias("_b"))
    z = NormalDist().inv_cdf(1 - alpha / 2)
    out = sums.withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), F.col("_a") - F.col("_b") * F.col("_b")) / F.col("_n")))
    return out.select(
        *group, "order", "Z", "sd", (F.col("Z") - z * F.col("sd")).alias("lower"), (F.col("Z") + z * F.col("sd")).alias("upper"),
        (1 / (1 - F.pow("Z", 1 / F.col("order").cast("double")))).alias("effective"), F.col("_n").alias("n"),
    )


def simpson_difference(a: DataFrame, b: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Differences of two tables of entropies by key and order, with normal intervals."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    x, y = (t.select(*keys, "order", F.col("Z").alias(f"Z{s}"), F.col("sd").alias(f"sd{s}")) for t, s in ((a, 1), (b, 2)))
    d = x.join(y, [*keys, "order"]).withColumn("difference", F.col("Z1") - F.col("Z2"))
    half = z * F.sqrt(F.col("sd1") * F.col("sd1") + F.col("sd2") * F.col("sd2"))
    return d.select(*keys, "order", "difference", (F.col("difference") - half).alias("lower"), (F.col("difference") + half).alias("upper"))


def fuzzy_diversity(edges: DataFrame, clones: DataFrame, count: str, threshold: float, clone_id: str = "clone_ix") -> DataFrame:
    """(fuzzy): 1 - sum over pairs i < j within the threshold of c_i c_j, over the squared total."""
    n = lambda s: clones.select(F.col(clone_id).alias(f"{s}_ix"), F.col(count).cast("double").alias(f"_{s}"))
    near = edges.filter((F.col("left_ix") < F.col("right_ix")) & (F.col("dist") <= threshold)).join(n("left"), "left_ix").join(n("right"), "right_ix")
    total = clones.agg(F.sum(count).cast("double").alias("_t"))
    return near.agg(F.coalesce(F.sum(F.col("_left") * F.col("_right")), F.lit(0.0)).alias("_s")).crossJoin(total).select((1 - F.col("_s") / (F.col("_t") * F.col("_t"))).alias("fuzzy"))


def fuzzy_sampled(edges: DataFrame, clones: DataFrame, count: str, threshold: float, order: int, samples: int, seed: int = 1, clone_id: str = "clone_ix") -> DataFrame:
    """Monte Carlo for higher orders: the share of draws of ``order`` clones, by count, of which not all pairs are near. Sampling is the operator.

    Draws pick places in the running sum of counts; clones cover ranges of places. Sums run within buckets of clones, and over the table of
    buckets; a place is first found among the buckets, then its clone is the last of the bucket that begins before it: clones and draws are sorted together
    and no draw meets more than one clone. A bucket has about ``BUCKET_ROWS`` clones.
    """
    spark = clones.sparkSession
    own = clones.select(F.col(clone_id).alias("ix"), F.col(count).cast("double").alias("_c")).filter("_c > 0")
    total, n = own.agg(F.sum("_c"), F.count("*")).first()
    if not n:
        return spark.createDataFrame([(None,)], "fuzzy double")
    own = own.withColumn("_b", F.pmod(F.xxhash64("ix"), F.lit(max(BUCKETS, n // BUCKET_ROWS))))
    within = Window.partitionBy("_b").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    buckets = own.groupBy("_b").agg(F.sum("_c").alias("_w")).withColumn("_end", F.sum("_w").over(before))
    starts = own.withColumn("_at", F.sum("_c").over(within) - F.col("_c"))
    ends = buckets.agg(F.array_sort(F.collect_list(F.struct("_end", "_b", "_w"))).alias("_ends"))  # one entry a bucket
    draws = spark.range(samples).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(1), F.lit(order))).alias("k")).crossJoin(F.broadcast(ends))
    # xxhash64 to [0, 1): repeatable, unlike rand() under another partitioning.
    unit = F.shiftrightunsigned(F.xxhash64("draw", "k", F.lit(seed)), 11) / float(1 << 53)
    draws = draws.withColumn("_u", unit * total).withColumn("_e", F.coalesce(F.filter("_ends", lambda e: e["_end"] > F.col("_u"))[0], F.element_at("_ends", -1)))
    draws = draws.select("draw", "k", F.col("_e._b").alias("_b"), F.greatest(F.lit(0.0), F.col("_u") - F.col("_e._end") + F.col("_e._w")).alias("_at"))
    none = F.lit(None).cast(own.schema["ix"].dataType)
    mixed = starts.select("_b", "_at", "ix", F.lit(None).cast("long").alias("draw"), F.lit(None).cast("int").alias("k")).union(draws.select("_b", "_at", none.alias("ix"), "draw", "k"))
    order_ = Window.partitionBy("_b").orderBy("_at", F.col("draw").isNotNull(), "ix").rowsBetween(Window.unboundedPreceding, 0)
    draws = mixed.withColumn("ix", F.last("ix", True).over(order_)).filter("draw IS NOT NULL").select("draw", "k", "ix")
    a, b = draws.select("draw", F.col("k").alias("k1"), F.col("ix").alias("left_ix")), draws.select("draw", F.col("k").alias("k2"), F.col("ix").alias("right_ix"))
    near = edges.filter(F.col("dist") <= threshold).select("left_ix", "right_ix", F.lit(True).alias("_near"))
    pairs = a.join(b, "draw").filter("k1 < k2").join(near, ["left_ix", "right_ix"], "left")
    all_near = pairs.groupBy("draw").agg(F.min(F.coalesce("_near", F.lit(False)) | (F.col("left_ix") == F.col("right_ix"))).alias("_all"))
    return all_near.agg((1 - F.avg(F.col("_all").cast("double"))).alias("fuzzy"))
