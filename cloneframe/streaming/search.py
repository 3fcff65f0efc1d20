"""Arriving repertoires searched against a fixed set of meta-clonotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import MetricSpec


def search_stream(stream: DataFrame, search: DataFrame, spec: MetricSpec, keys: list[str], search_id: str = "clone_ix") -> DataFrame:
    """Hits of each arriving clone: equal keys (such as the V gene), distance within the search row's radius, and MOTIF.

    A stream-static join with one native expression, so it holds no state and each micro-batch is planned as any join; the search
    set is the static side.
    """
    cols = list(dict.fromkeys([*keys, *spec.columns]))
    static = search.select(F.col(search_id).alias("left_ix"), "radius", "regex", *(F.col(c).alias(f"s_{c}") for c in cols))
    joined = stream.join(static, [F.col(k) == F.col(f"s_{k}") for k in keys])
    hit = joined.withColumn("dist", spec.column(lambda c: F.col(f"s_{c}"), F.col)).filter(F.col("dist") <= F.col("radius"))
    return hit.withColumn("MOTIF", F.coalesce(F.expr(f"`{spec.columns[0]}` rlike regex"), F.lit(False))).drop(*(f"s_{c}" for c in cols))


def hit_counts(hits: DataFrame, event_time: str, window: str, watermark: str) -> DataFrame:
    """Hits and their counts per meta-clonotype in windows of event time; rows later than the watermark are left out, and state behind it is dropped."""
    return (
        hits.withWatermark(event_time, watermark)
        .groupBy(F.window(event_time, window), "left_ix")
        .agg(F.count("*").alias("n_hits"), F.sum("count").alias("sum_count"))
        .select(F.col("window.start").alias("start"), "left_ix", "n_hits", "sum_count")
    )
