"""Writers of clone tables, edges, repertoires and reports."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import Aligned, Edit, Hamming, MetricSpec, Tcr
from ..operators.clones import Repertoire

METRICS = {c.__name__: c for c in (Tcr, Edit, Hamming, Aligned)}


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats that hold none."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def write_delimited(df: DataFrame, path: str, sep: str = "\t", mode: str = "error") -> None:
    flat(df).write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def write_edges(edges: DataFrame, path: str, mode: str = "error") -> None:
    edges.write.mode(mode).parquet(path)


def save(repertoire: Repertoire, path: str, mode: str = "error") -> None:
    """Clones as Parquet and one row of JSON with what else it takes. Metrics that are Python functions cannot be saved."""
    specs = {}
    for chain, spec in repertoire.specs.items():
        if unknown := [m for _, m, _ in spec.parts if type(m).__name__ not in METRICS]:
            raise ValueError(f"{type(unknown[0]).__name__} metrics cannot be saved")
        specs[chain] = [[c, type(m).__name__, m.__dict__, w] for c, m, w in spec.parts]
    repertoire.clones.write.mode(mode).parquet(f"{path}/clones")
    about = json.dumps({"chains": repertoire.chains, "organism": repertoire.organism, "specs": specs})
    repertoire.clones.sparkSession.createDataFrame([(about,)], "manifest string").coalesce(1).write.mode(mode).json(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> Repertoire:
    about = json.loads(spark.read.json(f"{path}/manifest").first()["manifest"])
    specs = {k: MetricSpec(tuple((c, METRICS[m](**kw), w) for c, m, kw, w in parts)) for k, parts in about["specs"].items()}
    return Repertoire(spark.read.parquet(f"{path}/clones"), tuple(about["chains"]), about["organism"], specs)


def write_html(ranked: DataFrame, path: str, rank: str = "rank", title: str = "Neighbourhoods", mode: str = "error") -> None:
    """One table row for each ranked neighbourhood, as text files of one folder, whose lines in the files' order are the page; rows are dealt by ranges of rank, and nothing passes through the driver."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")) for c in ranked.columns]
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        cells = [F.replace(c, F.lit(old), F.lit(new)) for c in cells]
    row = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells), F.lit("</tr>"))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in ranked.columns)
    spark = ranked.sparkSession
    first = f"<html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><table><tr>{head}</tr>"
    ends = spark.createDataFrame([(0, first), (2, "</table></body></html>")], "at int, value string").select("at", F.lit(None).cast(ranked.schema[rank].dataType).alias("rank"), "value")
    lines = ends.union(ranked.select(F.lit(1).alias("at"), F.col(rank).alias("rank"), row.alias("value")))
    lines.orderBy("at", "rank").select("value").write.mode(mode).text(path)
