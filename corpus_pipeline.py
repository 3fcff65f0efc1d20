"""From documents to packed training sequences: five stages over the operators of ``cloneframe.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as
Parquet and read again as the next stage's docs. All but the last return the columns of ``documents``.

1. quality_classifier: documents that score below 0.5 go.
2. quality_rules: lines that fail a rule go from the text; documents that fail, or lose too much text, go.
3. near_dedup: of each group of near duplicates, the document with the smallest id stays.
4. secret_scan: every secret in a text is replaced by a mark.
5. best_fit_packing: one row per piece of a document, with its sequence and place.

Where a text changes, ``n_chars`` is counted anew. Columns beyond those of ``documents`` are not carried, whatever their names; missing ones other than
doc_id and text are left out. Each stage takes an empty table and gives one.

Defined results by stage:

1. Null and empty texts score as empty texts do; without labels of both kinds all rows get the prior. Rows without an id are scored, equal rows alike.
2. Null, empty and blank texts have under 50 words and go. Very long texts are judged by all their lines. Equal rows are judged alike.
3. Null, empty and blank texts are no copies of one another and stay; rows without an id stay; of rows that share an id one stays. The smallest id wins, so no ties arise.
4. A null text stays null; overlapping secrets become one mark.
5. Null and empty texts are one piece with the end id alone; repeated rows are packed as often as they stand; very long texts are many pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneframe.llm import near_dedup, packing, quality_classifier, quality_rules, secrets
from cloneframe.llm.frames import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.select([c for c in COLUMNS if c in df.columns])


def _recounted(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in df.columns else df


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(_documents(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.with_rules(_documents(docs), "text", "_rules").filter("_rules.kept")
    return _recounted(judged.withColumn("text", F.col("_rules.clean_text")).drop("_rules"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(_documents(docs))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(secrets.redact(_documents(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", clean),
    ("near_dedup", deduplicate),
    ("secret_scan", redact),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the classifier, the sketches or the packing program.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
