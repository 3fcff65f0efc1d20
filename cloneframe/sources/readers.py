"""Readers of delimited files and sequencing exports. All give DataFrames with an explicit plan; no file is read whole by the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import valid_cdr3
from ..schema import columns_of, require


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """A delimited file with a header; without a schema every column is text (no second pass over the data to guess). Only asked-for columns are parsed."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    return require(df, columns).select(*(F.col(f"`{c}`") for c in columns)) if columns else df


def detect_separator(spark: SparkSession, path: str, columns: list[str]) -> str:
    """',' or tab, whichever makes a header with all the columns. ValueError if neither does."""
    for sep in (",", "\t"):
        if set(columns) <= set(read_delimited(spark, path, sep).columns):
            return sep
    raise ValueError(f"{path} is neither comma- nor tab-separated with columns {', '.join(columns)}")


def rename(df: DataFrame, mapping: dict[str, str], allow_missing: bool = False) -> DataFrame:
    """Selects and renames in the mapping's order. KeyError for a missing column, unless allowed."""
    missing = [k for k in mapping if k not in df.columns]
    if missing and not allow_missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df.select(*(F.col(f"`{k}`").alias(v) for k, v in mapping.items() if k not in missing))


def crosswalk(df: DataFrame, names: DataFrame, column: str, species: str) -> DataFrame:
    """A vendor's gene names as IMGT names by a table (adaptive, imgt, species): a missing value of the table is 'NA', an unknown name null."""
    table = names.filter(F.col("species") == species).select(F.col("adaptive").alias(column), F.coalesce("imgt", F.lit("NA")).alias("_imgt")).dropDuplicates([column])
    return df.join(table, column, "left").withColumn(column, F.col("_imgt")).drop("_imgt")


def gene_without_allele(df: DataFrame, names: DataFrame, column: str, species: str) -> DataFrame:
    """Gene names of any allele or none as the allele that the table (adaptive, imgt, species) has of the gene, the last by name if several; null for an unknown gene."""
    bare = lambda c: F.split_part(c, F.lit("*"), F.lit(1))
    table = names.filter((F.col("species") == species) & F.col("imgt").isNotNull()).groupBy(bare(F.col("imgt")).alias("_gene")).agg(F.max("imgt").alias("_imgt"))
    return df.withColumn("_gene", bare(F.col(column))).join(table, "_gene", "left").withColumn(column, F.col("_imgt")).drop("_imgt", "_gene")


def first_alleles(df: DataFrame, genes: DataFrame, column: str, organism: str) -> DataFrame:
    """Gene names without allele as their *01 name; null if the table has none."""
    known = genes.filter((F.col("organism") == organism) & F.endswith("id", F.lit("*01"))).select(F.split_part("id", F.lit("*"), F.lit(1)).alias(column), F.col("id").alias("_id"))
    return df.join(known.dropDuplicates([column]), column, "left").withColumn(column, F.col("_id")).drop("_id")


def read_immunoseq(
    df: DataFrame, names: DataFrame | None, chain: str = "beta", organism: str = "human", count: str = "productive_frequency", epitope: str = "X",
    subject: str | Column | None = None, valid_only: bool = True, extra: list[str] | None = None,
) -> DataFrame:
    """A vendor export with ``bio_identity`` = CDR3+V+J and dirty numbers as clones of one chain. The default subject is the file's name."""
    names_of = columns_of(chain)
    require(df, ["bio_identity", count])
    part = lambda i: F.split_part("bio_identity", F.lit("+"), F.lit(i))
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    who = F.element_at(F.split(F.input_file_name(), "/"), -1) if subject is None else F.lit(subject) if isinstance(subject, str) else subject
    out = df.select(
        part(1).alias(names_of["cdr3"]), part(2).alias(names_of["v"]), part(3).alias(names_of["j"]), number(count).alias("count"), number("productive_frequency").alias("productive_frequency"),
        who.alias("subject"), F.lit(epitope).alias("epitope"), *(extra or []),
    )
    if names is not None:
        for gene in ("v", "j"):
            out = crosswalk(out, names, names_of[gene], organism)
    out = out.withColumn("valid_cdr3", valid_cdr3(names_of["cdr3"]))
    return out.filter("valid_cdr3") if valid_only else out


def read_vdjtools(df: DataFrame, genes: DataFrame, chain: str = "beta", organism: str = "human", valid_only: bool = True) -> DataFrame:
    """Columns count, freq, cdr3aa, v, j, cdr3nt; genes get allele *01, and what the gene table or the alphabet doesn't know is flagged."""
    n = columns_of(chain)
    out = require(df, ["count", "freq", "cdr3aa", "v", "j", "cdr3nt"]).select(
        F.expr("try_cast(count as bigint)").alias("count"), F.expr("try_cast(freq as double)").alias("freq"), F.col("cdr3aa").alias(n["cdr3"]),
        F.concat("v", F.lit("*01")).alias(n["v"]), F.concat("j", F.lit("*01")).alias(n["j"]), F.col("cdr3nt").alias(n["nucseq"]),
    )
    known = genes.filter(F.col("organism") == organism).select("id").distinct()
    for gene, flag in ((n["v"], "valid_v"), (n["j"], "valid_j")):
        out = out.join(known.select(F.col("id").alias(gene), F.lit(True).alias(flag)), gene, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    out = out.withColumn("valid_cdr3", valid_cdr3(n["cdr3"]) & (F.length(n["cdr3"]) >= 5))
    return out.filter("valid_v and valid_j and valid_cdr3") if valid_only else out


def literal_value(text, key: str) -> Column:
    """The value of ``key`` in a dictionary written as JSON or as Python does, as text: quotes of either kind, the other kind inside; null for None, null, an empty text or no such key."""
    quoted = lambda q: rf"{q}((?:[^{q}\\]|\\.)*){q}"
    pattern = rf"""[{{,]\s*["']\Q{key}\E["']\s*:\s*(?:{quoted("'")}|{quoted('"')}|([^,}}\s]+))"""
    got = lambda i: F.regexp_extract(text, pattern, i)
    found = F.coalesce(*(F.when(got(i) != "", got(i)) for i in (1, 2)), F.when(~got(3).isin("", "None", "null", "nan"), got(3)))
    return F.when(F.regexp_extract(text, pattern, 0) != "", F.regexp_replace(found, r"\\(.)", "$1"))


def is_dictionary(text) -> Column:
    return F.coalesce(F.trim(text).rlike(r"(?s)^\{.*\}$"), F.lit(False))


def pair_vdjdb(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The TRA and TRB rows of each complex side by side; complex 0 and unpaired ids go. ``keys`` (such as Reference) join the complex id in one pass.

    The subject is ``subject.id`` of Meta; the count is the k of a "k/n" ``frequency`` of Method, else 1. ``readable`` is false where one of the two isn't a dictionary
    and its default stands in for what it may say.
    """
    keys = ["complex.id", *(keys or [])]
    by = [k.replace(".", "_").lower() for k in keys]
    side = lambda g, x, more: df.filter(F.col("Gene") == g).select(
        *(F.col(f"`{k}`").alias(n) for k, n in zip(keys, by)), F.col("CDR3").alias(f"cdr3_{x}_aa"), F.col("V").alias(f"v_{x}_gene"), F.col("J").alias(f"j_{x}_gene"), *more
    )
    k_of_n = F.split_part(literal_value(F.col("Method"), "frequency"), F.lit("/"), F.lit(1))
    about = [
        F.col("Epitope").alias("epitope"), literal_value(F.col("Meta"), "subject.id").alias("subject"), F.coalesce(k_of_n.try_cast("bigint"), F.lit(1).cast("long")).alias("count"),
        (is_dictionary(F.col("Meta")) & is_dictionary(F.col("Method"))).alias("readable"),
    ]
    return side("TRA", "a", about).join(side("TRB", "b", []), by).filter(F.col(by[0]).cast("string") != "0")


def load_bulk(
    spark: SparkSession, path: str, names: DataFrame, genes: DataFrame, least_path: str, full_path: str, epitope: str = "X", subject: str | Column | None = None
) -> DataFrame:
    """A vendor's bulk file of human beta chains as clones with germline loops; writes a table of the least columns and one of all, and returns the latter.

    Counts are productive frequencies; CDR3s with letters of no residue go; rows are not summed. Templates are whole numbers; what isn't one is null. The table is read
    back with the types that it was written with.
    """
    from ..operators.clones import infer_cdrs
    from .writers import flat, write_delimited

    raw = read_delimited(spark, path, columns=["bio_identity", "productive_frequency", "templates"])
    cells = read_immunoseq(raw, names, epitope=epitope, subject=subject, extra=["templates"]).withColumn("templates", F.col("templates").try_cast("bigint"))
    clones = infer_cdrs(cells, genes, "beta", "human")
    write_delimited(clones.select("cdr3_b_aa", "v_b_gene", "j_b_gene", "productive_frequency", "templates"), least_path)
    write_delimited(clones, full_path)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat(clones).schema.fields)
    return read_delimited(spark, full_path, schema=types)


def read_genes(df: DataFrame, translate: bool = True) -> DataFrame:
    """A germline gene table with its loops cut from the aligned protein; it fails on rows whose stored loops differ or whose nucleotides spell another protein."""
    from ..functions.sequences import cdrs_of, translated

    require(df, ["id", "organism", "chain", "region", "nucseq", "frame", "aligned_protseq", "cdr_columns", "cdrs"])
    cut = F.array_join(cdrs_of("aligned_protseq", "cdr_columns"), ";")
    checked = F.assert_true(F.col("cdr_columns").isNull() | (cut == F.col("cdrs")), F.concat(F.lit("stored loops differ from the alignment: "), F.col("id")))
    # The frame counts from the first base whose codons spell the aligned protein without its gaps; pseudogenes hold stops.
    read = lambda f: translated(F.col("nucseq"), f)
    protein = F.replace("aligned_protseq", F.lit("."), F.lit(""))
    frame = F.expr("try_cast(frame as int)")
    spelled = F.when(frame == 1, read(1)).when(frame == 2, read(2)).when(frame == 3, read(3))
    told = F.assert_true(F.coalesce(F.startswith(spelled, protein), F.lit(True)), F.concat(F.lit("the nucleotides don't spell the protein: "), F.col("id")))
    return df.filter(checked.isNull() & told.isNull()) if translate else df.filter(checked.isNull())


def stitched(parts: list[DataFrame], sizes: list[int], axis: int = 0) -> DataFrame:
    """Edge tables of fragments as one: each part's left (axis 0) or right (axis 1) ids are moved by the sizes before it."""
    out, moved, column = None, 0, ("left_ix", "right_ix")[axis]
    for part, size in zip(parts, sizes):
        own = part.withColumn(column, F.col(column) + moved)
        out, moved = own if out is None else out.unionByName(own), moved + size
    return out

