"""Licence scan by ordered signature rules (native: DataFrame functions only).

1. A text becomes its lower-case words, each with a space on either side, so that every word
   has its own bounds and patterns need no look-around.
2. A prefilter on the rules' keywords leaves most texts without further work; each rule runs
   only where its own keyword stands.
3. A rule's matches become detections: rule, label, priority, first and end word.
4. A detection contained in another of higher priority goes (of equal priority: in a longer one; of equal
   length: in that of an earlier rule). Overlaps without containment both stay.

All work is within a row: no shuffle. Time is quadratic in the detections of one text, not in its length.

Defined results: null and empty texts have no words, no places, empty labels and score 0. Null ids are carried
through, repeated rows repeat, and only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import RULES, prefilter
from .quality_rules import let

#: Fixed base phrases and labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The score of a text with base phrases alone.
BASE_SCORE = 0.5


def wide(words: str) -> str:
    """A pattern over words, in the form with two spaces between words."""
    return " " + words.replace(" ", "  ") + " "


def normal(text: Column) -> Column:
    """" w1  w2  w3 ", or "" without words. Letters beyond A-Z are lowered too; no phrase holds one."""
    spaced = F.trim(F.regexp_replace(F.lower(text), NOT_WORD, "  "))
    return F.when(spaced == "", F.lit("")).otherwise(F.concat(F.lit(" "), spaced, F.lit(" ")))


def spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def detections(text: Column) -> Column:
    """All matches of all rules whose keyword the text holds, before suppression."""
    rules = F.array(
        *(
            F.struct(*(F.lit(v).alias(n) for n, v in (("rule", r.number), ("label", r.label), ("priority", r.priority), ("keyword", r.keyword.replace(" ", "  ")), ("pattern", wide(r.pattern)), ("one", r.also[0].replace(" ", "  ")), ("other", r.also[-1].replace(" ", "  ")))))
            for r in RULES
        )
    )

    def found(r: Column) -> Column:
        hits, gaps = F.regexp_extract_all(text, r["pattern"], F.lit(0)), F.split(text, r["pattern"])
        step = F.zip_with(gaps, hits, lambda gap, hit: F.struct(spaces(gap).alias("gap"), spaces(hit).alias("hit")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,end:int>>").alias("out"))
        walk = F.aggregate(
            F.filter(step, lambda s: s["hit"].isNotNull()),
            start,
            lambda acc, s: F.struct(
                (acc["at"] + s["gap"] + s["hit"]).alias("at"),
                F.concat(
                    acc["out"],
                    F.array(F.struct(((acc["at"] + s["gap"]) / 2).cast("int").alias("first"), ((acc["at"] + s["gap"] + s["hit"]) / 2).cast("int").alias("end"))),
                ).alias("out"),
            ),
            lambda acc: acc["out"],
        )
        return F.transform(
            walk, lambda d: F.struct(d["first"].alias("first"), d["end"].alias("end"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"))
        )

    return F.flatten(F.transform(F.filter(rules, lambda r: F.contains(text, r["keyword"]) & (F.contains(text, r["one"]) | F.contains(text, r["other"]))), found))


def unsuppressed(found: Column) -> Column:
    def beats(e: Column, d: Column) -> Column:
        size = lambda x: x["end"] - x["first"]
        same = e["priority"] == d["priority"]
        return (
            (e["first"] <= d["first"])
            & (e["end"] >= d["end"])
            & ((e["priority"] > d["priority"]) | same & ((size(e) > size(d)) | (size(e) == size(d)) & (e["rule"] < d["rule"])))
        )

    return F.array_sort(F.filter(found, lambda d: ~F.exists(found, lambda e: beats(e, d))))


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections)."""
    none = F.array().cast("array<struct<first:int,end:int,priority:int,rule:int,label:string>>")
    norm, places = F.col("_norm"), []
    for phrase, label in BASE:
        p = F.lit(wide(phrase))
        size = len(wide(phrase))
        n = ((F.length(norm) - F.length(F.replace(norm, p, F.lit("")))) / size).cast("long")
        first = (spaces(F.substring_index(norm, wide(phrase), 1)) / 2).cast("long")
        last = ((spaces(norm) - spaces(F.substring_index(norm, wide(phrase), -1))) / 2 - len(phrase.split())).cast("long")
        places.append(F.when(F.contains(norm, p), F.struct(F.lit(label).alias("label"), n.alias("n"), first.alias("first"), last.alias("last"))))
    base = F.filter(F.array(*places), lambda p: p.isNotNull())
    gate = norm.rlike(prefilter())
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    base_labels = F.transform("_base", lambda p: p["label"])
    scored = F.array_max(F.transform("detections", lambda d: d["priority"])) / 100
    return (
        df.select(F.col(id_col), normal(F.coalesce(F.col(text_col), F.lit(""))).alias("_norm"))
        .withColumn("_base", base)
        .withColumn("detections", F.when(gate, let(detections(norm), unsuppressed)).otherwise(none))
        .select(
            id_col,
            (spaces(norm) / 2).cast("long").alias("n_words"),
            F.aggregate("_base", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n_base"),
            F.array_min(F.transform("_base", lambda p: p["first"])).alias("first_word"),
            F.array_max(F.transform("_base", lambda p: p["last"])).alias("last_word"),
            joined(base_labels).alias("base_labels"),
            joined(F.concat(base_labels, F.transform("detections", lambda d: d["label"]))).alias("labels"),
            F.greatest(F.coalesce(scored, F.lit(0.0)), F.when(F.size("_base") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0))).alias("score"),
            "detections",
        )
    )


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_NORM = r"trim(regexp_replace(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g'))"
_SPACES = "length({0}) - length(replace({0}, ' ', ''))"
#: The same in DuckDB's SQL: rules as a table, places from what lies between matches.
ORACLE = f"""
WITH rules(rule, label, priority, keyword, pattern) AS (VALUES {", ".join(f"({r.number}, {_q(r.label)}, {r.priority}, {_q(r.keyword.replace(' ', '  '))}, {_q(wide(r.pattern))})" for r in RULES)}),
phrases(phrase, label, size) AS (VALUES {", ".join(f"({_q(wide(p))}, {_q(n)}, {len(p.split())})" for p, n in BASE)}),
t AS (SELECT row_number() OVER () AS k, doc_id, CASE WHEN {_NORM} = '' THEN '' ELSE ' ' || {_NORM} || ' ' END AS norm FROM documents),
parts AS (SELECT k, size, phrases.label, string_split(norm, phrase) AS p FROM t JOIN phrases ON contains(norm, phrase)),
base AS (SELECT k, sum(len(p) - 1)::BIGINT AS n_base, min((length(p[1]) - length(replace(p[1], ' ', ''))) // 2)::BIGINT AS first_word,
                max((list_sum(list_transform(p[:-2], lambda x: length(x) - length(replace(x, ' ', '')))) // 2 + (len(p) - 2) * size))::BIGINT AS last_word,
                list(label) AS labels FROM parts GROUP BY k),
hits AS (SELECT k, rules.*, regexp_extract_all(norm, pattern) AS h, string_split_regex(norm, pattern) AS g FROM t JOIN rules ON contains(norm, keyword)),
det AS (SELECT k, rule, label, priority,
               ((list_sum([0] || list_transform(g[:i], lambda x: {_SPACES.format('x')})) + list_sum([0] || list_transform(h[:i - 1], lambda x: {_SPACES.format('x')}))) // 2)::INT AS first,
               ((list_sum([0] || list_transform(g[:i], lambda x: {_SPACES.format('x')})) + list_sum([0] || list_transform(h[:i], lambda x: {_SPACES.format('x')}))) // 2)::INT AS "end"
        FROM hits, unnest(range(1, len(h) + 1)) AS r(i)),
kept AS (SELECT * FROM det d WHERE NOT EXISTS (SELECT 1 FROM det e WHERE e.k = d.k AND e.first <= d.first AND e."end" >= d."end" AND
         (e.priority > d.priority OR (e.priority = d.priority AND (e."end" - e.first > d."end" - d.first OR (e."end" - e.first = d."end" - d.first AND e.rule < d.rule)))))),
m AS (SELECT k, list(label) AS labels, max(priority) / 100 AS score FROM kept GROUP BY k)
SELECT doc_id, (({_SPACES.format('norm')}) // 2)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(list_distinct(base.labels)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
       greatest(coalesce(score, 0.0), CASE WHEN base.k IS NULL THEN 0.0 ELSE {BASE_SCORE} END)::DOUBLE AS score
FROM t LEFT JOIN base USING (k) LEFT JOIN m USING (k)
"""
