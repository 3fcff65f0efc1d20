"""Line-first quality rules (native: DataFrame functions only).

Every line of a whole text with a word in it is judged by itself; lines that fail a rule go, and
a document goes that loses more than ``MAX_LOST`` of its words, or fails a base rule.

Line rules, in order:

* punctuation: it ends without a closing sign, or a third of its words carry a sign of ``[#*$%&|<>]``;
* navigation: a fifth of its words are separators standing alone, or it has five words or more, all in capitals;
* boilerplate: it has at most ``SHORT_LINE`` words and names a fixed phrase of web pages' frames (``BOILERPLATE``).

All work is within a row: no shuffle, and memory is that of one text's words. Repeated 3-word windows are found by
sorting (hash, place) numbers of a text; windows of equal hashes are then compared as strings, so counts
are exact.

Defined results: null, empty and blank texts have no words, fail the base rules, and are not kept; their clean text is "".
Null ids are carried through, repeated rows repeat, and only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[ \t\n\x0B\f\r]+"
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT, SHORT_LINE = 50, 50, 50, 25
#: Phrases of page frames, in lower case.
BOILERPLATE = (
    "javascript is disabled|enable javascript|use cookies|cookie policy|privacy policy|terms of use|terms of service|all rights reserved|"
    "lorem ipsum|sign up for|subscribe to|log in to|click here|read more|share this|skip to content|back to top|powered by|page not found"
)
CLOSING = r"""[.!?…。！？:;"'”’»)\]][ \t\x0B\f\r]*$"""
SYMBOL_WORD = r"[^ \t\n\x0B\f\r]*[#*$%&|<>][^ \t\n\x0B\f\r]*"
SEPARATOR = r"(?:^|[ \t\x0B\f\r])[|»•·>/-]+(?=[ \t\x0B\f\r]|$)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def repeat_words(words: Column) -> Column:
    """How many words stand in a 3-word window that the text has twice or more."""

    def count(w: Column) -> Column:
        window = lambda i: (w[i], w[i + 1], w[i + 2])
        numbered = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.shiftleft(F.hash(*window(i)).cast("long"), 32).bitwiseOR(i.cast("long"))
        )
        same = lambda k, other: F.shiftright(k, 32) == F.shiftright(other, 32)
        alike = let(F.sort_array(numbered), lambda a: F.filter(a, lambda k, j: same(k, F.get(a, j - 1)) | same(k, F.get(a, j + 1))))

        def exact(found: Column) -> Column:
            place = lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
            named = F.transform(found, lambda k: let(place(k), lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("t"), i.alias("i"))))
            twice = let(
                F.sort_array(named),
                lambda s: F.filter(s, lambda x, j: (x["t"] == F.get(s, j - 1)["t"]) | (x["t"] == F.get(s, j + 1)["t"])),
            )
            covered = let(
                F.sort_array(F.transform(twice, lambda x: x["i"])),
                lambda p: F.transform(p, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - i, F.lit(3)))),
            )
            return F.aggregate(covered, F.lit(0), lambda a, x: a + x)

        return let(alike, lambda found: F.when(F.size(found) == 0, F.lit(0)).otherwise(exact(found)))

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(count(w))).cast("long")


def line_fails(line: Column) -> Column:
    """Does a line with a word fail a rule?"""
    n = F.size(F.split(F.trim(line, F.lit(SPACES)), SPACE_RUN))
    punctuation = ~line.rlike(CLOSING) | (3 * F.regexp_count(line, F.lit(SYMBOL_WORD)) >= n)
    capitals = (n >= 5) & (line == F.upper(line)) & (line != F.lower(line))
    navigation = (5 * F.regexp_count(line, F.lit(SEPARATOR)) >= n) | capitals
    return punctuation | navigation | (n <= SHORT_LINE) & F.lower(line).rlike(BOILERPLATE)


def with_rules(df: DataFrame, text_col: str = "text", name: str = "rules") -> DataFrame:
    """``df`` with a struct ``name`` of all measures, the verdict ``kept`` and ``clean_text``."""
    words, lines, good = (f"_{name}_{x}" for x in ("words", "lines", "good"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    count_words = lambda lines: F.aggregate(lines, F.lit(0), lambda a, x: a + F.size(words_of(x))).cast("long")
    measures = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeat_words(F.col(words)),
        "n_kept_words": count_words(F.col(good)),
        "clean_text": F.array_join(good, "\n"),
    }
    at = lambda c: F.col(f"{name}.{c}")
    failed = (at("n_words") < MIN_WORDS) | (100 * at("n_repeat_words") > MAX_REPEAT_PERCENT * at("n_words"))
    enough = 100 * (at("n_words") - at("n_kept_words")) <= MAX_LOST_PERCENT * at("n_words")
    return (
        df.withColumns({words: words_of(text), lines: F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")})
        .withColumn(good, F.filter(lines, lambda x: ~line_fails(x)))
        .withColumn(name, F.struct(*(c.alias(n) for n, c in measures.items())))
        .withColumn(name, F.col(name).withField("base_failed", failed).withField("kept", ~failed & enough))
        .drop(words, lines, good)
    )


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_kept_words, clean_text, base_failed, kept)."""
    return with_rules(df.select(id_col, text_col), text_col, "_rules").select(id_col, "_rules.*")


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def _duck(pattern: str) -> str:
    return pattern.replace("'", "''").replace(r"\x0B", r"\x0b")


#: The same in DuckDB's SQL, with windows and lines as lists.
ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce("text", '') AS txt FROM documents),
w AS (SELECT doc_id, txt, list_filter(regexp_split_to_array(txt, '{SPACE_RUN.replace('x0B', 'x0b')}'), lambda x: x <> '') AS words,
             list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) AS lines FROM t),
g AS (SELECT *, list_filter(lines, lambda x: NOT (
        NOT regexp_matches(x, '{_duck(CLOSING)}')
        OR 3 * len(list_filter(regexp_split_to_array(x, '[ \\t\\n\\x0b\\f\\r]+'), lambda y: regexp_matches(y, '[#*$%&|<>]'))) >= len(list_filter(regexp_split_to_array(x, '[ \\t\\n\\x0b\\f\\r]+'), lambda y: y <> ''))
        OR 5 * len(list_filter(regexp_split_to_array(x, '[ \\t\\n\\x0b\\f\\r]+'), lambda y: regexp_full_match(y, '[|»•·>/-]+'))) >= len(list_filter(regexp_split_to_array(x, '[ \\t\\n\\x0b\\f\\r]+'), lambda y: y <> ''))
        OR (len(list_filter(regexp_split_to_array(x, '[ \\t\\n\\x0b\\f\\r]+'), lambda y: y <> '')) >= 5 AND x = upper(x) AND x <> lower(x))
        OR (len(list_filter(regexp_split_to_array(x, '[ \\t\\n\\x0b\\f\\r]+'), lambda y: y <> '')) <= {SHORT_LINE} AND regexp_matches(lower(x), '{BOILERPLATE}')))) AS good FROM w),
n AS (SELECT doc_id, txt, words, lines, len(words)::BIGINT AS n_words,
             list_sum([0] || list_transform(good, lambda x: len(list_filter(regexp_split_to_array(x, '[ \\t\\n\\x0b\\f\\r]+'), lambda y: y <> ''))))::BIGINT AS n_kept_words FROM g),
tri AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t FROM n, unnest(range(1, len(words) - 1)) AS r(i)),
twice AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
m AS (SELECT n.doc_id, n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             (length(txt) - length(regexp_replace(txt, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_kept_words
      FROM n LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         AND 100 * (n_words - n_kept_words) <= {MAX_LOST_PERCENT} * n_words AS kept
FROM m
"""
