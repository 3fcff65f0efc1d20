"""Groups of spelling variants by a symmetric-delete join (free style: DataFrame operations, keys made in Arrow tasks).

1. Words are counted (native), and numbered so that a smaller number is a more frequent word, or of equal ones the first in code-point order.
2. Every word emits itself and its single deletions, each with the place of the deleted character. An equi-join of deletions with words on
   the shared key gives the pairs that differ by an insertion. Words that share a deletion at one place differ there alone, so
   they are a group of mutual replacements: counting it and taking its least number says all that is needed, and no pairs within a group are made.
   At most as many words as the alphabet has letters share a key and a place, so no group is large.
3. Each word's near words are summed up: how many, and the best. If the best is ``RATIO`` times as frequent, it is the word's form; its distance is verified on the words.
4. Roots: forms of forms, by joins that double the steps each round. A form is ``RATIO`` times as frequent as its word, so the
   largest count bounds the chain and with it the rounds.

Keys of up to ``LITERAL`` code points are the strings themselves; longer ones are polynomials modulo 2^127 - 1, made in time linear in the word.
All that shuffles is partial counts, keys and numbers; tables between steps are written to the shared folder.

Defined results: null and empty texts have no words; a null id hashes as the empty string. Repeated rows count as often as they stand. Ties between forms go to the
first in code-point order. Very long runs are words like others. An empty table gives an empty result, and only the id and text columns are read.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import written

MIN_LENGTH, MIN_COUNT, RATIO, LITERAL = 6, 5, 5, 64
#: One of so many runs in a document loses a character, by its checksum.
DAMAGED = 199
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PRIME, _BASE = (1 << 127) - 1, 0x1F3D5B79A2C4E6F8091B3D5F7A8C6E4D
_KEYS = pa.schema([("key", pa.string()), ("place", pa.int32()), ("first", pa.bool_()), ("id", pa.int64())])


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words that are long and frequent enough, after the damage to one run of ``DAMAGED``. Shorter runs can't give a word and are not taken."""
    runs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(rf"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}"), F.lit(0))).alias("_run"))
    low = runs.select("_id", F.translate("_run", _UPPER, _LOWER).alias("_run")).withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")))
    at = (F.col("_h") % F.length("_run")).cast("int")
    damaged = F.concat(F.substr("_run", F.lit(1), at), F.substr("_run", at + 2))
    words = low.select(F.when(F.col("_h") % DAMAGED == 0, damaged).otherwise(F.col("_run")).alias("word"))
    return words.filter(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)


def numbered(words: DataFrame) -> DataFrame:
    """(word, n, id), ids rising from the most frequent word on: of rows sorted by ranges, numbers by partition rise as the rows do."""
    return written(words.orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id()))


def deletions(word: str) -> list[str]:
    """The key of ``word`` without its i-th character, for each i."""
    size = len(word)
    if size <= LITERAL + 1:
        return [word[:i] + word[i + 1 :] for i in range(size)]
    codes, ends, power = [*map(ord, word)], [0] * (size + 1), 1
    for i in range(size - 1, -1, -1):  # what follows each place
        ends[i] = (codes[i] * power + ends[i + 1]) % _PRIME
        power = power * _BASE % _PRIME
    out, begin, inverse = [], 0, pow(_BASE, -1, _PRIME)
    for i in range(size):
        power = power * inverse % _PRIME
        out.append(f"#{(begin * power + ends[i + 1]) % _PRIME:x}.{size - 1}")
        begin = (begin * _BASE + codes[i]) % _PRIME
    return out


def own_key(word: str) -> str:
    """The key that a word one longer has for a deletion that leaves ``word``."""
    if len(word) <= LITERAL:
        return word
    value = 0
    for c in word:
        value = (value * _BASE + ord(c)) % _PRIME
    return f"#{value:x}.{len(word)}"


def keys(words: DataFrame) -> DataFrame:
    """(key, place, first, id): each word itself at place -1, and each deletion at its place; ``first`` marks the distinct ones, as equal letters side by side give one string."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for word, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.append((own_key(word), -1, False, number))
                rows += [(k, i, i == 0 or word[i] != word[i - 1], number) for i, k in enumerate(deletions(word))]
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KEYS.types)], schema=_KEYS)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KEYS.types)], schema=_KEYS)

    return words.select("word", "id").mapInArrow(run, "key string, place int, first boolean, id long")


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best) of every word with near words: how many, and the least id among them that is less than its own (null if none is)."""
    made = written(keys(words))
    group = Window.partitionBy("key", "place")
    replaced = (
        made.filter("place >= 0").withColumns({"_n": F.count("*").over(group) - 1, "_least": F.min("id").over(group)})
        .filter("_n > 0").select("id", F.col("_n").alias("n_near"), F.when(F.col("_least") < F.col("id"), F.col("_least")).alias("best"))
    )
    longer = made.filter("first").select("key", F.col("id").alias("_long"))
    pairs = longer.join(made.filter("place < 0").select("key", F.col("id").alias("_short")), "key").select(F.explode(F.array(F.struct(F.col("_long").alias("id"), F.col("_short").alias("other")), F.struct(F.col("_short").alias("id"), F.col("_long").alias("other")))).alias("_p"))
    inserted = pairs.select("_p.id", F.lit(1).cast("long").alias("n_near"), F.when(F.col("_p.other") < F.col("_p.id"), F.col("_p.other")).alias("best"))
    return replaced.union(inserted).groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def forms(words: DataFrame, near: DataFrame) -> DataFrame:
    """(id, form_id, form, form_n) of the words whose best near word is ``RATIO`` times as frequent; the distance is verified on the words."""
    best = words.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    own = words.join(near.filter("best IS NOT NULL").select("id", F.col("best").alias("form_id")), "id")
    held = (F.col("form_n") >= RATIO * F.col("n")) & (F.levenshtein("word", "form", 1) == 1)
    return own.join(best, "form_id").filter(held).select("id", "form_id", "form", "form_n")


def roots(form: DataFrame, rounds: int) -> DataFrame:
    """(id, root_id): the last of the forms from each word that has one; steps double with each round."""
    out = form.select("id", F.col("form_id").alias("root_id"))
    for _ in range(rounds):
        further = out.select(F.col("id").alias("root_id"), F.col("root_id").alias("_next"))
        out = written(out.join(further, "root_id", "left").select("id", F.coalesce("_next", "root_id").alias("root_id")))
    return out


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that is long and frequent enough."""
    words = numbered(count_words(df, id_col, text_col))
    near = written(near_words(words))
    form = written(forms(words, near))
    most = words.agg(F.max("n")).first()[0] or MIN_COUNT
    longest = math.floor(math.log(most / MIN_COUNT, RATIO) + 1e-9) + 1
    last = roots(form, math.ceil(math.log2(longest))).join(words.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id").select("id", "root")
    return (
        words.join(near.select("id", "n_near"), "id", "left").join(form.select("id", "form", "form_n"), "id", "left").join(last, "id", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )


def _oracle() -> str:
    """The definitions once more in DuckDB's SQL: the checksum by half bytes, pairs by joins on deletions, roots by recursion."""
    table = []
    for i in range(16):  # the checksum's polynomial, four bits at a time
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    halves = "list_transform(range(0, length(x)), lambda i: instr('0123456789ABCDEF', x[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END]) - 1)"
    return f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all("text", '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]{{{MIN_LENGTH},}}')) AS r FROM documents),
low AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || translate(r, '{_UPPER}', '{_LOWER}') AS s, translate(r, '{_UPPER}', '{_LOWER}') AS r, count(*) AS c FROM runs GROUP BY ALL),
hexed AS (SELECT r, c, hex(encode(s)) AS x FROM low),
crc AS (SELECT r, c, xor(4294967295, list_reduce([4294967295::BIGINT] || {halves}, lambda a, b: xor((a >> 4), ({table}::BIGINT[])[(xor(a, b) & 15) + 1]))) AS h FROM hexed),
w AS MATERIALIZED (SELECT CASE WHEN h % {DAMAGED} = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, sum(c)::BIGINT AS n
      FROM crc GROUP BY 1 HAVING n >= {MIN_COUNT} AND length(word) >= {MIN_LENGTH}),
del AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM w, unnest(range(1, length(word) + 1)) AS r(i)),
pairs AS (SELECT a.word AS u, b.word AS v FROM del a JOIN del b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
          UNION SELECT del.word, w.word FROM del JOIN w ON w.word = k UNION SELECT w.word, del.word FROM del JOIN w ON w.word = k),
near AS MATERIALIZED (SELECT u AS word, count(*) AS n_near, arg_min(v, (-w.n, v)) AS best, max(w.n) AS best_n FROM pairs JOIN w ON w.word = v GROUP BY u),
f AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {RATIO} * n THEN best END AS form, CASE WHEN best_n >= {RATIO} * n THEN best_n END AS form_n FROM w LEFT JOIN near USING (word)),
walk AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL),
last AS (SELECT walk.word, walk.at FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NULL)
SELECT f.word, form, coalesce(last.at, f.word) AS root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f LEFT JOIN last USING (word)
"""


ORACLE = _oracle()
