r"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust their score (native: DataFrame functions only).

1. Seven expressions propose spans, each leftmost and without overlaps, and what fails its check is dropped without a second try. One of
   them, runs of digits, serves seven kinds. Expressions are possessive and start only where a run starts, which gives
   the same matches as the plain ones (``PLAIN``) in linear time.
2. Checks: Luhn (cards), mod 97 (IBAN, INSEE number), mod 11 (NHS number), mod 11,10 (German tax id), mod 23 (Spanish
   identity number), 3-7-1 (bank routing number), ranges (addresses, social security number).
3. Each kind has points. A word of the kind among the ``BEFORE`` code points before or the ``AFTER`` after a span adds ``NEAR``;
   without one, a word of ``AGAINST`` takes ``FAR``. Spans of the kinds beyond the base below ``LEAST`` points go, so kinds that many
   numbers pass by chance (short cards, tax, health and routing numbers) need a word nearby. Base kinds stay whatever their score.

A narrow map: no shuffle, and memory per row is that of a text's matches. Places are running sums over the pieces between matches.

Defined results: null and empty texts have no spans, counts of 0 and the SHA-256 of the empty string. Null ids are carried through,
repeated rows repeat, an empty table gives an empty result, and only the id and text columns are read. Very long texts are searched whole, in time
linear in their length. Places are code points, ends exclusive. Spans of one proposing expression never overlap, but two kinds can claim the same
run, and spans of different expressions may overlap. Ties (one start) are ordered by kind as listed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import let, matches

BEFORE, AFTER, NEAR, FAR, LEAST = 60, 30, 25, 20, 50
#: The plain expressions of the base kinds.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "run": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Lengths of account numbers by country.
IBAN = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25,
    "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26, "UA": 29,
}
#: Fixed value: check letters of Spanish identity numbers, by remainder.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
PLAIN["iban"] = "(" + "|".join(f"({'|'.join(c for c in IBAN if IBAN[c] == n)})[0-9]{{2}}(\\x20?[A-Z0-9]){{{n - 4}}}" for n in sorted(set(IBAN.values()))) + ")"
PLAIN["dni"] = r"[0-9]{8}[\x20-]?[A-Z]"
PLAIN["mac"] = r"[0-9A-Fa-f]{2}([:-][0-9A-Fa-f]{2}){5}"
#: The same matches without backtracking; the other expressions have bounded repeats.
LINEAR = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "run": r"[0-9](?:[\x20-]?[0-9])++",
    "iban": f"(?=[A-Z]{{2}}[0-9]{{2}}){PLAIN['iban']}",
}
#: What a text with a match has; tried before the expression.
GATE = {"ip": r"[0-9]\.[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "run": r"[0-9](?:[\x20-]?[0-9]){8}"}
PARTS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
SSN = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
AGAINST = "version|release|isbn|issn|doi|order|invoice|tracking|serial|sku|page|lines"


@dataclass(frozen=True)
class Kind:
    name: str
    proposal: str
    points: int
    words: str


#: In the order of all results; the first four are the base.
KINDS = [
    Kind("email", "email", 80, "mail|email|contact|reply|correo|courriel"),
    Kind("ip", "ip", 55, "ip|address|host|server|client|login|adresse"),
    Kind("card", "run", 90, "card|credit|debit|visa|mastercard|payment|karte|carte|tarjeta"),
    Kind("phone", "phone", 60, "phone|tel|call|fax|mobile|cell|telefon|telefono|portable"),
    Kind("iban", "iban", 95, "iban|bank|account|konto|compte|cuenta"),
    Kind("ssn", "run", 55, "ssn|social|security"),
    Kind("short_card", "run", 30, "card|credit|debit|amex|diners|visa|karte|carte|tarjeta"),
    Kind("insee", "run", 60, "insee|nir|secu|securite|sociale"),
    Kind("tax_id", "run", 35, "steuer|steuernummer|idnr|tin|tax"),
    Kind("nhs", "run", 35, "nhs|patient|health"),
    Kind("routing", "run", 35, "routing|aba|rtn|bank"),
    Kind("dni", "dni", 45, "dni|nif|identidad|documento"),
    Kind("mac", "mac", 60, "mac|ethernet|wifi|device|interface"),
]
BASE = [k.name for k in KINDS[:4]]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sum(d: Column, n: int, part: Callable[[Column, Column], Column]) -> Column:
    """The sum of ``part(digit, place from 1)`` over the first ``n`` digits."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda a, i: a + part(F.substr(d, i, F.lit(1)).cast("int"), i))


def _luhn(d: Column) -> Column:
    return F.call_function("luhn_check", d)


def _iban(match: Column) -> Column:
    s = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(s, F.lit(5)), F.left(s, F.lit(4)))
    value = lambda i: let(F.ascii(F.substr(turned, i, F.lit(1))), lambda c: F.when(c > 57, c - 55).otherwise(c - 48))
    rest = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), lambda a, i: let(value(i), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97))
    return rest == 1


def _insee(d: Column) -> Column:
    month = F.substr(d, F.lit(4), F.lit(2)).cast("int")
    return d.rlike("^[12]") & (month.between(1, 12) | (month >= 20)) & (F.substr(d, F.lit(14), F.lit(2)).cast("int") == 97 - F.left(d, F.lit(13)).cast("long") % 97)


def _tax_id(d: Column) -> Column:
    step = lambda p, x: let((x + p) % 10, lambda s: 2 * F.when(s == 0, 10).otherwise(s) % 11)
    rest = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(10), lambda p, i: step(p, F.substr(d, i, F.lit(1)).cast("int")))
    return ~d.startswith("0") & ((11 - rest) % 10 == F.right(d, F.lit(1)).cast("int"))


def _nhs(d: Column) -> Column:
    return _sum(d, 10, lambda x, i: x * (11 - i)) % 11 == 0


def _routing(d: Column) -> Column:
    weight = lambda i: F.when(i % 3 == 1, 3).when(i % 3 == 2, 7).otherwise(1)
    return d.rlike("^(0[0-9]|1[0-2]|2[1-9]|3[0-2]|6[1-9]|7[0-2]|80)") & (_sum(d, 9, lambda x, i: x * weight(i)) % 10 == 0)


def _ssn(match: Column) -> Column:
    return match.rlike(SSN) & ~match.rlike("^(000|666|9)") & ~match.rlike("-00-|0000$")


def _dni(match: Column) -> Column:
    return F.substr(F.lit(DNI_LETTERS), F.left(match, F.lit(8)).cast("int") % 23 + 1, F.lit(1)) == F.right(match, F.lit(1))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


#: By kind: (match, its digits, their number) -> does it hold?
CHECKS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "email": lambda m, d, n: F.lit(True),
    "ip": lambda m, d, n: m.rlike(PARTS),
    "card": lambda m, d, n: n.between(16, 19) & _luhn(d),
    "phone": lambda m, d, n: n.between(8, 15),
    "iban": lambda m, d, n: _iban(m),
    "ssn": lambda m, d, n: (n == 9) & _ssn(m),
    "short_card": lambda m, d, n: n.between(13, 15) & d.rlike("^(3[0-9]|4|5|6)") & _luhn(d),
    "insee": lambda m, d, n: (n == 15) & _insee(d),
    "tax_id": lambda m, d, n: (n == 11) & _tax_id(d),
    "nhs": lambda m, d, n: (n == 10) & _nhs(d),
    "routing": lambda m, d, n: (n == 9) & (F.length(m) == 9) & _routing(d),
    "dni": lambda m, d, n: _dni(m),
    "mac": lambda m, d, n: F.lit(True),
}
#: Beyond the base, a span whose neighbour is one of these is part of something longer.
INSIDE = "[A-Za-z0-9.,:+/_-]"


def named(words: str) -> str:
    """An expression that finds one of the words, whole, in text with A-Z lower-cased."""
    return f"(^|[^a-z0-9])({words})([^a-z0-9]|$)"


def _scored(kind: Kind, hit: Column) -> Column:
    near = F.translate(F.concat(hit["before"], F.lit(" "), hit["after"]), _UPPER, _LOWER)
    return F.lit(kind.points) + F.when(near.rlike(named(kind.words)), NEAR).when(near.rlike(named(AGAINST)), -FAR).otherwise(0)


def _found(text: Column, proposal: str) -> Column:
    """The spans of all kinds that one expression proposes."""
    kinds = [(i, k) for i, k in enumerate(KINDS) if k.proposal == proposal]
    gate = F.contains(text, F.lit({"email": "@", "phone": "+"}[proposal])) if proposal in ("email", "phone") else text.rlike(GATE.get(proposal, PLAIN[proposal]))
    possible = (lambda m: F.length(m) >= 9) if proposal == "run" else (lambda m: F.lit(True))

    def spans(hit: Column) -> Column:
        def each(d: Column) -> Column:
            n, out = F.length(d), []
            for rank, kind in kinds:
                ok = CHECKS[kind.name](hit["match"], d, n)
                if kind.name not in BASE:
                    ok = ok & ~F.right(hit["before"], F.lit(1)).rlike(INSIDE) & ~hit["after"].rlike("^[A-Za-z0-9]|^[.,:+/_-][A-Za-z0-9]") & (_scored(kind, hit) >= LEAST)
                points = F.least(_scored(kind, hit), F.lit(100))
                span = (F.lit(rank).alias("rank"), hit["start"].alias("start"), hit["end"].alias("end"), F.lit(kind.name).alias("kind"), points.alias("points"), hit["match"].alias("match"))
                out.append(F.when(ok, F.struct(*span)))
            return F.filter(F.array(*out), lambda s: s.isNotNull())

        return let(_digits(hit["match"]), each)

    pattern = LINEAR.get(proposal, PLAIN[proposal])
    found = F.flatten(F.transform(matches(text, pattern, possible, BEFORE, AFTER), spans))
    none = F.array().cast("array<struct<rank:int,start:int,end:int,kind:string,points:int,match:string>>")
    return F.when(gate, F.coalesce(found, none)).otherwise(none)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<rank, start, end, kind, points, match>>) of every whole text, by kind as listed, then start."""
    text = F.col("_text")
    proposals = list(dict.fromkeys(k.proposal for k in KINDS))
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.select(id_col, F.array_sort(F.concat(*(_found(text, p) for p in proposals))).alias("spans"))


def pii_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, a digest of their spans, all spans as a string, and the largest score of any (0 to 1)."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_pii(df, id_col, text_col).select(
        id_col,
        *(count(k) for k in BASE),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["points"])) / 100, F.lit(0.0)).alias("score"),
    )


def _oracle() -> str:
    """The definitions once more in DuckDB's SQL: plain expressions, places by window sums, sides cut from the text itself."""
    digit = "TRY_CAST(substr(d, i, 1) AS INT)"
    total = lambda n, part: f"list_sum(list_transform(range(1, {n} + 1), lambda i: {part}))"
    luhn = f"{total('length(d)', f'CASE WHEN (length(d) - i) % 2 = 1 THEN ({digit} * 2) % 10 + ({digit} * 2) // 10 ELSE {digit} END')} % 10 = 0"
    turned = "substr(replace(m, ' ', ''), 5) || substr(m, 1, 4)"
    checks = {
        "email": "true",
        "ip": f"regexp_matches(m, '{PARTS}')",
        "card": f"length(d) BETWEEN 16 AND 19 AND {luhn}",
        "phone": "length(d) BETWEEN 8 AND 15",
        "iban": f"list_reduce([0] || list_transform(string_split({turned}, ''), lambda c: CASE WHEN c > '9' THEN ascii(c) - 55 ELSE ascii(c) - 48 END), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1",
        "ssn": f"regexp_matches(m, '{SSN}') AND NOT regexp_matches(m, '^(000|666|9)|-00-|0000$')",
        "short_card": f"length(d) BETWEEN 13 AND 15 AND regexp_matches(d, '^(3[0-9]|4|5|6)') AND {luhn}",
        "insee": "length(d) = 15 AND d[1] IN ('1', '2') AND (TRY_CAST(substr(d, 4, 2) AS INT) BETWEEN 1 AND 12 OR TRY_CAST(substr(d, 4, 2) AS INT) >= 20) AND TRY_CAST(substr(d, 14, 2) AS INT) = 97 - TRY_CAST(substr(d, 1, 13) AS BIGINT) % 97",
        "tax_id": f"length(d) = 11 AND d[1] <> '0' AND (11 - list_reduce([10] || list_transform(range(1, 11), lambda i: {digit}), lambda p, x: 2 * (CASE WHEN (x + p) % 10 = 0 THEN 10 ELSE (x + p) % 10 END) % 11)) % 10 = TRY_CAST(d[11] AS INT)",
        "nhs": f"length(d) = 10 AND {total(10, f'{digit} * (11 - i)')} % 11 = 0",
        "routing": f"length(d) = 9 AND length(m) = 9 AND TRY_CAST(substr(d, 1, 2) AS INT) IN (0,1,2,3,4,5,6,7,8,9,10,11,12,21,22,23,24,25,26,27,28,29,30,31,32,61,62,63,64,65,66,67,68,69,70,71,72,80) AND {total(9, f'{digit} * CASE i % 3 WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 1 END')} % 10 = 0",
        "dni": f"substr('{DNI_LETTERS}', (TRY_CAST(substr(m, 1, 8) AS INT) % 23 + 1)::INT, 1) = right(m, 1)",
        "mac": "true",
    }
    proposals = dict.fromkeys(k.proposal for k in KINDS)
    found = " UNION ALL ".join(
        f"SELECT k, '{p}' AS proposal, string_split_regex(txt, '{PLAIN[p]}') AS g, regexp_extract_all(txt, '{PLAIN[p]}') AS h FROM t WHERE regexp_matches(txt, '{PLAIN[p]}')" for p in proposals
    )
    kinds = ", ".join(f"({i}, '{k.name}', '{k.proposal}', {k.points}, '{named(k.words)}')" for i, k in enumerate(KINDS))
    ok = " ".join(f"WHEN '{k.name}' THEN {checks[k.name]}" for k in KINDS)
    text = "kind || ':' || s || ':' || e"
    return f"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce("text", '') AS txt FROM documents),
kinds(rank, kind, proposal, points, words) AS (VALUES {kinds}),
found AS ({found}),
each AS (SELECT k, proposal, i, g[i] AS gap, h[i] AS m FROM found, unnest(range(1, len(h) + 1)) AS r(i)),
placed AS (SELECT k, proposal, m, (sum(length(gap) + length(m)) OVER (PARTITION BY k, proposal ORDER BY i))::BIGINT AS e FROM each),
sides AS (SELECT k, proposal, m, e - length(m) AS s, e, regexp_replace(m, '[^0-9]', '', 'g') AS d,
                 substr(txt, greatest(e - length(m) - {BEFORE}, 0) + 1, least({BEFORE}, e - length(m))) AS b, substr(txt, e + 1, {AFTER}) AS a
          FROM placed JOIN t USING (k) WHERE proposal <> 'run' OR length(m) >= 9),
held AS MATERIALIZED (SELECT *, translate(b || ' ' || a, '{_UPPER}', '{_LOWER}') AS near FROM sides JOIN kinds USING (proposal) WHERE CASE kind {ok} END),
scored AS (SELECT *, points + CASE WHEN regexp_matches(near, words) THEN {NEAR} WHEN regexp_matches(near, '{named(AGAINST)}') THEN -{FAR} ELSE 0 END AS p FROM held),
kept AS (SELECT * FROM scored WHERE rank < 4 OR (p >= {LEAST} AND NOT regexp_matches(right(b, 1), '{INSIDE}') AND NOT regexp_matches(a, '^[A-Za-z0-9]|^[.,:+/_-][A-Za-z0-9]'))),
m AS (SELECT k, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
             string_agg({text}, ',' ORDER BY rank, s) FILTER (rank < 4) AS base, string_agg({text}, ',' ORDER BY rank, s) AS spans, least(max(p), 100) / 100 AS score FROM kept GROUP BY k)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(score, 0)::DOUBLE AS score
FROM t LEFT JOIN m USING (k)
"""


ORACLE = _oracle()
