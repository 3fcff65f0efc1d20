"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions near hits, checksums (free style).

One automaton over all keywords reads each whole text once. Only where a keyword
stands is that kind's expression tried, anchored at the keyword. Spans of kinds
whose secrets carry a check value (service tokens, key files, signed tokens) are then
kept only if it holds. The one kind without a keyword, runs of hex digits, is found by
its own run expression.

A narrow map without shuffle; memory per task is one slice of texts. Time is linear in a text's length, very long texts
too: expressions have no nested repeats, and of a run of token characters only the first "eyJ" is tried.

Defined results: null and empty texts have no spans and the SHA-256 of the empty
string. Null ids are carried through, repeated rows repeat, and only the id and text columns
are read. Offsets are code points, ends exclusive. Spans of different kinds may overlap;
spans of one kind never do. Spans that start together are ordered by kind as listed. A signed token's header is a JSON object, nested
as deep as may be, with the key "alg" of its own. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import _map

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out.rjust(width, "0")


def crc_tail(body: str, tail: str) -> bool:
    """The last six characters are the CRC-32 of the others in base 62."""
    return base62(zlib.crc32(body.encode()), 6) == tail


_JSON = re.compile(
    r'[ \t\n\r]*+("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|(?:-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null|NaN|-?Infinity)|[\[\]{}:,])'
)
_RUN = re.compile(r"[A-Za-z0-9_-]*")


def top_keys(text: str) -> set[str] | None:
    """The keys of a JSON object, those of objects within it left out; None if the text is no such object. One scan with a stack of open brackets, however deep."""
    keys, stack, at, want = set(), [], 0, "value"
    while m := _JSON.match(text, at):
        token, at, first = m[1], m.end(), m[1][0]
        if first in "[{" and want in ("value", "value or end"):
            stack.append(first)
            want = "key or end" if first == "{" else "value or end"
        elif first in "]}" and want in ("value or end" if first == "]" else "key or end", "end") and stack and stack[-1] == "{["[first == "]"]:
            stack.pop()
            want = "end" if stack else "nothing"
        elif first == "," and want == "end":
            want = "key" if stack[-1] == "{" else "value"
        elif first == ":" and want == "colon":
            want = "value"
        elif first == '"' and want in ("key", "key or end"):
            if len(stack) == 1:
                keys.add(json.loads(token))
            want = "colon"
        elif first not in "[]{},:" and want in ("value", "value or end") and stack:
            want = "end"
        else:
            return None
    return keys if want == "nothing" and text.lstrip(" \t\n\r").startswith("{") and not text[at:].strip(" \t\n\r") else None


def _jwt(found: re.Match) -> bool:
    head = found[0].split(".")[0]
    try:
        return "alg" in (top_keys(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)).decode()) or ())
    except ValueError:
        return False


def _pem(found: re.Match) -> bool:
    """The outermost DER length must be that of the decoded body; other armours carry a fixed magic."""
    try:
        raw = base64.b64decode("".join(found[2].split()), validate=True)
    except binascii.Error:
        return False
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    if len(raw) < 4 or raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return raw[1] + 2 == len(raw)
    k = raw[1] & 0x7F
    return int.from_bytes(raw[2 : 2 + k], "big") + 2 + k == len(raw)


def _luhn(found: re.Match) -> bool:
    digits = [int(c) for c in found[1] if c.isdigit()]
    doubled = [d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits), 1)]
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


#: kind, keywords (lower case), expression anchored at the keyword, check. Public token formats.
KINDS = [
    ("assign", ["password", "passwd", "secret", "token", "apikey", "api_key"],
     r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 12),
    ("access", ["akia"], r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", [], r"[0-9a-f]{16,}", None),
    ("github", ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])", lambda m: crc_tail(m[1], m[2])),
    ("npm", ["npm_"], r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])", lambda m: crc_tail(m[1], m[2])),
    ("jwt", ["eyj"], r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]{8,}", _jwt),
    ("pem", ["-----begin "], r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----", _pem),
    ("slack", ["xoxb-", "xoxp-", "xoxa-", "xoxs-"], r"xox[abps]-[0-9]{10,13}-[0-9A-Za-z-]{20,}", None),
    ("stripe", ["sk_live_", "rk_live_"], r"[sr]k_live_[0-9A-Za-z]{24,}", None),
    ("google", ["aiza"], r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])", None),
    ("card", ["card number", "card no", "cardnumber"], r"(?ai:card ?(?:number|no))\.?\x20*[:=]?\x20*([0-9](?:[ -]?[0-9]){12,18})(?![0-9])", _luhn),
]
BASE = ("assign", "access", "hex")
ORDER = {k: i for i, (k, *_) in enumerate(KINDS)}


class Scanner:
    def __init__(self):
        import ahocorasick

        self.words = ahocorasick.Automaton()
        self.rules = {k: (re.compile(p), ok) for k, _, p, ok in KINDS}
        for kind, keys, _, _ in KINDS:
            for key in keys:
                self.words.add_word(key, (kind, len(key)))
        self.words.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) by start, then kind as listed."""
        low = text.lower()
        if len(low) != len(text):  # some capitals grow; the automaton needs places of the text itself
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        hits: dict[str, list[int]] = {}
        for end, (kind, size) in self.words.iter(low):
            hits.setdefault(kind, []).append(end - size + 1)
        out = [(m.start(), m.end(), "hex") for m in self.rules["hex"][0].finditer(text)]
        for kind, starts in hits.items():
            rule, ok = self.rules[kind]
            at = 0
            for start in sorted(starts):
                if start < at:
                    continue
                if m := rule.match(text, start):
                    at = m.end()  # a match that fails its check is consumed as well
                    if ok is None or ok(m):
                        out.append((start, at, kind))
                elif kind == "jwt" and text.startswith("eyJ", start):
                    at = _RUN.match(text, start).end()  # what follows the run is the same for later starts in it
        return sorted(out, key=lambda s: (s[0], ORDER[s[2]], s[1]))


@lru_cache(1)
def scanner() -> Scanner:
    """One per Python worker."""
    return Scanner()


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans) -> str:
    """The text with every span, overlaps joined, replaced by a mark that names the kind that starts first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind} removed>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) of every whole text."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(texts):
        find = scanner().spans
        return {"spans": pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in find(t)] for t in texts], kind)}

    return _map(df, "spans array<struct<kind:string,start:long,end:long>>", id_col, text_col, work)


def scan_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, a digest of their spans, and all spans as a string."""
    found = find_secrets(df, id_col, text_col)
    text = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        id_col,
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every secret in ``text_col`` replaced by a mark; null stays null, other columns stay as they are."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        find = scanner().spans
        return texts.map(lambda t: t if t is None or not (s := find(t)) else redacted(t, s), na_action="ignore")

    return df.withColumn(text_col, clean(F.col(text_col)))
