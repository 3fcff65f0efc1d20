"""Personal data against plain Python: expressions tried as they are written, places from the matcher."""

import hashlib
import random
import re
import time

from cloneframe.llm import pii

from .cases import LONG, TEXTS, documents


def luhn(d):
    return sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d), 1)) % 10 == 0


def iban(m):
    s = m.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def tax_id(d):
    p = 10
    for c in d[:10]:
        p = 2 * ((int(c) + p) % 10 or 10) % 11
    return d[0] != "0" and (11 - p) % 10 == int(d[10])


def month(d):
    return 1 <= int(d[3:5]) <= 12 or int(d[3:5]) >= 20


PREFIX = [*range(13), *range(21, 33), *range(61, 73), 80]
CHECKS = {
    "email": lambda m, d: True,
    "ip": lambda m, d: all(int(x) <= 255 for x in m.split(".")),
    "card": lambda m, d: 16 <= len(d) <= 19 and luhn(d),
    "phone": lambda m, d: 8 <= len(d) <= 15,
    "iban": lambda m, d: iban(m),
    "ssn": lambda m, d: bool(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", m)),
    "short_card": lambda m, d: 13 <= len(d) <= 15 and d[0] in "3456" and luhn(d),
    "insee": lambda m, d: len(d) == 15 and d[0] in "12" and month(d) and int(d[13:]) == 97 - int(d[:13]) % 97,
    "tax_id": lambda m, d: len(d) == 11 and tax_id(d),
    "nhs": lambda m, d: len(d) == 10 and sum(int(c) * (10 - i) for i, c in enumerate(d)) % 11 == 0,
    "routing": lambda m, d: len(d) == len(m) == 9 and int(d[:2]) in PREFIX and sum(int(c) * (3, 7, 1)[i % 3] for i, c in enumerate(d)) % 10 == 0,
    "dni": lambda m, d: "TRWAGMYFPDXBNJZSQVHLCKE"[int(m[:8]) % 23] == m[-1],
    "mac": lambda m, d: True,
}


def plain(text):
    text, out = text or "", []
    for kind in pii.KINDS:
        for m in re.finditer(pii.PLAIN[kind.proposal], text):
            if not CHECKS[kind.name](m[0], re.sub("[^0-9]", "", m[0])):
                continue
            before, after = text[max(0, m.start() - 60) : m.start()], text[m.end() : m.end() + 30]
            near = re.sub("[A-Z]", lambda x: x[0].lower(), before + " " + after)
            points = kind.points
            if re.search(pii.named(kind.words), near):
                points += 25
            elif re.search(pii.named(pii.AGAINST), near):
                points -= 20
            if kind.name not in pii.BASE:
                if points < 50 or re.search(r"[A-Za-z0-9.,:+/_-]$", before) or re.match("[A-Za-z0-9]|[.,:+/_-][A-Za-z0-9]", after):
                    continue
            out.append((kind.name, m.start(), m.end(), min(points, 100)))
    return out


def report(text):
    spans = plain(text)
    joined = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b, _ in s)
    base = joined([s for s in spans if s[0] in pii.BASE])
    return (*(sum(s[0] == k for s in spans) for k in pii.BASE), hashlib.sha256(base.encode()).hexdigest(), joined(spans), max((s[3] for s in spans), default=0) / 100)


EXAMPLES = [
    "IBAN DE89 3704 0044 0532 0130 00, then GB29NWBK60161331926819. ES9121000418450200051332 and DE88370400440532013000 fails",
    "xDE89370400440532013000 and DE89370400440532013000x are inside words; compte FR1420041010050500013M02606",
    "ssn 078-05-1120, 666-05-1120, 000-12-3456, 123-00-4567, 219-09-9999.",
    "amex 378282246310005 and, far away " + "x " * 60 + "378282246310005 alone",
    "version 1.2.3.4, ip address 10.0.0.1 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 01.002.0003.255",
    "a@b.co_x@c.com, a@b@c.de, x@y, ..%@a.b-c.d, é@a.b é.x@a.bé",
    "+1 (487) 555-7209, +12345, +1234567890123456, ++49 30 1234567-, +1((((((5 tel +33 1 23 45 67 89",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111  1111 1111 1111, 5500005555555559 0 1",
    "Steuernummer 86 095 742 719; nhs 943 476 5919; routing 021000021; NIR 2 84 12 76 451 089 93; DNI 12345678Z; 12345678A",
    "mac 00:1A:2b:3c:4d:5e, 00:1A:2b:3c:4d:5e:6f and 00-1a-2B-3C-4D-5E",
    "12 " * 4000 + "4111111111111111 card " + "é 1.1.1.1 " * 300,
]
#: Texts on which the plain expressions take the square of the length, and the spans that they hold.
SLOW = {
    "a" * 400_000 + "@": "",
    "1" * 400_000 + ".2.3.4": "",
    "a@b" + ".c" * 200_000: "email:0:400003",
    "1 " * 200_000: "",
    "+1" + "(" * 400_000: "",
    "é 1.1.1.1 " * 20_000: ",".join(f"ip:{10 * i + 2}:{10 * i + 9}" for i in range(20_000)),
}


def test_report_equals_plain_python(spark):
    rng = random.Random(12)
    made = ["".join(rng.choice(["a", "@", ".", "1", "2", "55", "-", " ", "+", "é", "_", "41111111", "ssn", "(", "0", "DE"]) for _ in range(rng.randint(1, 60))) for _ in range(600)]
    texts = TEXTS + EXAMPLES + made
    got = {r["doc_id"]: tuple(r)[1:] for r in pii.pii_report(documents(spark, texts)).collect() if r["doc_id"] is not None}
    for i, t in enumerate(texts):
        assert got[i] == report(t), (t or "")[:200]
    found = {k for r in got.values() for k in re.findall("([a-z_]+):", r[5])}
    assert found == {k.name for k in pii.KINDS}


def test_long_texts_take_linear_time(spark):
    began = time.time()
    got = {r["doc_id"]: r["spans"] for r in pii.pii_report(documents(spark, list(SLOW), clash=False)).collect() if r["doc_id"] is not None}
    assert [got[i] for i in range(len(SLOW))] == list(SLOW.values())
    assert time.time() - began < 60


def test_results_that_are_defined(spark):
    df = documents(spark, [None, "", "mail a.b@c.de", LONG, "mail a.b@c.de"])
    rows = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    assert rows[0]["spans"] == rows[1]["spans"] == rows[3]["spans"] == [] and rows[2]["spans"] == rows[4]["spans"]
    (s,) = rows[2]["spans"]
    assert (s["kind"], s["start"], s["end"], s["points"], s["match"]) == ("email", 5, 13, 100, "a.b@c.de")
    assert pii.pii_report(df.limit(0)).collect() == []
    none = pii.pii_report(documents(spark, TEXTS)).filter("doc_id IS NULL").collect()
    assert len(none) == 1 and none[0]["spans"] == ""
    same = [tuple(r) for r in pii.pii_report(documents(spark, TEXTS)).filter("doc_id = 5").collect()]
    assert len(same) == 2 and same[0] == same[1]


def test_no_python_on_the_main_path(spark):
    plan = pii.pii_report(documents(spark, ["x"], clash=False))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
