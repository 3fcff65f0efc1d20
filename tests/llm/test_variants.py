"""Spelling variants against plain Python that compares all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from cloneframe.llm import variants

from .cases import TEXTS, documents


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}
    form, n_near = {}, {}
    for w, n in words.items():
        others = [v for v in words if abs(len(v) - len(w)) <= 1 and near(v, w)]
        n_near[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], n_near[w], words.get(form[w])))
    return out


def made(seed):
    """Words over few letters, so that many are near, with counts that chain; runs of equal letters; long words around the limit of literal keys."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abÿé") for _ in range(rng.randint(5, 8))) for _ in range(60)]
    texts = [" ".join(rng.choices(stems, k=40)) for _ in range(60)]
    texts += ["aaaaaa1" * 5 + "aaaaaaa1" * 30 + "aaaaaaaa1" * 160 + "aaaaaaaaa1" * 900 + "aabaaa-" * 7]
    for size in (63, 64, 65, 66, 67, 300):
        word = "".join(rng.choice("xyz") for _ in range(size))
        texts += [" ".join([word] * 60 + [word[:40] + "q" + word[41:]] * 8 + [word[:50] + word[51:]] * 7 + [word[::-1]] * 6 + [word + "x"] * 5 + ["y" + word[1:]] * 9)]
    return texts + ["×÷" * 4 + " Straße STRASSE Ünïcödé " * 6]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    texts = TEXTS + made(seed)
    df = documents(spark, texts)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = variants.spelling_variants(df).collect()
    assert len({r["word"] for r in got}) == len(got)
    want = plain(rows)
    assert {tuple(r) for r in got} == want
    assert any(r[2] not in (r[0], r[1]) for r in want), "no chain of forms in the test"


def test_keys_of_long_words():
    rng = random.Random(3)
    for size in (1, 2, 63, 64, 65, 66, 130):
        word = "".join(rng.choice("ab") for _ in range(size))
        for i, key in enumerate(variants.deletions(word)):
            assert key == variants.own_key(word[:i] + word[i + 1 :])
    assert len(variants.deletions("ab" * 20_000)) == 40_000


def test_empty_tables(spark):
    assert variants.spelling_variants(documents(spark).limit(0)).collect() == []
    assert variants.spelling_variants(documents(spark, [None, "", "short words"])).collect() == []
    df = variants.spelling_variants(documents(spark).limit(0))
    assert df.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
