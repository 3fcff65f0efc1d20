import collections
import random

import numpy as np
import pytest

from cloneframe.llm import near_dedup

from .cases import TEXTS, documents


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    out = [(i, t) for i, t in enumerate(TEXTS[:-1])]
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append((len(out), rng.choice([" ", "\n", "\t "]).join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    # A chain: neighbours are similar, its ends are not.
    base = [rng.choice(words) for _ in range(300)]
    for k in range(6):
        out.append((len(out), " ".join(base[25 * k : 25 * k + 200])))
    return out


def test_against_brute_force(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(df).collect()}
    for i, (size, component) in brute(corpus).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (size, component, i == component)


def test_open_pairs_by_further_centres(spark, corpus, monkeypatch):
    """With no room for open pairs, other members become centres, and the last turn compares what is left."""
    monkeypatch.setattr(near_dedup, "OPEN_PAIRS", 0)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert got == {i: c for i, (_, c) in brute(corpus).items()}


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    sets = [a[:600], a[150:750], a[:1], a[:0]]
    s = near_dedup.similarity_sketches(sets)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    assert (s[:3] != none).all() and (s[3] == none).all()
    assert abs((s[0] == s[1]).mean() - 450 / 750) < 0.12


def test_keep_one(spark):
    df = documents(spark)
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    count = collections.Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert count[5] == 1 and 6 not in count and count[None] == 1 and set(range(len(TEXTS))) - {6} <= set(count)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("open_pairs", [0, 400])
def test_rows_that_share_an_id(spark, monkeypatch, open_pairs):
    """Different texts under one id, in buckets of many near copies: a result that does not depend on partitioning, and one row of an id kept."""
    monkeypatch.setattr(near_dedup, "OPEN_PAIRS", open_pairs)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(words) for _ in range(80)] for _ in range(4)]
    rows = []
    for i in range(60):
        w = list(bases[i % 4])
        w[rng.randrange(80)] = rng.choice(words)
        rows.append((i // 3, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    results = [sorted(map(tuple, near_dedup.near_duplicates(df.repartition(n)).collect())) for n in (1, 5)]
    assert results[0] == results[1] and len(results[0]) == 60
    kept = [sorted(r["doc_id"] for r in near_dedup.keep_one(df.repartition(n)).collect()) for n in (1, 5)]
    assert kept[0] == kept[1] and len(set(kept[0])) == len(kept[0]) >= 1
    components = {r[0] for r in results[0]}
    assert components <= {r["doc_id"] for r in df.collect()}
