"""MinHash near-duplicate groups (free style: NumPy sketches in Arrow tasks, the rest DataFrame operations).

1. ``sketches``: five-word shingles of each whole text as 64-bit hashes; the set's size,
   a 128-bit hash of the set, and a fast similarity sketch of ``COORDINATES`` values.
   Round i < t throws every shingle into one bin by a hash of its own with values in [i, i + 1); round
   t + j puts all into bin j. Minima are kept per bin, and rounds end when every
   bin is filled, so each coordinate is filled and small sets cost more rounds, not empty bins.
2. Documents of equal sets are one node, named by their smallest id.
3. ``BANDS`` bands of ``ROWS`` coordinates: nodes that share a band's key are candidates.
   0.75-similar nodes share none with probability (1 - 0.75**5)**40 < 3e-5.
4. Verification on full sets, natively by ``array_intersect``: link if 100 * intersection >= 75 * union.
5. A band's bucket isn't expanded into all pairs: its members are first compared with the bucket's smallest id.
   Members that are then in one component need no further comparison. What is left are buckets over several components. Members go whose
   shingles of their own leave no room for a link (``_linkable``, exact); while the open pairs are many, another
   member is the centre; then all open pairs are compared, so no link that joins components is lost.
6. Components: smallest-label propagation with pointer jumping over the links, until nothing changes.

Skew: exact copies never meet in a bucket (2). Copies of one set meet only in
partial aggregates and in joins whose inputs are written tables, which adaptive execution splits. A bucket
of near copies costs as many comparisons as it has members. Tables that are read
again are written in the shared folder.

Defined results: null, empty and blank texts have 0 shingles and are linked with nothing;
their component is their own id. Texts of one to four words are one shingle. Rows that share an id are one
document: of several different texts under an id, which is the smallest of all, that with the least hash of its set stands for them, and each row has its own n_shingles. Very long
texts are read whole, a slice of texts at a time. No ties arise: the smallest id names a component. A row without an id takes its class's component; without one it has a null component. An empty
table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe_codec import text_slices
from .frames import written

SHINGLE, BANDS, ROWS = 5, 40, 5
COORDINATES = BANDS * ROWS
NUM, DEN = 75, 100
#: Candidate ids that may be broadcast to the scan for their texts; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Open pairs a node, on average, that are compared at once instead of by another centre; so are those that a centre left more than half of.
OPEN_PAIRS = 400
CENTRES = 4

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_BASE = _U(_ODD)
_CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _step(k: int) -> np.uint64:
    return _U(k * _ODD & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    inverse = pow(int(_BASE), -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[_U(1), np.full(n, _BASE)], dtype=_U)
        down = np.cumprod(np.r_[_U(1), np.full(n, _U(inverse))], dtype=_U)
    return up, down


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start of each word, its 64-bit hash) of text bytes, words being runs of other than ASCII white space."""
    data = np.frombuffer(raw, np.uint8)
    space = np.r_[True, _SPACE[data], True]
    edge = space[1:] != space[:-1]
    starts, ends = np.flatnonzero(edge[:-1] & ~space[1:-1]), np.flatnonzero(edge[1:] & ~space[1:-1]) + 1
    hashes = np.empty(len(starts), _U)
    at = 0
    while at < len(starts):  # words of about a million bytes at once, one word at least
        first = int(starts[at])
        end = max(at + 1, int(np.searchsorted(starts, first + _CHUNK)))
        last = int(ends[end - 1])
        up, down = _powers(max(2 * _CHUNK, last - first))
        sums = np.r_[_U(0), np.cumsum((data[first:last].astype(_U) + _U(1)) * up[: last - first], dtype=_U)]
        s, e = starts[at:end] - first, ends[at:end] - first
        hashes[at:end] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(_U))
        at = end
    return starts, hashes


def _windows(h: np.ndarray) -> np.ndarray:
    """A hash of every run of SHINGLE words."""
    n = len(h) - SHINGLE + 1
    total = np.zeros(n, _U)
    for k in range(SHINGLE):
        total += mix(h[k : k + n] + _step(k + 1))
    return mix(total)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raws = [(t or "").encode().lower() for t in texts]
    starts, words = word_hashes(b"\n".join(raws))
    cuts = np.searchsorted(starts, np.r_[0, np.cumsum([len(r) + 1 for r in raws])]).tolist()
    all_windows = _windows(words) if len(words) >= SHINGLE else words[:0]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        if b - a >= SHINGLE:
            x = np.sort(all_windows[a : b - SHINGLE + 1])
            x = x[np.r_[True, x[1:] != x[:-1]]]
        elif b > a:
            part = mix(words[a:b] + np.arange(101, 101 + b - a).astype(_U) * _BASE)
            x = mix(np.array([part.sum(dtype=_U) + _U(b - a)], _U))
        else:
            x = words[:0]
        out.append(x)
    return out


def set_hash(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def similarity_sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """A row of t coordinates per set; the round is in the top bits, so that the earliest filled round wins. Empty sets give a row of the largest value."""
    none = _U(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), t), none)
    live = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    for i in range(2 * t):
        if not len(live):
            break
        flat = np.concatenate([sets[k] for k in live])
        row = np.repeat(live, [len(sets[k]) for k in live])
        h = mix(flat + _step(i + 1))
        bins = (h % _U(t)).astype(np.int64) if i < t else np.full(len(h), i - t)
        value = (_U(i) << _U(54)) | (mix(h) >> _U(10))
        np.minimum.at(out.reshape(-1), row * t + bins, value)
        live = live[(out[live] == none).any(1)]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """(rows, BANDS) keys; a key holds its band's number."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1).astype(_U) * _BASE, parts.shape[:2])
    for k in range(ROWS):
        keys = mix(keys + parts[:, :, k])
    return keys.view(np.int64)


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, set_hash, bands); hash and bands are null for empty sets."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at, part in text_slices(batch.column(1), 2_000_000):
                sets = shingle_sets(part)
                keys = band_keys(similarity_sketches(sets))
                size = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(part)),
                        pa.array(size, pa.int64()),
                        pa.array([set_hash(s) if n else None for s, n in zip(sets, size)], pa.binary()),
                        pa.array([k if n else None for k, n in zip(keys, size)], pa.list_(pa.int64())),
                    ],
                    names=[id_col, "n_shingles", "set_hash", "bands"],
                )

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_shingles long, set_hash binary, bands array<long>")


def full_sets(df: DataFrame, id_col: str, text_col: str, hash_col: str) -> DataFrame:
    """(node, items): the sorted shingle hashes of each text whose set has the hash that stands in ``hash_col``."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at, part in text_slices(batch.column(1), 2_000_000):
                sets = shingle_sets(part)
                wanted = batch.column(2).slice(at, len(part)).to_pylist()
                own = [k for k, (s, h) in enumerate(zip(sets, wanted)) if len(s) and set_hash(s) == h]
                if own:
                    offsets = np.r_[0, np.cumsum([len(sets[k]) for k in own])].astype(np.int32)
                    items = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([sets[k].view(np.int64) for k in own])))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)).take(pa.array(own)), items], names=["node", "items"])

    return df.select(F.col(id_col), F.col(text_col), F.col(hash_col)).mapInArrow(run, f"node {kind}, items array<long>")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, linked): the intersection of the full sets of each pair. ``a`` may be a frequent centre: only ids are dealt by it."""
    a = sets.select(F.col("node").alias("a"), F.col("items").alias("_ia"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("_ib"))
    both = pairs.join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("_ia", "_ib")))
    return both.select("a", "b", "both", (DEN * F.col("both") >= NUM * (F.size("_ia") + F.size("_ib") - F.col("both"))).alias("linked"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    return overlaps(pairs, sets).filter("linked").select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the links, for every node of a link."""
    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = written(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_v")).select("node", F.least("node", "_v").alias("label"), F.lit(True).alias("moved")))
    while not labels.filter("moved").isEmpty():
        near = edges.join(labels.select(F.col("node").alias("u"), "label"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("_near"))
        step = labels.select("node", F.col("label").alias("_old")).join(near, "node").select("node", "_old", F.least("_old", "_near").alias("_new"))
        jump = labels.select(F.col("node").alias("_new"), F.col("label").alias("_far"))
        labels = written(
            step.join(jump, "_new").select("node", F.least("_new", "_far").alias("label"), (F.least("_new", "_far") < F.col("_old")).alias("moved"))
        )
    return labels.select("node", "label")


def _alike(n: str, m: str, s: str, t: str) -> Column:
    """Sizes, and shingles that others hold too (``s`` of ``n``, ``t`` of ``m``), that allow a link at all: the intersection is at most the lesser of s and t."""
    return (DEN * F.least(n, m) >= NUM * F.greatest(n, m)) & ((NUM + DEN) * F.least(s, t) >= NUM * (F.col(n) + F.col(m)))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document."""
    sk = written(sketches(df, id_col, text_col))
    classes = written(sk.filter("set_hash is not null").groupBy("set_hash").agg(F.min(id_col).alias("node")))
    # One set for each node: of rows that share an id and are their sets' smallest id, the set with the least hash.
    chosen = written(classes.groupBy("node").agg(F.min("set_hash").alias("set_hash")))
    own = chosen.select("set_hash", F.col("node").alias(id_col))
    bands = written(
        sk.join(own, ["set_hash", id_col])
        .select(F.col(id_col).alias("node"), F.col("n_shingles").cast("int").alias("n"), F.explode("bands").alias("band"))
        .groupBy("band", "node")
        .agg(F.min("n").alias("n"))
    )
    shared = bands.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
    bucket = written(bands.join(shared.select("band"), "band", "left_semi"))
    ids = written(chosen.join(bucket.select("node").distinct(), "node").select(F.col("node").alias(id_col), F.col("set_hash").alias("_chosen")))
    if not ids.isEmpty():
        small = ids.count() <= BROADCAST_IDS
        texts = df.select(id_col, text_col).join(F.broadcast(ids) if small else ids, id_col)
        sets = written(full_sets(texts, id_col, text_col, "_chosen").dropDuplicates(["node"]))
        keys = sk.join(own, ["set_hash", id_col]).select(F.col(id_col).alias("node"), "bands").dropDuplicates(["node"])
        labels = components(_all_links(bucket, sets, ids.count(), keys))
        named = classes.join(labels, "node", "left").select("set_hash", F.coalesce("label", "node").alias("component_id"))
    else:
        named = classes.select("set_hash", F.col("node").alias("component_id"))
    named = written(named)
    out = sk.select(id_col, "n_shingles", "set_hash").join(named, "set_hash", "left")
    component = F.when(F.col("set_hash").isNull(), F.col(id_col)).otherwise(F.col("component_id"))
    return out.select(id_col, "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _open(named: DataFrame) -> DataFrame:
    """(band, low, pairs) of the buckets over several labels: their smallest set size and the pairs of different labels."""
    per_label = named.groupBy("band", "label").agg(F.count("*").alias("_c"), F.min("n").alias("_low"))
    per_band = per_label.groupBy("band").agg(
        F.count("*").alias("_labels"), F.sum("_c").alias("_all"), F.sum(F.col("_c") * F.col("_c")).alias("_same"), F.min("_low").alias("low")
    )
    return per_band.filter("_labels > 1").select("band", "low", ((F.col("_all") * F.col("_all") - F.col("_same")) / 2).alias("pairs"))


def _linkable(open_bucket: DataFrame, sets: DataFrame) -> DataFrame:
    """The bucket rows (band, node, n, s, label, low) whose node can have an open link at all, s being how many of its shingles another open node has.

    A shingle that no other open node has is in no intersection. With u such shingles, a set of n and a partner of m >= low and
    m >= 0.75 n, the intersection is n - u at most, so a link needs (NUM + DEN)(n - u) >= NUM (n + m). This is
    exact, and takes one aggregate; of many copies with edits of their own it leaves those that are near enough to another.
    """
    nodes = open_bucket.select("node").distinct()
    items = sets.join(nodes, "node", "left_semi").select("node", F.explode("items").alias("item"))
    single = items.groupBy("item").agg(F.count("*").alias("_c"), F.min("node").alias("node")).filter("_c = 1")
    own = single.groupBy("node").agg(F.count("*").alias("_u"))
    shared = F.col("n") - F.coalesce("_u", F.lit(0))
    partner = F.greatest(F.col("low"), F.ceil(F.col("n") * NUM / DEN))
    return open_bucket.join(own, "node", "left").withColumn("s", shared.cast("int")).filter((NUM + DEN) * F.col("s") >= NUM * (F.col("n") + partner)).drop("_u")


def _all_links(bucket: DataFrame, sets: DataFrame, nodes: int, keys: DataFrame) -> DataFrame:
    """Links that join all that the buckets' pairs join; keys has each node's bands."""
    links, centred = None, bucket.select("*", F.col("n").alias("s"), F.col("node").alias("label"))
    bucket, before = centred.drop("label"), float("inf")
    for turn in range(CENTRES + 1):
        if turn:
            named = bucket.join(components(links), "node", "left").select("band", "node", "n", "s", F.coalesce("label", "node").alias("label"))
            centred = written(named.join(_open(named).select("band", "low"), "band"))
            if turn == 1 and not centred.isEmpty():
                centred = written(_linkable(centred, sets))
            bucket = centred.select("band", "node", "n", "s")
            left = _open(centred).agg(F.sum("pairs")).first()[0]
            if not left:
                break
            if left <= OPEN_PAIRS * nodes or left > before / 2 or turn == CENTRES:
                pairs = _open_pairs(centred, centres, seen, keys)
                return written(links.union(verified(pairs, sets)))
            before = left
        turned = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
        centre = centred.groupBy("band").agg(F.min(F.struct(turned.alias("_o"), "node", "n", "s", "label")).alias("_c"))
        centre = written(centre.select("band", F.col("_c.node").alias("a"), F.col("_c.n").alias("_na"), F.col("_c.s").alias("_sa"), F.col("_c.label").alias("_la")))
        pairs = (
            centred.join(centre, "band")
            .filter((F.col("node") != F.col("a")) & (F.col("label") != F.col("_la")) & _alike("n", "_na", "s", "_sa"))
            .select("a", F.col("node").alias("b"))
            .distinct()
        )
        if turn == 0:
            centres, seen = centre.select("band", F.col("a").alias("_a")), written(overlaps(pairs, sets))
            links = written(seen.filter("linked").select("a", "b"))
        else:
            links = written(links.union(verified(pairs, sets)))
    return links


def _open_pairs(centred: DataFrame, centres: DataFrame, seen: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b) of the open pairs of all buckets that may be links, each from the first band that it shares.

    With c the bucket's first centre, whose intersection with every member is known, x and y have at most
    min(|xc|, |yc|) shingles of c in common, and at most min(s - |xc|, t - |yc|) others. Pairs that this leaves short are no links.
    """
    c = centred.join(centres, "band").join(seen.select(F.col("a").alias("_a"), F.col("b").alias("node"), "both"), ["_a", "node"], "left").join(keys, "node")
    c = c.withColumn("o", F.when(F.col("node") == F.col("_a"), F.col("n")).otherwise(F.col("both")))
    c = c.withColumn("early", F.slice("bands", 1, F.array_position("bands", F.col("band")).cast("int") - 1))
    x, y = (c.select("band", *(F.col(k).alias(f"{k}{i}") for k in ("node", "n", "s", "o", "label", "early"))) for i in "ab")
    parted = F.least("oa", "ob") + F.least(F.col("sa") - F.col("oa"), F.col("sb") - F.col("ob"))
    most = F.when(F.col("oa").isNull() | F.col("ob").isNull(), F.least("sa", "sb")).otherwise(parted)
    may = (F.col("nodea") < F.col("nodeb")) & (F.col("labela") != F.col("labelb")) & _alike("na", "nb", "sa", "sb")
    may = may & ((NUM + DEN) * most >= NUM * (F.col("na") + F.col("nb"))) & ~F.arrays_overlap("earlya", "earlyb")
    return x.join(y, "band").filter(may).select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct()


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without those of a group other than its smallest id. Rows without an id stay; of rows that share an id one stays.

    The ids that go are broadcast to the rows while they are few, else joined by shuffle.
    """
    found = near_duplicates(df.select(id_col, text_col), id_col, text_col)
    gone = written(found.filter(~F.col("kept") & F.col(id_col).isNotNull()).select(id_col).distinct())
    few = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    left = df.join(few(gone), id_col, "left_anti")
    repeated = written(df.groupBy(id_col).count().filter(F.col("count") > 1).select(id_col))
    if not repeated.isEmpty():
        again = few(repeated)
        left = left.join(again, id_col, "left_anti").unionByName(left.join(again, id_col, "left_semi").dropDuplicates([id_col]))
    return left.select(df.columns)
