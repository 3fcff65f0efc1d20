"""Distance joins: edge tables (left_ix, right_ix, dist) instead of matrices.

``radius_join`` compares distinct strings only. They are dealt into blocks by the length of the
first column; two blocks meet only if their lengths allow the radius, and one task compares a few blocks of either side with
NumPy, of bounded size whatever the input: tasks form a grid, so that a block is not sent once for each block that it meets. Edges are joined back to rows by the strings. ``edit_join`` finds strings of equal keys within a few
edits by an equi-join on parts or deletions of the strings, whichever costs less. ``native_join`` compares all pairs of equal keys by one expression: for results that hold all
those pairs, and as a check on the others.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import MetricSpec
from ..sources.store import written

#: Distinct tuples of a block.
BLOCK = 1000
#: Blocks of either side of a task at most, and tasks for each shuffle partition below which there are fewer.
SIDE, TASKS = 16, 4
#: Rows of keys that cost as much as one pair, which is made distinct and verified.
PAIR_COST = 4


def _groups(df: DataFrame, spec: MetricSpec) -> tuple[DataFrame, DataFrame]:
    """Distinct tuples with their length and block, and (size, blocks): how many blocks of about BLOCK tuples each length has.

    A block number is the row's hash modulo as many blocks as its length needs by count, so common lengths spread.
    """
    tuples = df.select(*spec.columns).dropna().distinct().withColumn("_size", F.length(spec.columns[0]))
    needed = tuples.groupBy("_size").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    return tuples.join(F.broadcast(needed), "_size").withColumn("_block", F.pmod(F.xxhash64(*spec.columns), F.col("_blocks"))), needed  # one row a length


def grid(left: DataFrame, right: DataFrame, spec: MetricSpec, radius: float | None) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt over a grid of tasks: (size_left, size_right, line, column, rows) for each two lengths that allow the radius.

    A task takes ``g`` blocks of either side and compares each with each, so a block goes to a g-th of the blocks that it meets. g is at most ``SIDE``,
    and less while there would be few tasks: it follows from the number of meeting blocks and the shuffle partitions.
    """
    (a, na), (b, nb) = _groups(left, spec), _groups(right, spec)
    l, r = na.toDF("_size_left", "_nl"), nb.toDF("_size_right", "_nr")
    reach = F.abs(F.col("_size_left") - F.col("_size_right")) * F.lit(float(spec.length_cost()))
    meet = written(l.join(F.broadcast(r), reach <= radius if radius is not None else F.lit(True)))
    pairs = meet.agg(F.sum(F.col("_nl") * F.col("_nr"))).first()[0] or 1
    tasks = TASKS * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = max(1, min(SIDE, int((pairs / tasks) ** 0.5)))
    key = ["_size_left", "_size_right", "_line", "_column"]

    def dealt(df: DataFrame, size: str, own: str, other: str, count: str, name: str) -> DataFrame:
        packed = df.withColumnRenamed("_size", size).withColumn(own, F.floor(F.col("_block") / g)).groupBy(size, own).agg(F.collect_list(F.struct(*spec.columns)).alias(name))
        return packed.join(F.broadcast(meet), size).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(count) / g) - 1))).select(*key, name)

    return dealt(a, "_size_left", "_line", "_column", "_nr", "_left"), dealt(b, "_size_right", "_column", "_line", "_nl", "_right")


def distances_of(left: pa.StructArray, right: pa.StructArray, spec: MetricSpec) -> tuple[np.ndarray, list[np.ndarray]]:
    """The weighted total of a pair of blocks and each part; each part is computed on distinct strings."""
    total, parts = np.zeros((len(left), len(right))), []
    for name, metric, weight in spec.parts:
        a, b = (x.field(name).dictionary_encode() for x in (left, right))
        part = metric.block(a.dictionary.to_pylist(), b.dictionary.to_pylist())[np.ix_(a.indices.to_numpy(), b.indices.to_numpy())]
        parts.append(part)
        total = total + weight * part
    return total, parts


def radius_join(
    left: DataFrame, right: DataFrame, spec: MetricSpec, radius: float | None, left_id: str = "clone_ix", right_id: str = "clone_ix", parts: bool = False
) -> DataFrame:
    """(left_ix, right_ix, dist[, one column for each part]) of all pairs with dist <= radius; without a radius, of all pairs. Rows with a null in a metric column have no edges."""
    a, b = grid(left, right, spec, radius)
    meet = a.join(b, ["_size_left", "_size_right", "_line", "_column"])
    kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    fields = [f"{s}_{i} {kinds[c]}" for s in "lr" for i, c in enumerate(spec.columns)] + ["dist double"]
    fields += [f"part_{i} double" for i in range(len(spec.parts))] if parts else []

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                lefts, rights = (batch.column(c).slice(k, 1).flatten() for c in (0, 1))
                for at, to in itertools.product(range(0, len(lefts), BLOCK), range(0, len(rights), BLOCK)):
                    x, y = lefts.slice(at, BLOCK), rights.slice(to, BLOCK)
                    total, each = distances_of(x, y, spec)
                    i, j = np.nonzero(total <= radius) if radius is not None else np.indices(total.shape).reshape(2, -1)
                    cols = [t.field(c).take(pa.array(n)) for t, n in ((x, i), (y, j)) for c in spec.columns]
                    cols.append(pa.array(total[i, j].astype(float)))
                    cols += [pa.array(e[i, j].astype(float)) for e in each] if parts else []
                    yield pa.RecordBatch.from_arrays(cols, names=[f.split(" ")[0] for f in fields])

    near = meet.select("_left", "_right").mapInArrow(compare, ", ".join(fields))
    lefts = left.select(F.col(left_id).alias("left_ix"), *(F.col(c).alias(f"l_{i}") for i, c in enumerate(spec.columns)))
    rights = right.select(F.col(right_id).alias("right_ix"), *(F.col(c).alias(f"r_{i}") for i, c in enumerate(spec.columns)))
    n = len(spec.columns)
    joined = near.join(lefts, [f"l_{i}" for i in range(n)]).join(rights, [f"r_{i}" for i in range(n)])
    named = [F.col(f"part_{i}").alias(f"dist_{c}") for i, c in enumerate(spec.columns)] if parts else []
    return joined.select("left_ix", "right_ix", "dist", *named)


def _parts(a: DataFrame, b: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Index by parts: a left string cut into radius + 1 parts has one that stands unchanged in any string within the radius, moved by no more than
    the edits before and after it allow. Keys of left strings, and of right ones at those lengths and places."""
    parts = radius + 1
    # Of a length n, part i starts at begin and has size letters; the longer parts come last.
    begin = lambda n, i: i * F.floor(n / parts) + F.greatest(F.lit(0), i - (parts - n % parts))
    size = lambda n, i: F.floor(n / parts) + (i >= parts - n % parts).cast("int")
    n, i, m, d = F.col("_n"), F.col("_i"), F.length("right"), F.length("right") - F.col("_n")
    cut = a.withColumn("_n", F.length("left")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(radius))))
    cut = cut.withColumn("_part", F.substr("left", (begin(n, i) + 1).cast("int"), size(n, i).cast("int")))
    near = b.withColumn("_n", F.explode(F.sequence(F.greatest(F.lit(0), m - radius), m + radius))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(radius))))
    low = F.greatest(F.lit(0), begin(n, i) - i, begin(n, i) + d - (radius - i))
    high = F.least(m - size(n, i), begin(n, i) + i, begin(n, i) + d + (radius - i))
    near = near.withColumns({"_low": low.cast("int"), "_high": high.cast("int"), "_size": size(n, i).cast("int")}).filter("_low <= _high")
    near = near.withColumn("_at", F.explode(F.sequence("_low", "_high"))).withColumn("_part", F.substr("right", F.col("_at") + 1, F.col("_size")))
    return cut, near.drop("_low", "_high", "_size", "_at").distinct()


def deletion_keys(string: Column, radius: int) -> Column:
    """array<struct(key, gone)>: the distinct strings that are left when ``gone`` letters go, for up to ``radius`` of them."""
    first = F.array(F.struct(string.alias("key"), F.lit(0).alias("at")))

    def shorter(x: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.length(x["key"])), lambda p: (p >= x["at"]) & (p < F.length(x["key"])))
        return F.transform(places, lambda p: F.struct(F.concat(F.substr(x["key"], F.lit(1), p), F.substr(x["key"], p + 2)).alias("key"), p.alias("at")))

    levels = [first]
    for _ in range(radius):
        levels.append(F.array_distinct(F.flatten(F.transform(levels[-1], shorter))))
    return F.flatten(F.array(*(F.array_distinct(F.transform(x, lambda y: F.struct(y["key"].alias("_part"), F.lit(k).alias("_gone")))) for k, x in enumerate(levels))))


def _ways(a: DataFrame, b: DataFrame, names: list[str], radius: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The left and right keys by parts, and (n, deletes): by which index left strings of each length are joined. What the parts
    would pair is counted from their keys' counts, and held against the number of keys that deletions make; the less costly wins. Right strings
    serve 2 radius + 1 lengths, so each bears such a part of their keys."""
    cut, near = (written(x) for x in _parts(a, b, radius))
    key = [*names, "_n", "_i", "_part"]
    count = lambda df, c: df.groupBy(*key).agg(F.count("*").alias(c))
    pairs = count(cut, "_l").join(count(near, "_r"), key).groupBy("_n").agg(F.sum(F.col("_l") * F.col("_r")).alias("_pairs"))
    choose = lambda n, k: F.lit(1.0) if k == 0 else choose(n, k - 1) * F.greatest(n - k + 1, F.lit(0)) / k
    made = lambda n: sum((choose(n, k) for k in range(1, radius + 1)), F.lit(1.0))
    cost = lambda df, c: df.groupBy(F.length(c).alias("_m")).agg(F.sum(made(F.length(c))).alias("_keys"))
    keys = cost(a, "left").select(F.col("_m").alias("_n"), "_keys").union(cost(b, "right").select(F.explode(F.sequence(F.col("_m") - radius, F.col("_m") + radius)).alias("_n"), F.col("_keys") / (2 * radius + 1)))
    return cut, near, written(pairs.join(keys.groupBy("_n").agg(F.sum("_keys").alias("_keys")), "_n").select("_n", (PAIR_COST * F.col("_pairs") > F.col("_keys")).alias("_deletes")))


def edit_candidates(a: DataFrame, b: DataFrame, names: list[str], radius: int) -> DataFrame:
    """(keys, left, right): the pairs of distinct strings of equal keys that the index leaves to be verified; all within ``radius`` edits are among them."""
    cut, near, ways = _ways(a, b, names, radius)
    ways = F.broadcast(ways)  # one row for each length that strings have
    by_parts = cut.join(ways.filter("NOT _deletes"), "_n").join(near, [*names, "_n", "_i", "_part"]).select(*names, "left", "right")
    deleted = ways.filter("_deletes")
    rights = deleted.select(F.explode(F.sequence(F.col("_n") - radius, F.col("_n") + radius)).alias("_m")).distinct()
    cut_keys = a.withColumn("_n", F.length("left")).join(deleted.select("_n"), "_n").select(*names, "left", F.inline(deletion_keys(F.col("left"), radius)))
    near_keys = b.withColumn("_m", F.length("right")).join(F.broadcast(rights), "_m").select(*names, "right", F.inline(deletion_keys(F.col("right"), radius)))
    shared = cut_keys.withColumnRenamed("_gone", "_x").join(near_keys.withColumnRenamed("_gone", "_y"), [*names, "_part"])
    # Letters that go from both on top of these would be the same, so one side has lost as many as it may, or has none left.
    by_deletions = shared.filter((F.greatest("_x", "_y") == radius) | (F.col("_part") == "")).select(*names, "left", "right")
    return by_parts.union(by_deletions).distinct()


def edit_join(
    left: DataFrame, right: DataFrame, column: str, radius: int, keys: list[str], left_id: str = "clone_ix", right_id: str = "clone_ix"
) -> DataFrame:
    """(left_ix, right_ix, dist) of rows of equal ``keys`` whose strings are at most ``radius`` edits apart; none for nulls.

    Distinct strings are indexed, and only pairs that share a key of the index are compared. Strings of each length take one of two indexes, by
    counted cost: parts that stand unchanged, where strings are long and their parts differ; or the strings that are left when letters are
    deleted (both sides lose up to ``radius``), where ends are conserved and parts would be shared by most, as in CDR3s. Either finds every pair.
    """
    side = lambda df, i, s: df.select(F.col(i).alias(f"{s}_ix"), *(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.col(column).alias(s)).dropna()
    a, b = side(left, left_id, "left"), side(right, right_id, "right")
    names = [f"_k{n}" for n in range(len(keys))]
    pairs = edit_candidates(written(a.select(*names, "left").distinct()), written(b.select(*names, "right").distinct()), names, radius)
    close = pairs.withColumn("dist", F.levenshtein("left", "right", radius)).filter("dist >= 0")
    return close.join(a, [*names, "left"]).join(b, [*names, "right"]).select("left_ix", "right_ix", F.col("dist").cast("double").alias("dist"))


def native_join(
    left: DataFrame, right: DataFrame, spec: MetricSpec, radius: float, keys: list[str], left_id: str = "clone_ix", right_id: str = "clone_ix"
) -> DataFrame:
    """Edges among rows of equal ``keys``, by one native expression. Distinct strings and their distances come first."""
    side = lambda df, s, i: df.select(F.col(i).alias(f"{s}_ix"), *(F.col(c).alias(f"{s}_{c}") for c in dict.fromkeys([*keys, *spec.columns])))
    a, b = side(left, "left", left_id), side(right, "right", right_id)
    cols = list(dict.fromkeys([*keys, *spec.columns]))
    da, db = a.select(*(f"left_{c}" for c in cols)).distinct(), b.select(*(f"right_{c}" for c in cols)).distinct()
    near = da.join(db, [F.col(f"left_{k}") == F.col(f"right_{k}") for k in keys])
    cost, first = spec.length_cost(), spec.columns[0]
    if cost:
        near = near.filter(F.abs(F.length(f"left_{first}") - F.length(f"right_{first}")) * float(cost) <= radius)
    near = near.withColumn("dist", spec.column(lambda c: F.col(f"left_{c}"), lambda c: F.col(f"right_{c}"))).filter(F.col("dist") <= radius)
    return near.join(a, [f"left_{c}" for c in cols]).join(b, [f"right_{c}" for c in cols]).select("left_ix", "right_ix", F.col("dist").cast("double").alias("dist"))


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """At most k edges of each left row, nearest first, ties by the right id."""
    order = Window.partitionBy("left_ix").orderBy("dist", "right_ix")
    return edges.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def within(edges: DataFrame, left: DataFrame | None = None, radius: float | None = None, left_id: str = "clone_ix", radius_col: str = "radius") -> DataFrame:
    """Edges within one radius, or within each left row's own."""
    if left is None:
        return edges.filter(F.col("dist") <= radius)
    own = left.select(F.col(left_id).alias("left_ix"), F.col(radius_col).alias("_radius"))
    return edges.join(own, "left_ix").filter(F.col("dist") <= F.col("_radius")).drop("_radius")


def join_by_distance(
    edges: DataFrame, left: DataFrame, right: DataFrame, how: str = "inner", left_id: str = "clone_ix", right_id: str = "clone_ix", max_n: int | None = 5,
    radius: float | None = None, radius_col: str | None = None, left_cols: list[str] | None = None, right_cols: list[str] | None = None, suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Left and right rows side by side, all columns suffixed, with ``dist``.

    ``left`` also gives left rows without a kept edge; ``outer`` right rows as well that no kept edge names.
    """
    if how not in ("inner", "left", "outer"):
        raise ValueError("how must be inner, left or outer")
    kept = within(edges, left, None, left_id, radius_col) if radius_col else edges if radius is None else within(edges, radius=radius)
    kept = nearest(kept, max_n) if max_n else kept
    side = lambda df, i, cols, s, k: df.select(F.col(i).alias(f"_{k}"), *(F.col(c).alias(c + s) for c in cols or df.columns))
    a, b = side(left, left_id, left_cols, suffixes[0], "l"), side(right, right_id, right_cols, suffixes[1], "r")
    first = a.join(kept, a["_l"] == kept["left_ix"], "inner" if how == "inner" else "left")
    out = first.join(b, F.col("right_ix") == F.col("_r"), {"inner": "inner", "left": "left", "outer": "full"}[how])
    return out.drop("_l", "_r", "left_ix", "right_ix")


def neighbor_lists(edges: DataFrame) -> DataFrame:
    """(left_ix, neighbors, k_neighbors)."""
    return edges.groupBy("left_ix").agg(F.sort_array(F.collect_list("right_ix")).alias("neighbors"), F.count("*").alias("k_neighbors"))


def add_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sums of two chains where both have an edge."""
    return a.join(b.withColumnRenamed("dist", "_d"), ["left_ix", "right_ix"]).select("left_ix", "right_ix", (F.col("dist") + F.col("_d")).alias("dist"))


def medoids(edges: DataFrame, groups: DataFrame, group: str = "cluster_id", member: str = "clone_ix") -> DataFrame:
    """(group, medoid): the member with the least sum of distances within its group, the first on ties; the first member of groups under three."""
    m = groups.select(F.col(group).alias("_g"), F.col(member).alias("left_ix"))
    inner = edges.join(m, "left_ix").join(m.select(F.col("_g").alias("_h"), F.col("left_ix").alias("right_ix")), "right_ix").filter("_g = _h")
    sums = inner.groupBy("_g", "left_ix").agg(F.sum("dist").alias("_s"))
    sizes = m.groupBy("_g").agg(F.count("*").alias("_n"), F.min("left_ix").alias("_first"))
    best = sums.groupBy("_g").agg(F.min(F.struct("_s", "left_ix"))["left_ix"].alias("_best"))
    return sizes.join(best, "_g", "left").select(F.col("_g").alias(group), F.when(F.col("_n") < 3, F.col("_first")).otherwise(F.coalesce("_best", "_first")).alias("medoid"))
