"""Best-fit packing of token sequences by a configuration linear program (free style).

1. ``pieces`` tokenizes each whole text in its task and cuts it into pieces of at most ``capacity`` ids.
2. The histogram of piece lengths, at most ``capacity`` rows whatever the input, goes to the driver.
3. ``solve`` works on that histogram: the configuration LP (fewest sequences whose
   configurations cover every length's count), begun with the plan of best-fit decreasing. Each round
   prices lengths, solves the knapsack by dynamic programming, reads from its table configurations around every length that are worth
   the most or nearly so, and solves the program over all configurations found so far by multiplicative weights: weights of
   lengths fall as they are covered, configurations grow by what they are worth. The weights' average is the next
   prices and gives the dual bound. The cheapest cover is rounded to whole sequences, again for what is left,
   and the last pieces are placed best-fit on the histogram's counts.
4. Every piece gets a rank among those of its length and takes the place of that rank
   in the plan. Ranks are made per (length, salt) by the row numbers that the piece table was written with, and salts are offset by
   their counts, so that one common length, even of a third of all rows and all of them equal, is spread over many tasks.

The plan is bounded by the number of lengths and rounds, not by the rows; it is broadcast.
The piece table (no ids unless asked for) is written to the shared folder, because the histogram and the
placement both read it.

Defined results: null and empty texts are one piece with the end id alone. Repeated rows
are packed as often as they stand; which of equal pieces takes which place is open. Null ids are carried through. Very long texts are many pieces. An empty table
gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import CACHE_WORDS, LETTERS, NUMBERS, PLAIN, SPACES, PairIndexBPE
from .bpe_codec import text_slices
from .frames import written

_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
#: Characters of text whose words a task holds at once (one longer text: that text): words take some fifteen times their text.
SLICE_CHARS = 3_000_000
#: Rounds of knapsack pricing at most, steps of multiplicative weights in each, and the gap between cost and bound at which they end.
ROUNDS, STEPS, GAP = 8, 600, 0.005
#: Fillings that are drawn, from within this share of the best worth; and the last sharpness of weights as times the first.
CHOICES, SPREAD, SHARPEST = 3, 0.02, 60.0
#: Rows of one (length, salt) group, about.
GROUP_ROWS = 50_000


class WordEncoder:
    """Ids of the lower-casing word vocabulary, as packed bytes per distinct word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.bpe, self.own, self.known = PairIndexBPE(path), Tokenizer.from_file(path), {}

    def words(self, text: str) -> list[str] | None:
        """None: the text holds something that only the library's own splitter knows."""
        if not text.isascii():
            if PLAIN.search(text):
                return None
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if "<|" in text and any(s in text for s in self.bpe.special):
            return None
        text = text.lower()
        # Composing and lower-casing can make letters beyond the classes.
        if not text.isascii() and PLAIN.search(text):
            return None
        return _WORDS.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        split = [self.words(t) for t in texts]
        missing = sorted({w for words in split if words for w in words if w not in known})
        for at, ids, offsets in self.bpe.blocks([w.encode() for w in missing]):
            packed, cuts = ids.astype("<u4").tobytes(), (4 * offsets).tolist()
            for k in range(len(cuts) - 1):
                known[missing[at + k]] = packed[cuts[k] : cuts[k + 1]]
        get = known.__getitem__
        return [
            np.array(self.own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if w is None else b"".join(map(get, w))
            for t, w in zip(texts, split)
        ]


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """One per Python worker."""
    return WordEncoder(path)


def pieces(
    df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every whole text."""
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for at, part in text_slices(batch.column(1), SLICE_CHARS):
                rows, which = [], []
                for k, ids in enumerate(enc.encode(part), at):
                    ids += end
                    for n, a in enumerate(range(0, len(ids), width)):
                        cut = ids[a : a + width]
                        which.append(k)
                        rows.append((n, a // 4, len(cut) // 4, zlib.crc32(cut), cut))
                cols = list(zip(*rows))
                out = [batch.column(0).take(pa.array(which)), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4])]
                if keep_ids:
                    out.append(pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in cols[4]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[w], take[w]: the most that lengths of sum at most w are worth, and the length to take at w (0: leave one place empty).

    ``price[l]`` is the worth of length l, -inf where there is none.
    """
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for w in range(1, capacity + 1):
        worth = best[w - 1 :: -1] + price[1 : w + 1]
        k = int(worth.argmax())
        if worth[k] > best[w - 1]:
            best[w], take[w] = worth[k], k + 1
        else:
            best[w] = best[w - 1]
    return best, take


def fill(best: np.ndarray, take: np.ndarray, price: np.ndarray, lengths: np.ndarray, capacity: int, spread: float, rng: np.random.Generator) -> list[tuple[int, ...]]:
    """For each length, a configuration that holds it and fills the rest with what is worth most, descending.

    The first ``CHOICES`` fillings are drawn among all that are within ``spread`` of the best, as at good prices many are equal and a cover needs all of
    them; the others follow the knapsack's table."""
    filled = np.maximum.accumulate(np.where(take > 0, np.arange(len(take)), 0))
    out, room, live = [[int(n)] for n in lengths], capacity - lengths, np.arange(len(lengths))
    size = np.sort(lengths)
    for step in range(capacity):
        if step < CHOICES and spread:
            live = live[room[live] >= size[0]]
            got = np.zeros(len(live), np.int64)
            for at in range(0, len(live), 256):
                left = room[live[at : at + 256], None] - size[None, :]
                worth = np.where(left >= 0, price[size][None, :] + best[np.maximum(left, 0)], -np.inf)
                got[at : at + 256] = size[(worth + spread * best[capacity] * rng.random(worth.shape, np.float32)).argmax(1)]
        else:
            room[live] = filled[room[live]]
            live = live[room[live] > 0]
            got = take[room[live]]
        if not len(live):
            break
        for i, n in zip(live.tolist(), got.tolist()):
            out[i].append(n)
        room[live] -= got
    return [tuple(sorted(c, reverse=True)) for c in out]


Plan = list[tuple[tuple[int, ...], int]]


class Cover:
    """The covering program over the configurations found so far, by multiplicative weights on both sides."""

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, capacity: int, start: Plan):
        self.demand = demand[lengths].astype(float)
        self.index = np.zeros(capacity + 1, np.int64)
        self.index[lengths] = np.arange(len(lengths))
        self.known: dict[tuple[int, ...], int] = {}
        self.row, self.column, self.count = (np.zeros(0, np.int64) for _ in range(3))
        self.x = np.zeros(0)
        self.add([config for config, _ in start])
        for config, n in start:
            self.x[self.known[config]] += n
        self.cost = float(self.x.sum())

    def add(self, configs: list[tuple[int, ...]]) -> None:
        new = [c for c in dict.fromkeys(configs) if c not in self.known]
        entries = [(int(self.index[n]), self.known.setdefault(c, len(self.known)), c.count(n)) for c in new for n in dict.fromkeys(c)]
        if entries:
            more = np.array(entries, np.int64).T
            self.row, self.column, self.count = (np.r_[old, col] for old, col in zip((self.row, self.column, self.count), more))
        self.x = np.r_[self.x, np.zeros(len(new))]

    def solve(self, steps: int) -> np.ndarray:
        """Lengths weigh by how little of their demand is covered, more sharply from step to step; configurations grow by what they are worth at
        these weights against the average and shrink if that is less. Keeps the best cover: of several scales, that which is cheapest with a sequence more for
        each piece that it lacks. Returns prices: the weights' average over the later steps, by piece."""
        m, n = len(self.demand), len(self.x)
        part = self.count / self.demand[self.row]
        x, prices = self.x + 0.05 * self.demand.sum() / n, np.zeros(m)
        for i in range(steps):
            covered = np.bincount(self.row, part * x[self.column], m)
            if i % 25 == 0:
                for share in (0.0, 0.02, 0.05, 0.1, 0.2, 0.3):
                    if (scale := float(np.quantile(covered, share))) > 0:
                        cost = x.sum() / scale + float((np.clip(1 - covered / scale, 0, None) * self.demand).sum())
                        if cost < self.cost:
                            self.cost, self.x = cost, x / scale
            sharp = np.log(m + 1) * SHARPEST ** (i / steps)
            z = covered / np.median(covered)
            weight = np.exp(-sharp * (z - z.min()))
            weight /= weight.sum()
            if 3 * i > steps:
                prices += weight
            worth = np.bincount(self.column, part * weight[self.row], n)
            x = x * np.exp(np.clip(worth * x.sum() / (worth @ x) - 1, -1, 1) * min(0.5, 6 / sharp))
        return prices / prices.sum() / self.demand


def program(demand: np.ndarray, capacity: int, start: Plan, rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], float, float]:
    """(configuration -> how many sequences, fractional; what they and a sequence for each piece that they lack cost; a bound below which no plan's sequences can be).

    ``demand[l]`` is how many pieces of length l there are; ``start`` is a cover to begin with. Each round prices the lengths, solves the knapsack at these prices, adds the configurations
    that it finds and solves the program over all of them, which gives new prices. Prices divided by the knapsack's best worth are a solution of the dual
    program, so the pieces' prices together are a bound; the greatest is returned. The first two rounds price by length and by piece. Ends when cost and bound are ``GAP`` apart.
    """
    lengths, rng = np.flatnonzero(demand)[::-1], np.random.default_rng(0)
    cover, bound = Cover(lengths, demand, capacity, start), 0.0
    prices = lengths / capacity
    draws = max(1, min(4, 3000 // len(lengths)))
    for k in range(rounds):
        price = np.full(capacity + 1, -np.inf)
        price[lengths] = np.ones(len(lengths)) if k == 1 else prices
        best, take = knapsack(price, capacity)
        bound = max(bound, float((demand[lengths] * price[lengths]).sum() / best[capacity]))
        for draw in range(draws + 1):
            cover.add(fill(best, take, price, lengths, capacity, SPREAD if draw else 0.0, rng))
        prices = cover.solve(STEPS)
        if cover.cost <= (1 + GAP) * bound:
            break
    return {c: float(cover.x[j]) for c, j in cover.known.items() if cover.x[j] > 1e-6}, cover.cost, bound


def _put(plan: Plan, left: np.ndarray, config: tuple[int, ...], n: int) -> None:
    """Adds ``config`` n times, or as often as the counts that are left allow."""
    counts: dict[int, int] = {}
    for length in config:
        counts[length] = counts.get(length, 0) + 1
    n = min(n, *(int(left[length]) // k for length, k in counts.items()))
    if n > 0:
        for length, k in counts.items():
            left[length] -= n * k
        plan.append((config, n))


def solve(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> tuple[Plan, dict[str, float]]:
    """([(configuration, how many sequences)] that hold every length as often as the histogram says, exactly; ``primal`` cost and dual ``bound`` of the program, the
    share of pieces that best-fit ``placed`` after rounding, and the share of sequences with configurations that pricing found, not best-fit: ``priced``).

    The program starts from best-fit's plan. Its solution is rounded along its order: each configuration gets what the running sum passes of whole numbers, as often as the counts
    allow; the program is solved anew for what is left, as long as half is placed; best-fit places the rest. If best-fit alone takes fewer sequences, its plan is taken.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    full: Plan = [((capacity,), int(left[capacity]))] if left[capacity] else []
    whole, pieces_ = float(left[capacity]), max(1, sum(histogram.values()))
    left[capacity] = 0
    if not left.any():
        return full, {"primal": whole, "bound": whole, "placed": 0.0, "priced": 0.0}
    alone, plan = best_fit(left, capacity), []
    used = lambda plan: sum(n for _, n in plan)
    chosen, primal, bound = program(left, capacity, alone, rounds)
    while left.any():
        before, passed = int(left.sum()), 0.5
        for config, x in sorted(chosen.items(), key=lambda c: (sum(c[0]), c[0]), reverse=True):
            n = int(passed + x) - int(passed)
            passed += x
            _put(plan, left, config, n)
        if 2 * int(left.sum()) > before:
            break
        if left.any():
            chosen, _, _ = program(left, capacity, best_fit(left, capacity), min(rounds, 3))
    placed = int(left.sum()) / pieces_
    plan += best_fit(left, capacity)
    if used(alone) < used(plan):
        plan, placed = alone, 1 - whole / pieces_
    known = {config for config, _ in alone}
    priced = sum(n for config, n in plan if config not in known) / used(plan)
    return full + plan, {"primal": whole + primal, "bound": whole + bound, "placed": placed, "priced": priced}


def best_fit(left: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing on counts: each step repeats one sequence as often as the counts allow, so it ends some length."""
    plan, left = [], left.copy()
    while len(lengths := np.flatnonzero(left)):
        counts: dict[int, int] = {}
        room, top = capacity, len(lengths)
        while top:
            top = int(np.searchsorted(lengths[:top], room, "right"))
            while top and counts.get(int(lengths[top - 1]), 0) >= left[lengths[top - 1]]:
                top -= 1
            if top:
                n = int(lengths[top - 1])
                counts[n] = counts.get(n, 0) + 1
                room -= n
        times = min(int(left[n]) // k for n, k in counts.items())
        for n, k in counts.items():
            left[n] -= times * k
        plan.append((tuple(n for n, k in counts.items() for _ in range(k)), times))
    return plan


def slots(plan: Plan) -> np.ndarray:
    """Rows (length, first rank, copies in a sequence, first sequence, offset of the first copy), by length and rank."""
    rows, used, sequence = [], {}, 0
    for config, times in plan:
        offset = 0
        for length in dict.fromkeys(config):
            k = config.count(length)
            rows.append((length, used.get(length, 0), k, sequence, offset))
            used[length] = used.get(length, 0) + k * times
            offset += k * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces with the columns ``length`` and ``_row``, a number of each row; reads it twice. ``_row`` goes."""
    spark = cut.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(solve(histogram, capacity)[0])
    shared = spark.sparkContext.broadcast(table)
    salts = max(64, -(-sum(histogram.values()) // GROUP_ROWS))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("length", "_salt").orderBy("_row")
    cut = cut.drop("_row")
    ranked = (
        salted.withColumn("_own", F.row_number().over(own))
        .join(firsts, ["length", "_salt"])
        .select(*cut.columns, (F.col("_first") + F.col("_own") - 1).alias("_rank"))
    )
    out = cut.columns

    def run(batches):
        plan = shared.value
        keys = (plan[:, 0] << 45) | plan[:, 1]
        for batch in batches:
            t = pa.Table.from_batches([batch])
            length, rank = (t.column(c).to_numpy() for c in ("length", "_rank"))
            row = plan[np.searchsorted(keys, (length << 45) | rank, "right") - 1]
            nth = rank - row[:, 1]
            t = t.select(out).append_column("sequence_id", pa.array(row[:, 3] + nth // row[:, 2]))
            t = t.append_column("offset", pa.array(row[:, 4] + nth % row[:, 2] * length))
            yield from t.to_batches()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields]
    return ranked.mapInArrow(run, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack(
    df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece of every text with its sequence and place: the pieces of a sequence fill it from 0 without gaps."""
    cut = pieces(df, path, capacity, end_id, keep_ids, id_col, text_col)
    return place(written(cut.withColumn("_row", F.monotonically_increasing_id())), capacity)
