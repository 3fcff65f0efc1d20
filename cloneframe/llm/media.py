"""Media columns: audio features of samples stored losslessly (free style: NumPy inside Arrow tasks).

``store`` writes a payload as an 8-bit mono WAV file image, ``load`` reads it back
chunk by chunk. ``media_features`` resamples what it reads back by a polyphase filter, makes overlapped log-mel
frames, and segments by energy with hysteresis: a segment opens above the high mark and
closes below the low one. It gives one row per block of frames: a fixed-shape tensor (``FRAMES`` x ``MELS``, row-major; an Arrow
fixed-shape tensor array inside the task, ``as_tensors`` makes one of such a column again) with its time span, and with a document's first
block the stored image and the segments' time spans. ``media_digest`` gives one row per document, from those rows alone.

Both are narrow maps in one stage, without shuffle. A payload is worked through in pieces of ``PIECE`` samples, so that beside
the payload itself a task holds a bounded block of frames; samples before and after a
piece that its first and last frames need are read with it, so results do not depend on
the piece's size. Rows leave in batches of about ``ROWS`` blocks. The digest adds up blocks as they come, in the order in which the features were made.

Defined results: null and empty texts give one pad block of 192 spaces. A constant
payload is silence: no segments. Very long texts are more blocks. Equal payloads give equal features, so no ties arise. Null ids are
carried through, repeated rows repeat, and only the id and text columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples a second as stored, and the ratio to the analysed rate (16 kHz -> 8 kHz).
RATE, UP, DOWN = 16_000, 1, 2
#: Analysis at the resampled rate: frame, step (frames overlap), mel bands, frames of a tensor.
FRAME, HOP, MELS, FRAMES = 256, 128, 24, 64
#: Frames worked on at once.
PIECE = 4096
#: Blocks of a batch, about.
ROWS = 512
#: Energy marks over the document's floor, in dB, and the least frames of a segment.
HIGH_DB, LOW_DB, LEAST = 6.0, 3.0, 2
PAD, BLOCK = 32, 192


def store(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF/WAVE image: PCM, one channel, unsigned 8-bit samples."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + (n & 1), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + payload + b"\0" * (n & 1)


def load(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of a stored image; ValueError for anything but 8-bit mono PCM."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE image")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is stored")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), bytes([PAD]))


@lru_cache(8)
def filter_bank(up: int, down: int, half: int = 8) -> np.ndarray:
    """The ``up`` phases of a windowed-sinc low-pass: phase p holds taps p, p + up, ..."""
    widest = max(up, down)
    n = 2 * half * widest
    t = np.arange(n) - (n - 1) / 2
    taps = np.sinc(t / widest) * np.hamming(n)
    taps *= up / taps.sum()
    taps = np.pad(taps, (0, -n % up))
    return np.ascontiguousarray(taps.reshape(-1, up).T.astype(np.float32))


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling by up/down: output k uses phase (k * down) % up, and no sample between inputs is ever made."""
    bank = filter_bank(up, down)
    taps = bank.shape[1]
    n_out = -(-len(x) * up // down)
    padded = np.pad(x.astype(np.float32), (taps // 2, taps))
    out = np.empty(n_out, np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    for first in range(min(up, n_out)):
        k = np.arange(first, n_out, up)
        pick = windows[(first * down) // up :: down][: len(k)]
        out[first::up] = pick @ bank[(first * down) % up][::-1]
    return out


@lru_cache(4)
def mel_bank(rate: int, size: int = FRAME, bands: int = MELS) -> np.ndarray:
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1) * size / rate
    k = np.arange(size // 2 + 1)[:, None]
    rising = (k - edges[:-2]) / (edges[1:-1] - edges[:-2])
    falling = (edges[2:] - k) / (edges[2:] - edges[1:-1])
    bank = np.maximum(0, np.minimum(rising, falling))
    bank[np.rint(edges[1:-1]).astype(int), np.arange(bands)] += 1e-3  # no band is empty
    return bank.astype(np.float32)


@lru_cache(1)
def window() -> np.ndarray:
    return np.hanning(FRAME + 1)[:-1].astype(np.float32)


def frames_of(payload: bytes, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel frames, energy in dB per frame), worked through in pieces."""
    n = -(-len(payload) * UP // DOWN)
    count = max(1, -(-(n - FRAME) // HOP) + 1)
    new_rate, margin = rate * UP // DOWN, 64 * DOWN
    mels, energy = [], []
    for first in range(0, count, PIECE):
        last = min(count, first + PIECE)
        a, b = first * HOP, (last - 1) * HOP + FRAME
        lo = max(0, (a * DOWN // UP - margin) // DOWN * DOWN)
        raw = np.frombuffer(payload, np.uint8)[lo : b * DOWN // UP + margin].astype(np.float32)
        y = resample((raw - 128) / 128)[a - lo * UP // DOWN :][: b - a]
        y = np.pad(y, (0, b - a - len(y)))
        y = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] 
        y = (y - y.mean(1, keepdims=True)) * window()
        spectrum = np.fft.rfft(y, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels.append(np.log(power @ mel_bank(new_rate) + 1e-6).astype(np.float32))
        energy.append(10 * np.log10(power.sum(1) + 1e-6))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, end frame) of stretches that open above the high mark and last until the level falls below the low one."""
    floor = np.percentile(energy, 10)
    above, below = energy > floor + HIGH_DB, energy < floor + LOW_DB
    # The state after each frame is that of the latest frame which decides it.
    decided = np.flatnonzero(above | below)
    if not len(decided):
        return []
    state = np.zeros(len(energy), np.int8)
    at = np.searchsorted(decided, np.arange(len(energy)), "right") - 1
    state[at >= 0] = above[decided[at[at >= 0]]]
    edge = np.diff(np.r_[0, state, 0])
    return [(a, b) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()) if b - a >= LEAST]


def span_ms(a: int, b: int, rate: int) -> tuple[int, int]:
    """Frames a to b as milliseconds of the stored samples."""
    scale = 1000 * DOWN / (UP * rate)
    return round(a * HOP * scale), round(((b - 1) * HOP + FRAME) * scale)


def blocks_of(text: str | None) -> dict[str, list]:
    """The columns of one document's rows; ``logmel`` is one array of blocks x FRAMES x MELS."""
    media = store(payload_of(text))
    payload, rate = load(media)
    mels, energy = frames_of(payload, rate)
    n = -(-len(mels) // FRAMES)
    tensors = np.zeros((n, FRAMES, MELS), np.float32)
    tensors.reshape(-1, MELS)[: len(mels)] = mels
    firsts = range(0, len(mels), FRAMES)
    spans = [span_ms(a, min(len(mels), a + FRAMES), rate) for a in firsts]
    segs = [dict(zip(("start_ms", "end_ms"), span_ms(a, b, rate))) for a, b in segments(energy)]
    only_first = lambda v: [v] + [None] * (n - 1)
    return {
        "block": list(range(n)), "start_ms": [a for a, _ in spans], "end_ms": [b for _, b in spans], "n_frames": [min(FRAMES, len(mels) - a) for a in firsts],
        "logmel": tensors, "segments": only_first(segs), "media": only_first(media), "n_bytes": only_first(len((text or "").encode())),
    }


_SEGMENTS = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
_TENSOR = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])
_TYPES = {"block": pa.int32(), "start_ms": pa.int64(), "end_ms": pa.int64(), "n_frames": pa.int32(), "segments": _SEGMENTS, "media": pa.binary(), "n_bytes": pa.int64()}
_SCHEMA = (
    "block int, start_ms long, end_ms long, n_frames int, logmel array<float>, segments array<struct<start_ms:long,end_ms:long>>, media binary, n_bytes long"
)


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, block, start_ms, end_ms, n_frames, logmel array<float> of FRAMES x MELS, segments, media, n_bytes) per block of frames.

    The last block is filled up with zero frames; ``n_frames`` says how many are real. ``segments``, the
    stored image ``media`` and the text's bytes stand on block 0 and are null on the others.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, held, count = [], [], 0
            texts = batch.column(1).to_pylist()
            for row, text in enumerate(texts):
                held.append(blocks_of(text))
                rows += [row] * len(held[-1]["block"])
                if len(rows) < ROWS and row + 1 < len(texts):
                    continue
                flat = np.concatenate([h["logmel"] for h in held])
                tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(flat)
                for at in range(0, len(rows), ROWS):  # a very long text alone is many batches
                    take = slice(at, at + ROWS)
                    cols = {n: pa.array([v for h in held for v in h[n]][take], t) for n, t in _TYPES.items()}
                    # Spark knows tensors as lists of equal length.
                    cols["logmel"] = tensors[take].storage.cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[take])), *(cols[n] for n in _NAMES)], names=[id_col, *_NAMES])
                rows, held = [], []

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, {_SCHEMA}")


_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def as_tensors(column: pa.Array) -> pa.FixedShapeTensorArray:
    """An Arrow fixed-shape tensor array of a ``logmel`` column, for writers that keep extension types."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = pa.FixedSizeListArray.from_arrays(column.flatten().cast(pa.float32()), FRAMES * MELS)
    return pa.ExtensionArray.from_storage(_TENSOR, flat)


class Digest:
    """One document's figures, added up over its blocks in order."""

    def __init__(self, media: bytes, segs: list[dict], n_bytes: int):
        payload, _ = load(media)
        self.figures = (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
        self.segments, self.in_ms = len(segs), sum(s["end_ms"] - s["start_ms"] for s in segs)
        self.frames, self.end_ms, self.total = 0, 0, np.zeros(MELS)

    def add(self, tensor: np.ndarray, n_frames: int, end_ms: int) -> None:
        self.frames += n_frames
        self.end_ms = end_ms
        self.total += tensor[:n_frames].sum(0, dtype=np.float64)

    def feature(self) -> str:
        """frames|ms|segments|total ms in segments|mean log-mel of each band, two decimals."""
        mean = ",".join(f"{v:.2f}" for v in np.round(self.total / self.frames, 2) + 0.0)
        return f"{self.frames}|{self.end_ms}|{self.segments}|{self.in_ms}|{mean}"


_DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of ``media_features``, whose blocks must stand together and in order, as that operator leaves them."""
    kind = blocks.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in _DIGEST.split(", ")]

    def run(batches):
        type_of, last = None, None  # last: (id, Digest) of the document that may go on in the next batch

        def rows(done):
            cols = list(zip(*((*d.figures, d.feature()) for _, d in done)))
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in done], type_of), *map(pa.array, cols)], names=[id_col, *names])

        for batch in batches:
            type_of, done = batch.column(0).type, []
            get = {n: batch.column(batch.schema.get_field_index(n)) for n in _NAMES}
            tensors = as_tensors(get["logmel"]).to_numpy_ndarray()
            ids, first = batch.column(0).to_pylist(), get["block"].to_pylist()
            frames, ends = get["n_frames"].to_pylist(), get["end_ms"].to_pylist()
            for k, tensor in enumerate(tensors):
                if first[k] == 0:
                    if last:
                        done.append(last)
                    last = ids[k], Digest(get["media"][k].as_py(), get["segments"][k].as_py(), get["n_bytes"][k].as_py())
                last[1].add(tensor, frames[k], ends[k])
            if done:
                yield rows(done)
        if last:
            yield rows([last])

    return blocks.mapInArrow(run, f"`{id_col}` {kind}, {_DIGEST}")


def media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: sizes, digests of the payload read back and of the stored form, features of its tensors and time spans as a string."""
    return digests(media_features(df, id_col, text_col), id_col)
