"""Vectorised text kernels over Arrow batches: words, word hashes, shingles.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, so words of UTF-8 text are cut without decoding.
Hashes are 64 bits: sums of random byte codes times powers of an odd base, finished by a bijective mixer.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_CODES = _CODES.copy()
_LOWER_CODES[65:91] = _CODES[97:123]
_COEFFICIENTS = [np.uint64(pow(_BASE, 2 * j + 3, 1 << 64)) for j in range(64)]
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release_memory() -> None:
    """Give freed memory back to the system, where its allocators can: a worker process outlives its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run):
    """run, with release_memory() when its task ends."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return whole


def bound_batches(spark: SparkSession) -> None:
    """Let the session send rows to Python in batches of BATCH_BYTES (one row may be longer); its own setting stays.

    Unset, a batch may hold 64 MB, in the executor's JVM and in its worker.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts hold at most limit bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and the offsets of each; null is empty."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (one more entry at the end)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:], after[-1], after[:-1] = True, space[:-1], True, space[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts], after[cuts - 1] = True, True
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; lower: A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER_CODES if lower else _CODES)[data] * up[:-1], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k words (64 at most) by its first word; the caller cuts at text ends."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    n, total = len(words) - k + 1, np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        total += words[j : j + n] * _COEFFICIENTS[j]
    return mix(total)


def shingle_sets(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of one text's k-word shingles; with fewer words, of the whole sequence."""
    if not len(words):
        return words
    if len(words) < k:
        words = np.concatenate([words, np.zeros(k - len(words), np.uint64)])
    runs = np.sort(run_hashes(words, k))
    return runs[np.concatenate([[True], runs[1:] != runs[:-1]])]
