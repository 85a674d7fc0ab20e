"""Words and shingles of Arrow string arrays as hashes, without a Python object for each word."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in runs of about so many bytes, a longer text alone.
RUN_BYTES = 1 << 19
_mixer = np.random.Generator(np.random.PCG64(20260101))
LETTER = _mixer.integers(0, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but the space, and 0x09 to 0x0D.
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[[32, *range(9, 14)]] = False
_powers: dict[str, np.ndarray] = {}


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def frugal(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`f` as a task whose worker gives memory back when it ends: workers live on between tasks, and with them what they hold."""

    def g(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return g


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i < n; runs of ordinary size share one table."""
    size = RUN_BYTES + 1 if n <= RUN_BYTES + 1 else n
    if len(_powers.get("up", ())) < n:
        back = np.uint64(pow(int(BASE), -1, 2**64))
        for name, b in (("up", BASE), ("down", back)):
            run = np.full(size, b, dtype=np.uint64)
            run[0] = 1
            made = np.multiply.accumulate(run)
            if size > RUN_BYTES + 1:
                return made if name == "up" else None, np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, back, dtype=np.uint64)]))
            _powers[name] = made
    return _powers["up"], _powers["down"]


def runs(texts: pa.Array, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes."""
    sizes = np.diff(bounds(texts))
    at = 0
    while at < len(sizes):
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, "right")))
        yield at, end
        at = end


def filled(texts: pa.Array) -> pa.Array:
    """Null texts as empty ones."""
    return (texts.cast(pa.string()) if texts.type != pa.string() else texts).fill_null("")


def bounds(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)


def chars(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of non-null texts, and where each text begins and ends."""
    at = bounds(texts)
    data = texts.buffers()[2]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray, in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of the first word of each text (one more at the end)."""
    inside = in_word[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < len(data))]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word: a polynomial over random values of its bytes, mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(LETTER[data] * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: the first row, all distinct shingles of each text, sorted, and where each text's begin (one more at the end).

    A text of fewer words than `width` has its whole sequence as one; without words, none.
    """
    texts = filled(texts)
    steps = [np.uint64(pow(int(STEP), k, 2**64)) for k in range(width)]
    for a, b in runs(texts):
        data, at = chars(texts.slice(a, b - a))
        starts, ends, first = word_spans(LOWER[data], at)
        words = word_hashes(LOWER[data], starts, ends)
        full = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for k in range(width):
            full += words[k : k + len(full)] * steps[k]
        full = mixed(full)
        sets, ends_at = [], [0]
        for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            n = j - i
            if n >= width:
                s = np.sort(full[i : j - width + 1])
                if len(s) > 1:
                    s = s[np.concatenate([[True], s[1:] != s[:-1]])]
                sets.append(s)
            elif n:
                whole = np.uint64(n)
                with np.errstate(over="ignore"):
                    for k in range(n):
                        whole = whole * STEP + words[i + k]
                sets.append(mixed(np.array([whole ^ np.uint64(0x5851F42D4C957F2D)], dtype=np.uint64)))
            ends_at.append(ends_at[-1] + (len(sets[-1]) if n else 0))
        yield a, np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.array(ends_at)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the parts of `values` between successive bounds; empty parts give 0."""
    total = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """One binary value for each part of `values` between successive bounds, little-endian."""
    if int(at[-1]) * values.dtype.itemsize >= 1 << 31:
        raise OverflowError("a packed batch must stay under 2 GiB")
    offsets = (at * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def unpacked(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column without nulls, and the bounds of its rows' parts."""
    if not len(column):
        return np.zeros(0, dtype), np.zeros(1, np.int64)
    width = np.dtype(dtype).itemsize
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, dtype), (at - at[0]) // width
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].copy().view(dtype), (at - at[0]) // width
