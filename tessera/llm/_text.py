"""Vectorised text primitives shared by the operators of this subpackage.

Texts reach Python as Arrow batches.  Everything here works on the raw UTF-8
bytes of many texts at once: word boundaries, word hashes and n-gram hashes are
numpy passes over one byte buffer, so no Python object is made per word.

A batch is cut into chunks of about ``CHUNK_BYTES`` (one text is never cut), so
the working memory is bounded by the larger of that and the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2_000_000

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD1B54A32D192ED03))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse modulo 2**64, n + 1 of each."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, min(2 * len(_POWERS.get("up", ())), CHUNK_BYTES + 1), 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    up, down = _POWERS["up"], _POWERS["down"]
    if len(up) > 4 * CHUNK_BYTES:  # one huge text must not hold its table for ever
        _POWERS.clear()
    return up, down


def forget() -> None:
    """Frees the tables of powers, so that a Python worker that waits for its next task holds none."""
    _POWERS.clear()


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def freed(run: Run) -> Run:
    """``run``, after which the Python worker waits for its next task without tables or unused memory of Arrow and the C library."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return out


def byte_table(separators: bytes) -> np.ndarray:
    """True for each byte value that belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(separators, dtype=np.uint8)] = False
    return table


#: Words `[^\x20\x09-\x0D]+`.
SPACED = byte_table(b" \t\n\x0b\x0c\r")
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing.
ALNUM = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
ALNUM[ord("A") : ord("Z") + 1] = False


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


@dataclass
class Chunk:
    """Some whole texts: their bytes, and where each begins and ends."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> Chunk:
        return Chunk(self.first, _lower()[self.data], self.offsets)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of an Arrow array, in order, in chunks of bounded size. A null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), len(texts))
        yield Chunk(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


@dataclass
class Spans:
    """Byte spans inside a chunk, in order; ``bounds[i]:bounds[i + 1]`` are those of text i."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def runs(chunk: Chunk, inside: np.ndarray) -> Spans:
    """Maximal runs of bytes for which ``inside`` holds; a run ends where its text does."""
    begin, end = inside.copy(), inside.copy()
    if len(inside):
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = chunk.offsets[:-1][np.diff(chunk.offsets) > 0]
        begin[edges] = inside[edges]
        edges = chunk.offsets[1:][np.diff(chunk.offsets) > 0] - 1
        end[edges] = inside[edges]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Spans(starts, ends, np.searchsorted(starts, chunk.offsets))


def words(chunk: Chunk, table: np.ndarray = SPACED) -> Spans:
    return runs(chunk, table[chunk.data])


def split_lines(chunk: Chunk) -> Spans:
    """The parts of every text between its newlines. A text has one line more than newlines."""
    breaks = np.flatnonzero(chunk.data == 10)
    starts = np.sort(np.concatenate([chunk.offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([chunk.offsets[1:], breaks]), kind="stable")
    counts = np.searchsorted(breaks, chunk.offsets[1:]) - np.searchsorted(breaks, chunk.offsets[:-1]) + 1
    return Spans(starts, ends, np.concatenate([[0], np.cumsum(counts)]))


def hashes(chunk: Chunk, spans: Spans) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from prefix sums of a rolling polynomial."""
    up, down = _powers(len(chunk.data))
    total = np.zeros(len(chunk.data) + 1, dtype=np.uint64)
    np.cumsum(_byte_codes()[chunk.data] * up[: len(chunk.data)], out=total[1:])
    return mix((total[spans.ends] - total[spans.starts]) * down[spans.starts])


def rolled(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive codes, first to last; the caller minds text bounds."""
    if len(codes) < n:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(len(codes))
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    k = len(codes) - n + 1
    return mix((total[n:] - total[:k]) * down[:k] + U64(n))


def windows(bounds: np.ndarray, n: int) -> np.ndarray:
    """Starts of the n-item windows that lie within one text."""
    size = np.diff(bounds)
    ok = np.ones(int(bounds[-1]), dtype=bool)
    for k in range(1, n):
        last = bounds[1:] - k
        ok[last[size >= k]] = False
    return np.flatnonzero(ok)


def repeated(keys: np.ndarray) -> np.ndarray:
    """True for every key that occurs twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), dtype=bool)
    ordered = np.sort(keys)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(again, keys), len(again) - 1)
    return again[at] == keys


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """True for each of ``size`` items that lies in one of the windows of n items."""
    step = np.zeros(size + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step[:-1]) > 0


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def salted(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Codes that can be equal only within one text."""
    return mix(codes + (owner.astype(np.uint64) + U64(1)) * U64(0xA24BAED4963EE407))
