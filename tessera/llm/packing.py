"""Best-fit packing: token sequences of fixed size from a configuration linear program.

1.  Texts become token ids, each followed by an end id; only longer ones are cut.
    One row a piece goes to the shared folder: place, length and a checksum.
2.  The histogram of piece lengths (at most ``capacity`` numbers, whatever the
    corpus) is the whole input of the linear program: a configuration is a
    multiset of lengths that fits a sequence, and every length must be covered.
    Multiplicative weights on the lengths, priced by a knapsack dynamic
    program, give fractional counts of configurations. They are scaled so that
    no length is used more often than it occurs and rounded down; what is left
    is placed by best fit, longest length first, with the same pricing.
3.  Each piece gets its rank among the pieces of its length (counted in hashed
    buckets, so a common length is no hot key), and the rank says which place
    of which sequence it takes.

Defined results: a null or empty text is one piece that holds the end id alone;
repeated rows are packed each for itself; an empty table gives no rows; columns
other than the id and the text are neither read nor returned.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import written
from ._text import Chunk, Spans, chunks, freed, hashes

CAPACITY = 1024
END_ID = 2
CACHE_ENTRIES = 600_000  # parts of words, about 30 MB with their ids, for as long as a task runs

CHUNK_BYTES = 500_000  # texts are encoded in chunks of so many bytes; a task holds some fifty times that beside its known parts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _white(data: np.ndarray) -> np.ndarray:
    """True for every byte of a white-space character of UTF-8 text."""
    white = _ASCII_WHITE[data]
    if len(data) > 1 and data.max() > 127:
        for mark in _WIDE_WHITE:
            n = len(mark)
            at = np.flatnonzero(data[: len(data) - n + 1] == mark[0])
            for k in range(1, n):
                at = at[data[at + k] == mark[k]]
            for k in range(n):
                white[at + k] = True
    return white


_ASCII_WHITE = np.zeros(256, dtype=bool)
_ASCII_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_WIDE_WHITE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WORD_BYTE = np.array([chr(i).isalnum() and i < 128 for i in range(256)])


def parts_of(chunk: Chunk) -> Spans:
    """Parts of texts whose ids, in a row, are those of the text.

    The tokenizer's splitting rule never joins what stands before a lone space
    or newline between two other characters to what follows; and a comma or full
    stop between a letter or number and such a place is a token run of its own.
    """
    data = chunk.data
    n = len(data)
    white = _white(data)
    cut = np.zeros(n + 1, dtype=bool)
    if n > 2:
        cut[1 : n - 1] = ((data[1:-1] == 32) | (data[1:-1] == 10)) & ~white[:-2] & ~white[2:]
    edge = np.zeros(n + 1, dtype=bool)
    edge[chunk.offsets] = True
    inner = np.zeros(n + 1, dtype=bool)  # the last byte of a text and its first one have no neighbour there
    inner[:n] = ~edge[:n] & ~edge[1:]
    cut &= inner
    letter = _WORD_BYTE[data]
    if n > 1:
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    mark = np.flatnonzero((data == 44) | (data == 46))
    mark = mark[(mark > 0) & ~edge[mark]]
    mark = mark[letter[mark - 1] & (cut[mark + 1] | edge[mark + 1])]
    cut[mark] = True
    cut |= edge
    full = np.flatnonzero(np.diff(chunk.offsets) > 0)
    starts = np.flatnonzero(cut[:n])
    ends = np.append(starts[1:], n) if len(starts) else starts
    return Spans(starts, ends, np.searchsorted(starts, chunk.offsets)) if len(full) else Spans(starts, ends, np.zeros(len(chunk.offsets), dtype=np.int64))


def same_by_ranks(path: str, tokenizer):  # noqa: ANN201
    """An encoder of the same byte-level vocabulary by ranks, which is several times faster; None where the file asks for more than that."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if model.get("type") != "BPE" or spec.get("normalizer") or not level:
        return None
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others have letters from 256 on
    letter = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    added = {t["content"] for t in spec.get("added_tokens", ())}
    ranks = {bytes(letter[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    probe = ["Hello, world's  end.\n\n 12345 übergröße – “q”\t日本語 \U0001f600 a", " the of\n and", "x" * 40]
    return fast if all(fast.encode_ordinary(t) == tokenizer.encode(t, add_special_tokens=False).ids for t in probe) else None


class Encoder:
    """Token ids of whole texts, as the tokenizer gives them.

    The different parts of a chunk of texts are found by their hashes and encoded
    once; those that were met before are known, and forgotten when they are many.
    """

    _loaded: dict[str, tuple] = {}  # of a fixed size for each file

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path not in self._loaded:
            tokenizer = Tokenizer.from_file(path)
            added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
            fast = same_by_ranks(path, tokenizer)
            size = np.array([len(fast.decode_single_token_bytes(i)) if i not in tokenizer.get_added_tokens_decoder() else 0 for i in range(fast.n_vocab)]) if fast else None
            self._loaded[path] = tokenizer, fast, size, re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.tokenizer, self.fast, self.size, self.added = self._loaded[path]
        self.forget()

    def forget(self) -> None:
        """Known parts: their hashes in order, where their ids begin in ``ids``, and how many they are."""
        self.keys, self.starts, self.sizes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _one(self, part: str) -> list[int]:
        return self.tokenizer.encode(part, add_special_tokens=False).ids if self.fast is None or self.added.search(part) else self.fast.encode_ordinary(part)

    def _new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts in a row, and how many each has. Parts that may stand behind each other (not ``alone``) are encoded as one text."""
        size = ends - starts
        row = np.flatnonzero(~alone)
        n = size[row]
        at = np.repeat(starts[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        text = data[at].tobytes().decode()
        count = np.zeros(len(starts), dtype=np.int64)
        if self.fast is None or self.added.search(text):
            alone, row, joined = np.ones(len(starts), dtype=bool), row[:0], np.zeros(0, "<u4")
        else:
            joined = np.array(self.fast.encode_ordinary(text), dtype="<u4")
            count[row] = np.diff(np.searchsorted(np.cumsum(self.size[joined]), np.cumsum(n), side="right"), prepend=0)
        single = np.flatnonzero(alone)
        raw = [self._one(data[a:b].tobytes().decode()) for a, b in zip(starts[single].tolist(), ends[single].tolist(), strict=True)]
        count[single] = [len(x) for x in raw]
        first = np.cumsum(count) - count
        ids = np.zeros(int(count.sum()), dtype="<u4")
        for where, values in ((row, joined), (single, np.fromiter(itertools.chain.from_iterable(raw), dtype="<u4"))):
            n = count[where]
            ids[np.repeat(first[where] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = values
        return ids, count

    def _learn(self, chunk: Chunk, parts: Spans, first: np.ndarray, codes: np.ndarray) -> None:
        """Has the parts with these hashes among the known ones."""
        at = np.searchsorted(self.keys, codes)
        new = np.ones(len(codes), dtype=bool)
        ok = at < len(self.keys)
        new[ok] = self.keys[at[ok]] != codes[ok]
        if len(self.keys) + int(new.sum()) > CACHE_ENTRIES or len(self.ids) > 8 * CACHE_ENTRIES:
            self.forget()
            new[:] = True
        if not new.any():
            return
        starts, ends = parts.starts[first[new]], parts.ends[first[new]]
        white = _white(chunk.data)
        lone = (chunk.data[starts] == 32) | (chunk.data[starts] == 10)
        plain = lone & (ends - starts > 1) & ~white[np.minimum(starts + 1, len(white) - 1)] & ~white[ends - 1]
        ids, count = self._new(chunk.data, starts, ends, ~plain)
        keys = np.concatenate([self.keys, codes[new]])
        order = np.argsort(keys, kind="stable")
        begin = np.concatenate([self.starts, len(self.ids) + np.cumsum(count) - count])
        self.keys, self.starts, self.sizes = keys[order], begin[order], np.concatenate([self.sizes, count])[order]
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn."""
        for chunk in chunks(texts, CHUNK_BYTES):
            parts = parts_of(chunk)
            if not len(parts):
                yield from [np.zeros(0, dtype="<u4")] * chunk.n
                continue
            codes, first, which = np.unique(hashes(chunk, parts), return_index=True, return_inverse=True)
            self._learn(chunk, parts, first, codes)
            known = np.searchsorted(self.keys, codes)[which]
            size = self.sizes[known]
            ends = np.cumsum(size)
            ids = self.ids[np.repeat(self.starts[known] - (ends - size), size) + np.arange(ends[-1])]
            bounds = np.concatenate([[0], ends])[parts.bounds].tolist()
            yield from (ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False))


def pieces_of(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, checksum) of each piece; all but the first are full."""
    n = len(ids) // 4
    count = -(-n // capacity)
    first = n - capacity * (count - 1)
    cuts = [0, *range(first, n + 1, capacity)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each text."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)  # for this task alone: a worker that is used again holds nothing of it
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                for k, piece in enumerate(pieces_of(ids.tobytes() + end, capacity)):
                    for column, value in zip(columns, (doc_id, k, *piece), strict=True):
                        column.append(value)
            names = [f.split()[0] for f in PIECES.split(", ")]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col]).mapInArrow(freed(run), PIECES)


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the most value that fits c tokens, any number of each length; took[c]: one length of such a choice, 0 where a token stays free.

    value[l] is that of length l, 0 for lengths not on offer.
    """
    worth = np.where(value > 0, value, -np.inf)
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        n = min(c, len(worth) - 1)
        total = best[c - n : c][::-1] + worth[1 : n + 1]
        j = int(total.argmax()) if n else 0
        if n and total[j] >= best[c - 1]:
            best[c], took[c] = total[j], j + 1
        else:
            best[c] = best[c - 1]
    return best, took


def traced(took: np.ndarray, capacity: int) -> dict[int, int]:
    """The choice behind best[capacity]: how many of each length."""
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        k = int(took[c])
        if k:
            out[k] = out.get(k, 0) + 1
        c -= k or 1
    return out


def best_configuration(value: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths of most value that fits."""
    return traced(knapsack(value, capacity)[1], capacity)


@dataclass
class Plan:
    """Which lengths the sequences hold: (lengths in order, how many sequences)."""

    capacity: int
    chosen: list[tuple[tuple[int, ...], int]] = field(default_factory=list)
    by_program: int = 0  #: pieces that the rounded linear program places

    @property
    def n_sequences(self) -> int:
        return sum(n for _, n in self.chosen)

    def places(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length: first rank of each run of ranks, the sequence of that rank, the offset in it."""
        runs: dict[int, list[tuple[int, int, int]]] = {}
        used: dict[int, int] = {}
        base = 0
        for lengths, n in self.chosen:
            offset = 0
            for length in lengths:
                first = used.get(length, 0)
                runs.setdefault(length, []).append((first, base, offset))
                used[length] = first + n
                offset += length
            base += n
        return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


@dataclass
class Fractional:
    """A fractional cover of all lengths, and what no cover can do without."""

    counts: dict[tuple, float]
    lower: float  #: bound on the number of sequences, by the best prices found

    @property
    def total(self) -> float:
        return sum(self.counts.values())


def fractional(demand: np.ndarray, capacity: int, gap: float = 0.002, most: int = 400, step: float = 0.05, sharp: float = 2.0) -> Fractional:
    """The configuration linear program by multiplicative weights.

    A length's price falls exponentially with the share of its demand that is
    covered. Each round prices all lengths and runs one knapsack, which tells for
    every length the best configuration that holds it; those within ``step`` of the
    best one are taken, a little each, and no length grows by more than ``step`` in
    a round. Any prices bound the optimum from below: the worth of the demand over
    that of the best configuration. It ends when cover and bound are within ``gap``.
    """
    on = np.flatnonzero(demand)
    size = np.arange(len(demand), dtype=float)
    covered = np.zeros(len(demand))
    counts: dict[tuple, float] = {}
    rng = np.random.default_rng(0)
    total, lower = 0.0, float(demand @ size) / capacity  # sizes are prices, too
    for _ in range(most):
        price = np.zeros(len(demand))
        price[on] = size[on] * np.exp(-sharp * (covered[on] - covered[on].min())) * (1 + 1e-4 * rng.random(len(on)))  # ties fall anew in each round
        best, took = knapsack(price, capacity)
        lower = max(lower, float(demand @ price) / best[capacity])
        room = np.full(len(demand), step)
        for k in on[np.argsort(covered[on], kind="stable")].tolist():
            if price[k] + best[capacity - k] < (1 - step) * best[capacity]:
                continue
            config = traced(took, capacity - k)
            config[k] = config.get(k, 0) + 1
            amount = min(room[l] * demand[l] / n for l, n in config.items())
            if amount <= 0:
                continue
            key = tuple(sorted(config.items(), reverse=True))
            counts[key] = counts.get(key, 0.0) + amount
            total += amount
            for l, n in key:
                room[l] -= amount * n / demand[l]
                covered[l] += amount * n / demand[l]
        if (least := covered[on].min()) > 0 and total / least <= (1 + gap) * lower:
            break
    least = covered[on].min()
    return Fractional({k: n / least for k, n in counts.items()} if least > 0 else {}, lower)


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """histogram[l]: how many pieces have length l. The work depends on the capacity, not on the counts.

    The rounded linear program with best fit for the rest, or best fit alone where that needs fewer sequences.
    """
    rounded, greedy = (_planned(histogram, capacity, solve) for solve in (True, False))
    return rounded if rounded.n_sequences <= greedy.n_sequences else greedy


def _planned(histogram: np.ndarray, capacity: int, solve: bool) -> Plan:
    left = histogram.astype(np.int64).copy()
    out = Plan(capacity)
    if left[capacity]:
        out.chosen.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    if solve and left.any():
        x = fractional(left, capacity)
        for key, n in sorted(x.counts.items(), key=lambda kv: -kv[1]):  # rounded down, and to what the larger ones leave
            whole = min(int(n), *(int(left[k] // m) for k, m in key))
            if whole > 0:
                out.chosen.append((tuple(k for k, m in key for _ in range(m)), whole))
                out.by_program += whole * sum(m for _, m in key)
                for k, m in key:
                    left[k] -= whole * m
    size = np.arange(capacity + 1, dtype=float)
    while left.any():  # best fit: the longest piece, and with it what fills the rest best; each step uses up at least one length
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        room = capacity - longest
        config = best_configuration(np.where(left[: room + 1] > 0, size[: room + 1] * (1 + 1e-7 * size[: room + 1]), 0.0), room) if room else {}
        config = {k: min(m, int(left[k])) for k, m in config.items()}
        left[longest] += 1
        config[longest] = config.get(longest, 0) + 1
        while (room := capacity - sum(k * m for k, m in config.items())) > 0:  # where fewer of a length are left than was best
            spare = [k for k in np.flatnonzero(left[: room + 1]).tolist() if left[k] > config.get(k, 0)]
            if not spare:
                break
            config[spare[-1]] = config.get(spare[-1], 0) + 1
        whole = min(int(left[k]) // m for k, m in config.items())
        out.chosen.append((tuple(k for k, m in config.items() for _ in range(m)), whole))
        for k, m in config.items():
            left[k] -= whole * m
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    pieces = written(token_pieces(docs, path or tokenizer_path(), capacity, end_id), "pieces")
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = written(pieces.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[length] = n
    places = plan(histogram, capacity).places()

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    counts = counts.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    own = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(own)).join(counts, ["bucket", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("below") + F.col("rank") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for k in np.unique(length):
                first, base, at = places[int(k)]
                mine = np.flatnonzero(length == k)
                j = np.searchsorted(first, rank[mine], side="right") - 1
                sequence[mine], offset[mine] = base[j] + rank[mine] - first[j], at[j]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
