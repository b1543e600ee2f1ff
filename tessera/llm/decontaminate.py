"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton accepts every run of consecutive words of any item. Training words
are streamed through it; at each word its state and depth give the longest run
of words, ending there, that some item holds. Depths of a window or more are
matches; short items match as wholes. Spans that exceed the limits are removed,
or documents whose share of matched words exceeds a limit.

Items are taken in shards of at most ``shard_words`` words, each with its own
automaton, so what is broadcast is bounded whatever the size of the benchmark;
figures of several shards are added up (items) or united (words). Words that no
item holds reset the automaton, so only runs of known words are streamed; the
known words are found for many texts at once with numpy.

Defined results: null and empty texts have no words, no hits and stay as they
are; items without words match nothing; repeated rows are judged each for
itself; an empty benchmark hits nothing; columns other than the id and the text
are not read, and the cleaning operator passes them on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as tx
from ._shared import written

WINDOW = 8
SHARD_WORDS = 200_000


class Automaton:
    """Generalised suffix automaton over word codes, with the items that hold each state's words."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.depth = [0]
        self.items: list[str] = []
        self.held: dict[int, list[int]] = {}  # items in which the window of this state occurs
        self.short: dict[int, list[tuple[int, int]]] = {}  # state: (words, item) of items shorter than a window
        self.shortest = window

    def _extend(self, last: int, code: int) -> int:
        step, link, depth = self.step, self.link, self.depth
        if code in step[last]:  # the generalised case: the run is known from an earlier item
            known = step[last][code]
            return known if depth[known] == depth[last] + 1 else self._clone(last, code, known)
        new = len(step)
        step.append({})
        link.append(0)
        depth.append(depth[last] + 1)
        p = last
        while p >= 0 and code not in step[p]:
            step[p][code] = new
            p = link[p]
        if p >= 0:
            known = step[p][code]
            link[new] = known if depth[known] == depth[p] + 1 else self._clone(p, code, known)
        return new

    def _clone(self, p: int, code: int, known: int) -> int:
        step, link = self.step, self.link
        copy = len(step)
        step.append(dict(step[known]))
        link.append(link[known])
        self.depth.append(self.depth[p] + 1)
        link[known] = copy
        while p >= 0 and step[p].get(code) == known:
            step[p][code] = copy
            p = link[p]
        return copy

    @classmethod
    def of(cls, items: list[tuple[str, list[int]]], window: int = WINDOW) -> Automaton:
        made = cls(window)
        items = [x for x in items if x[1]]
        for _, codes in items:
            state = 0
            for code in codes:
                state = made._extend(state, code)
        for number, (item_id, codes) in enumerate(items):  # no state splits any more: note where windows and short items end
            made.items.append(item_id)
            state = 0
            for at, code in enumerate(codes, 1):
                state = made.step[state][code]
                if at >= window:
                    held = made.held.setdefault(made.window_state(state), [])
                    if not held or held[-1] != number:
                        held.append(number)
            if len(codes) < window:
                made.short.setdefault(state, []).append((len(codes), number))
                made.shortest = min(made.shortest, len(codes))
        #: From each state the next one up its links that ends a short item, itself included.
        made.ends = [-1] * len(made.step)
        for s in sorted(range(1, len(made.step)), key=made.depth.__getitem__):
            made.ends[s] = s if s in made.short else made.ends[made.link[s]]
        return made

    def window_state(self, state: int) -> int:
        """The state of the last ``window`` words of a state that has so many: longer runs that end alike share it."""
        while self.depth[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stream(self, codes: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Matched spans (from, to) of a run of words, overlapping ones joined, and the numbers of the items met."""
        step, link, depth, window, held, ends, short = self.step, self.link, self.depth, self.window, self.held, self.ends, self.short
        state = length = 0
        spans: list[tuple[int, int]] = []
        met: set[int] = set()
        for at, code in enumerate(codes):
            while state and code not in step[state]:
                state = link[state]
                length = depth[state]
            if code in step[state]:
                state = step[state][code]
                length += 1
            else:
                length = 0
                continue
            longest = 0
            if length >= window:
                longest = length
                met.update(held[self.window_state(state)])
            e = ends[state]
            while e > 0:
                for n, item in short[e]:
                    if n <= length:
                        met.add(item)
                        longest = max(longest, n)
                e = ends[link[e]]
            if longest:
                begin = at + 1 - longest
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, at + 1))
        return spans, met


@dataclass
class Shard:
    """An automaton and the words it knows: sorted hashes; a word's code is its place among them."""

    known: np.ndarray
    automaton: Automaton


def item_words(texts: pa.Array) -> Iterator[np.ndarray]:
    """The hashed words of each text."""
    for chunk in tx.chunks(texts):
        chunk = chunk.lowered()
        spans = tx.words(chunk, tx.ALNUM)
        codes = tx.hashes(chunk, spans)
        for i in range(chunk.n):
            yield codes[spans.bounds[i] : spans.bounds[i + 1]]


def shard_of(items: list[tuple[str, np.ndarray]], window: int = WINDOW) -> Shard:
    known = np.unique(np.concatenate([c for _, c in items])) if items else np.zeros(0, dtype=np.uint64)
    return Shard(known, Automaton.of([(k, np.searchsorted(known, c).tolist()) for k, c in items], window))


def shards(benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, id_col: str = "item_id", text_col: str = "text") -> Iterator[Shard]:
    """Automata of the items, each of at most ``shard_words`` words (or of one longer item); items pass the driver one at a time."""
    block: list[tuple[str, np.ndarray]] = []
    size = 0
    rows = benchmark.select(F.coalesce(benchmark[id_col].cast("string"), F.lit("")).alias("k"), benchmark[text_col].alias("t")).distinct()
    for row in rows.toLocalIterator(prefetchPartitions=True):
        codes = next(item_words(pa.array([row.t], pa.string())))
        if block and size + len(codes) > shard_words:
            yield shard_of(block, window)
            block, size = [], 0
        block.append((str(row.k), codes))
        size += len(codes)
    yield shard_of(block, window)


def match(chunk: tx.Chunk, shard: Shard) -> tuple[tx.Spans, list[list[tuple[int, int]]], list[set[int]]]:
    """The words of a chunk; for each text its matched spans, counted in words of the chunk, and the items met."""
    lowered = chunk.lowered()
    spans = tx.words(lowered, tx.ALNUM)
    found: list[list[tuple[int, int]]] = [[] for _ in range(chunk.n)]
    met: list[set[int]] = [set() for _ in range(chunk.n)]
    if len(spans) and len(shard.known):
        codes = tx.hashes(lowered, spans)
        place = np.minimum(np.searchsorted(shard.known, codes), len(shard.known) - 1)
        known = shard.known[place] == codes
        owner = spans.owner()
        begin, end = known.copy(), known.copy()
        fresh = np.ones(len(owner), dtype=bool)
        fresh[1:] = owner[1:] != owner[:-1]
        begin[1:] &= ~known[:-1] | fresh[1:]
        end[:-1] &= ~known[1:] | fresh[1:]
        begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        long = ends - begins >= shard.automaton.shortest
        for a, b in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
            hits, items = shard.automaton.stream(place[a:b].tolist())
            if hits:
                doc = int(owner[a])
                found[doc] += [(a + x, a + y) for x, y in hits]
                met[doc] |= items
    return spans, found, met


Finish = Callable[[pa.RecordBatch, tx.Chunk, tx.Spans, np.ndarray, list[list[str]]], pa.RecordBatch]


def _through(docs: DataFrame, text_col: str, benchmark: DataFrame, window: int, shard_words: int, finish: Finish, schema: str | T.StructType) -> DataFrame:
    """Stream every text through every shard, then ``finish`` each chunk of rows with its hit words and items.

    With one shard this is one pass. With more, hit words (as bits) and items go
    to the shared folder between passes, so a worker holds one automaton at a time.
    """
    spark, at, width = docs.sparkSession, docs.columns.index(text_col), len(docs.columns)
    bits, names = "_hit" + "_" * width, "_items" + "_" * width
    between = T.StructType([*docs.schema.fields, T.StructField(bits, T.BinaryType()), T.StructField(names, T.ArrayType(T.StringType()))])

    def a_pass(sent, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard = sent.value
            for batch in batches:
                for chunk in tx.chunks(batch.column(at)):
                    part = batch.slice(chunk.first, chunk.n)
                    spans, found, met = match(chunk, shard)
                    hit = np.zeros(len(spans), dtype=bool)
                    items = [[shard.automaton.items[k] for k in m] for m in met]
                    if part.num_columns > width:
                        for i, (b, had) in enumerate(zip(part.column(width).to_pylist(), part.column(width + 1).to_pylist(), strict=True)):
                            x, y = spans.bounds[i], spans.bounds[i + 1]
                            hit[x:y] = np.unpackbits(np.frombuffer(b, np.uint8), count=y - x)
                            items[i] += had
                    for doc in found:
                        for x, y in doc:
                            hit[x:y] = True
                    own = part.select(list(range(width)))
                    if last:
                        yield finish(own, chunk, spans, hit, items)
                    else:
                        packed = [np.packbits(hit[spans.bounds[i] : spans.bounds[i + 1]]).tobytes() for i in range(chunk.n)]
                        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(packed, pa.binary()), pa.array(items, pa.list_(pa.string()))], [*own.schema.names, bits, names])

        return run

    ready = None
    for shard in shards(benchmark, window, shard_words):
        if ready is not None:
            docs = written(docs.mapInArrow(tx.freed(a_pass(ready, False)), between), "matched")
        ready = spark.sparkContext.broadcast(shard)
    return docs.mapInArrow(tx.freed(a_pass(ready, True)), schema)


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = 2, shard_words: int = SHARD_WORDS) -> DataFrame:
    """For every document how many words lie inside occurrences of item windows, and which items occur."""

    def finish(rows, chunk, spans, hit, items):
        items = [set(m) for m in items]  # texts of one id are one item
        count = np.array([len(m) for m in items])
        digests = [hashlib.sha256(",".join(sorted(m)).encode()).hexdigest() for m in items]
        columns = [rows.column(0), pa.array(np.diff(spans.bounds)), pa.array(tx.sums(hit.astype(np.int64), spans.bounds)), pa.array(count), pa.array(digests), pa.array(count >= min_items)]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in REPORT.split(", ")])

    return _through(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), "text", benchmark, window, shard_words, finish, REPORT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Documents without what they share with the benchmark.

    Matched spans go, with what stands between their words; a document of which
    more than ``max_coverage`` of the words matched goes as a whole. All other
    columns are passed on, and a text without matches is passed on as it is.
    """
    at = docs.columns.index("text")

    def finish(rows, chunk, spans, hit, items):
        share = tx.sums(hit.astype(np.int64), spans.bounds) / np.maximum(np.diff(spans.bounds), 1)
        if hit.any():
            texts = rows.column(at).to_pylist()
            for i in np.flatnonzero(share):
                a, b = spans.bounds[i], spans.bounds[i + 1]
                edge = np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8))
                parts, last = [], chunk.offsets[i]
                for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                    parts.append(chunk.data[last : spans.starts[a + x]].tobytes())
                    last = spans.ends[a + y - 1]
                parts.append(chunk.data[last : chunk.offsets[i + 1]].tobytes())
                texts[i] = b"".join(parts).decode()
            rows = rows.set_column(at, rows.schema.field(at), pa.array(texts, rows.schema.field(at).type))
        return rows.filter(pa.array(share <= max_coverage))

    return _through(docs, "text", benchmark, window, shard_words, finish, docs.schema)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op3_benchmark_decontamination": op3_benchmark_decontamination}
