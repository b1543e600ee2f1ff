"""N-gram Jaccard join: a size-aware heavy-light join of the shingle sets of all texts.

Two sets link when their Jaccard similarity reaches ``percent``. Written with the
sizes a, b and the number d of shingles in one set only, that is
``d * (100 + percent) <= (a + b) * (100 - percent)``, in whole numbers.

1.  Texts with equal sets are one class; its smallest id stands for it.
2.  Small sets (up to a boundary) enumerate their subsets of each size that a
    link with a possible partner must share; equal subsets meet under one key.
3.  Large sets go into inverted lists under the shingles of their prefix: all but
    as many shingles as a link must share, less one, in one order for all sets:
    rare ones first, by the count of their rarest word over all texts. A small set
    that may link with a large one goes there as well. The boundary is that of
    least cost by the sizes of all sets.
4.  Light lists give their pairs. A heavy list is scanned against its leader, the
    set in it that is in most heavy lists (of near copies one with few changes of
    its own, else these would be in all differences and the lists would not break
    up): each set becomes its difference D from the leader's. Sets
    that link with the leader are connected and need not meet. For any other
    pair at least one side, A, is not linked with the leader. If A links with B
    all the same, they have more than percent / (100 + percent) of B's difference
    in common, so the prefixes of their differences meet: a heavy list breaks up
    into lists under the shingles of the differences, which are light or are
    scanned in turn. No pair is lost, and none is made only because two texts
    share something common. Lists that do not get fewer this way (a large family of
    near copies that mostly do not link) are cut into blocks of like sizes, and all
    blocks that may hold links are held against each other, pair by pair.
5.  Pairs are checked against counts of shingles by bucket (no link can share
    more than the sum of the smaller counts), then against the sets: first one
    pair for each set, then those whose ends are not yet connected.

Defined results: null and empty texts, and texts without words, have the empty
set and link with nothing; rows with one id are one node of the graph; an empty
table gives no rows; extra columns are neither read nor returned.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as tx
from ._shared import written
from .components import components

#: Words are counted in 2**WORD_BITS buckets; the order of shingles uses the logarithms of these counts.
WORD_BITS = 22
LEAST_COUNT = 3
BUCKETS = 64
FULL = 255  #: a count in a byte; from here on it is no bound
MOST_SMALL = 29
#: Cost of what a set meets under one shingle of its prefix, in rows.
MET = 4
#: Ids, or sets of leaders, of so many bytes at most are sent to all executors; more are joined by a shuffle.
SENT_BYTES = 16 << 20
#: Texts are hashed in chunks of so many bytes (a task holds some forty times that), and sets are held against leaders by so many rows.
CHUNK_BYTES = 500_000
SCANNED = 1000
#: Sets in a block of a list that does not break up.
BLOCK = 128


@dataclass(frozen=True)
class Settings:
    words: int = 3
    percent: int = 90
    light: int = 96  #: lists of up to so many sets give their pairs

    def overlap(self, a: int, b: int) -> int:
        """Least number of common shingles of linked sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def prefix(self, n: int) -> int:
        return n + (-self.percent * n) // 100 + 1

    def linked(self, d, total):
        return d * (100 + self.percent) <= total * (100 - self.percent)


def sets(chunk: tx.Chunk, words: int, levels: np.ndarray | None = None) -> Iterator[np.ndarray | tuple[np.ndarray, np.ndarray]]:
    """The sorted distinct shingle hashes of each text of a chunk; with the level of each word bucket, also how common each shingle's words are."""
    lowered = chunk.lowered()
    spans = tx.words(lowered)
    codes = tx.hashes(lowered, spans)
    rolled = tx.rolled(codes, words)
    if levels is not None:
        level = levels[bucket_of(codes)].astype(np.int64)
        near = np.stack([level[k : len(level) - words + 1 + k] for k in range(words)]) if len(level) >= words else level[None, :0]
        common = (near.min(axis=0) << 16) + near.sum(axis=0)  # a shingle is no more common than its rarest word
    for a, b in itertools.pairwise(spans.bounds.tolist()):
        if b - a >= words:
            x, at = np.unique(rolled[a : b - words + 1], return_index=True) if levels is not None else (np.unique(rolled[a : b - words + 1]), None)
            yield x if levels is None else (x, common[a + at])
        else:
            x = tx.rolled(codes[a:b], b - a) if b > a else rolled[:0]
            yield x if levels is None else (x, np.zeros(len(x), dtype=np.int64))


def bucket_of(codes: np.ndarray) -> np.ndarray:
    return (codes >> tx.U64(64 - WORD_BITS)).astype(np.int64)


def word_codes(chunk: tx.Chunk) -> np.ndarray:
    lowered = chunk.lowered()
    return tx.hashes(lowered, tx.words(lowered))


def _prints(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set."""
    with np.errstate(over="ignore"):
        return int(tx.mix(s).sum(dtype=np.uint64).astype(np.int64)), int(tx.mix(s ^ tx.U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def packed(x: np.ndarray, common: np.ndarray) -> bytes:
    """48 bits of each hash, in order, above 16 that tell how common it is: two sets of thousands differ in what they share by chance less than once in ten million pairs."""
    rank = (np.minimum(common >> 16, 63) << 10) + np.minimum(common & 0xFFFF, 1023)
    return (x >> tx.U64(16) << tx.U64(16) | rank.astype(np.uint64)).astype("<u8").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def _rare_first(x: np.ndarray) -> np.ndarray:
    """Unpacked shingles, each turned so that its 16 bits lead, rare ones first: an order of all shingles, the same in every set."""
    return np.sort(x << tx.U64(48) | x >> tx.U64(16))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _spread(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else [], kind))


FIRST = "doc_id long, n long, f1 long, f2 long, bucket int, times long"


def first_pass(docs: DataFrame, s: Settings) -> DataFrame:
    """A row for each text with the size and the prints of its set; and a row for each bucket of words that a task met often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(1 << WORD_BITS, dtype=np.int32)
        names = [f.split()[0] for f in FIRST.split(", ")]
        for batch in batches:
            n, f1, f2 = [], [], []
            for chunk in tx.chunks(batch.column(1), CHUNK_BYTES):
                for x in sets(chunk, s.words):
                    a, b = _prints(x)
                    n.append(len(x))
                    f1.append(a)
                    f2.append(b)
                at, n_here = np.unique(bucket_of(word_codes(chunk)), return_counts=True)
                times[at] += n_here.astype(np.int32)
            none = pa.nulls(len(n), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), none, none.cast(pa.int64())], names)
        high = np.flatnonzero(times >= LEAST_COUNT)
        none = pa.nulls(len(high), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(high.astype(np.int32)), pa.array(times[high].astype(np.int64))], names)

    return written(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(tx.freed(run), FIRST), "prints")


def _subsets(x: np.ndarray, s: Settings, boundary: int) -> np.ndarray:
    """Hashes of the subsets that links with other small sets must share."""
    n = len(x)
    least, most = -(-s.percent * n // 100), min(boundary, 100 * n // s.percent)
    sizes = sorted({s.overlap(n, b) for b in range(max(1, least), most + 1)} & set(range(1, n + 1)))
    with np.errstate(over="ignore"):
        m = tx.mix(x)
        total = m.sum(dtype=np.uint64)
        out = []
        for c in sizes:
            left_out = n - c
            if not left_out:
                sums = np.array([total], dtype=np.uint64)
            elif left_out == 1:
                sums = total - m
            else:
                sums = np.array([total - m[list(k)].sum(dtype=np.uint64) for k in itertools.combinations(range(n), left_out)], dtype=np.uint64)
            out.append(tx.mix(sums + tx.U64(1 + c)))
        return np.unique(np.concatenate(out)) if out else x[:0]


def n_subsets(n: int, s: Settings, boundary: int) -> int:
    least, most = -(-s.percent * n // 100), min(boundary, 100 * n // s.percent)
    return sum(math.comb(n, c) for c in {s.overlap(n, b) for b in range(max(1, least), most + 1)} if c <= n)


def boundary_of(sizes: dict[int, int], s: Settings) -> int:
    """The largest size that is small, of least cost. sizes: how many sets have a size up to MOST_SMALL + 1.

    A small set costs a row for each subset; a large one a row for each shingle of
    its prefix, and the check of what it meets there (MET rows' worth each).
    """
    large = {n: k * s.prefix(n) * (1 + MET) for n, k in sizes.items()}

    def cost(x: int) -> float:
        crossing = -(-s.percent * (x + 1) // 100)
        return sum(k * n_subsets(n, s, x) + (large[n] if n >= crossing else 0) if n <= x else large[n] for n, k in sizes.items())

    return min(range(MOST_SMALL + 1), key=lambda x: (cost(x), x))


SIGNS = "doc_id long, n long, f1 long, f2 long, keys array<long>, counts binary"


def second_pass(docs: DataFrame, s: Settings, boundary: int, levels: np.ndarray) -> DataFrame:
    """The keys under which each text's set can meet others, and its counts of shingles by bucket."""
    crossing = -(-s.percent * (boundary + 1) // 100)
    sent = docs.sparkSession.sparkContext.broadcast(levels)  # 2**WORD_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tx.chunks(batch.column(1), CHUNK_BYTES):
                found = list(sets(chunk, s.words, sent.value))
                keys, counts, prints = [], [], []
                for x, common in found:
                    n = len(x)
                    parts = []
                    if n and n <= boundary:
                        parts.append(_subsets(x, s, boundary))
                    if n > boundary or (n and n >= crossing):
                        parts.append(x[np.lexsort((tx.mix(x), common))[: s.prefix(n)]])
                    keys.append(_signed(np.concatenate(parts)) if parts else np.zeros(0, np.int64))
                    counts.append(np.minimum(np.bincount((x & tx.U64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS), FULL).astype(np.uint8).tobytes())
                    prints.append(_prints(x))
                ids = batch.column(0).slice(chunk.first, chunk.n)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(x) for x, _ in found], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), _spread(keys, pa.int64()), pa.array(counts, pa.binary())],
                    [f.split()[0] for f in SIGNS.split(", ")],
                )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(tx.freed(run), SIGNS)


def sets_of(docs: DataFrame, needed: DataFrame, s: Settings, levels: np.ndarray, repeats: bool = False) -> DataFrame:
    """The sets of some documents: (node, x), x the sorted hashes, packed."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)
    base = docs.select(docs["doc_id"].cast("long").alias("node"), docs["text"].cast("string").alias("text"))
    few = needed.count() * 8 <= SENT_BYTES
    base = base.join(F.broadcast(needed) if few else needed, "node", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tx.chunks(batch.column(1), CHUNK_BYTES):
                x = [packed(x, common) for x, common in sets(chunk, s.words, sent.value)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n), pa.array(x, pa.binary())], ["node", "x"])

    out = base.mapInArrow(tx.freed(run), "node long, x binary")
    return written(out.dropDuplicates() if repeats else out, "sets")


def _lists(rows: DataFrame, levels: int, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Of rows (key, node, n, mask): the pairs of light lists, and heavy lists. Bit i of a mask: unlinked to the leader of level i."""
    full = (1 << levels) - 1
    stats = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_or("mask").alias("all"))
    rows = rows.join(stats.where((F.col("m") > 1) & (F.col("all") == full)), "key")
    light = rows.where(F.col("m") <= s.light).groupBy("key").agg(F.collect_list(F.struct("node", "n", "mask")).alias("l"))  # at most `light` long
    pairs = light.select("l", F.explode("l").alias("p")).select("p", F.explode(F.filter("l", lambda q: (q["node"] > F.col("p.node")) & (q["n"] * 100 >= F.col("p.n") * s.percent) & (F.col("p.n") * 100 >= q["n"] * s.percent) & (q["mask"].bitwiseOR(F.col("p.mask")) == full))).alias("q"))
    return pairs.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")), rows.where(F.col("m") > s.light).select("key", "node", "n", "mask")


def _led(heavy: DataFrame) -> DataFrame:
    """Heavy lists with their leader: the set that is in most heavy lists, of these the smallest id."""
    often = heavy.join(heavy.groupBy("node").agg((-F.count(F.lit(1))).alias("lists")), "node")
    heads = written(often.groupBy("key").agg(F.min(F.struct("lists", "node")).alias("head")).select("key", F.col("head.node").alias("leader")), "heads")
    return heavy.join(F.broadcast(heads) if heads.count() * 16 <= SENT_BYTES else heads, "key")


def _against_leader(heavy: DataFrame, found: DataFrame, level: int, s: Settings) -> DataFrame:
    """Scan heavy lists: a row (key, node, n, mask, linked, leader) for each new list that a set goes to, or one without a key.

    Lists of one leader are scanned as one: a pair that meets in several of them needs to meet once.
    """
    heavy = written(_led(heavy).groupBy("leader", "node", "n").agg(F.bit_or("mask").alias("mask")), "scan")
    leaders = found.join(heavy.select(F.col("leader").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("leader"), F.col("x").alias("y"))
    leaders = written(leaders, "leaders")
    few = (leaders.agg(F.sum(F.octet_length("y"))).first()[0] or 0) <= SENT_BYTES
    apart = heavy.join(found, "node").join(F.broadcast(leaders) if few else leaders, "leader").select("node", "leader", "n", "mask", "x", "y")
    bit = 1 << level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SCANNED) for b in batches for i in range(0, b.num_rows, SCANNED)):
            parts, links = [], []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                a, b = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                more, less = np.setdiff1d(a, b), np.setdiff1d(b, a)
                d = len(more) + len(less)
                linked = bool(s.linked(d, len(a) + len(b)))
                if linked:
                    keep = d - s.percent * d // (100 + s.percent)
                else:
                    keep = d + 1 - max(1, -(((100 - s.percent) * len(a) - s.percent * d) // s.percent))
                # own shingles, which few others have, before those of the leader that are missing; of each the rare ones first, or unrelated sets would meet under common ones, and their lists grow from level to level
                parts.append(_signed(np.concatenate([_rare_first(more), _rare_first(less)])[:keep]))
                links.append(linked)
            mask = batch.column(3).to_numpy(zero_copy_only=False)
            mask = np.where(links, mask, mask | bit).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(mask), _spread(parts, pa.int64()), pa.array(links, pa.bool_())], ["node", "leader", "n", "mask", "parts", "linked"])

    scanned = apart.mapInArrow(tx.freed(run), "node long, leader long, n long, mask int, parts array<long>, linked boolean")
    return written(scanned.select(F.explode_outer("parts").alias("part"), "node", "n", "mask", "linked", "leader").select(F.when(F.col("part").isNotNull(), F.xxhash64("leader", "part")).alias("key"), "node", "n", "mask", "linked", "leader"), "lists")


def _in_blocks(heavy: DataFrame, signs: DataFrame, levels: int, s: Settings) -> DataFrame:
    """All pairs of heavy lists that may link by their sizes and counts of shingles; lists of one leader are one."""
    full, growth = (1 << levels) - 1, math.log(100 / s.percent) if s.percent < 100 else 1.0
    sets_in = _led(heavy).groupBy("leader", "node", "n").agg(F.bit_or("mask").alias("mask"))
    sets_in = written(sets_in.withColumn("size", F.floor(F.log("n") / growth)).join(signs.select("node", "counts"), "node"), "groups")
    many = sets_in.groupBy("leader", "size").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    blocks = sets_in.join(many, ["leader", "size"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    blocks = written(blocks.groupBy("leader", "size", "block").agg(F.collect_list(F.struct("node", "n", "mask", "counts")).alias("l")), "blocks")  # about BLOCK sets long
    other = blocks.select("leader", F.col("size").alias("size_b"), F.col("block").alias("block_b"), F.col("l").alias("m"))
    # sets that link are in one class of sizes or in neighbouring ones; a second neighbour is for rounded logarithms
    met = blocks.join(other, "leader").where("size_b = size and block_b >= block or size_b between size + 1 and size + 2").withColumn("same", F.expr("size_b = size and block_b = block"))
    met = met.repartition("leader", "size", "block", "size_b", "block_b").select("l", "m", "same")

    def columns(found: pa.StructArray) -> tuple[np.ndarray, ...]:
        counts = np.frombuffer(b"".join(found.field("counts").to_pylist()), np.uint8).reshape(-1, BUCKETS)
        return *(found.field(k).to_numpy(zero_copy_only=False) for k in ("node", "n", "mask")), counts, (counts == FULL).any(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, same in zip(*batch.columns, strict=True):
                b, nb, mb, cb, open_b = columns(right.values)
                low, high = [b[:0]], [b[:0]]
                for a, na, ma, ca, open_a in zip(*columns(left.values), strict=True):
                    common = np.minimum(cb, ca).sum(axis=1, dtype=np.int64)
                    ok = (open_b | open_a | s.linked(na + nb - 2 * common, na + nb)) & (mb | ma == full) & (100 * na >= s.percent * nb) & (100 * nb >= s.percent * na)
                    partner = b[ok & (b > a)] if same.as_py() else b[ok]
                    low.append(np.minimum(partner, a))
                    high.append(np.maximum(partner, a))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(low), pa.int64()), pa.array(np.concatenate(high), pa.int64())], ["a", "b"])

    return written(met.mapInArrow(tx.freed(run), "a long, b long").distinct(), "met")


def _filtered(pairs: DataFrame, counts: DataFrame, s: Settings) -> DataFrame:
    """Pairs that may link by their counts of shingles in each bucket."""
    joined = pairs.join(counts.select(F.col("node").alias("a"), F.col("counts").alias("ca"), F.col("n").alias("na")), "a").join(counts.select(F.col("node").alias("b"), F.col("counts").alias("cb"), F.col("n").alias("nb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ca, cb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BUCKETS) for i in (2, 4))
            total = batch.column(3).to_numpy(zero_copy_only=False) + batch.column(5).to_numpy(zero_copy_only=False)
            common = np.minimum(ca, cb).astype(np.int64).sum(axis=1)
            open_end = (np.maximum(ca, cb) == FULL).any(axis=1)
            yield batch.select([0, 1]).filter(pa.array(open_end | s.linked(total - 2 * common, total)))

    return joined.select("a", "b", "ca", "na", "cb", "nb").mapInArrow(tx.freed(run), "a long, b long")


def _verified(pairs: DataFrame, found: DataFrame, s: Settings) -> DataFrame:
    """Pairs whose sets link."""
    joined = pairs.join(found.select(F.col("node").alias("a"), F.col("x")), "a").join(found.select(F.col("node").alias("b"), F.col("x").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                both = np.concatenate([unpacked(x.as_buffer()), unpacked(y.as_buffer())])
                both.sort()
                ok.append(bool(s.linked(len(both) - 2 * int((both[1:] == both[:-1]).sum()), len(both))))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return written(joined.mapInArrow(tx.freed(run), "a long, b long"), "linked")


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are not connected."""
    one = pairs.join(roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b", "left")
    return one.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def join(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) for each document; class_id is the smallest id with an equal set, null for empty ones."""
    s = settings or Settings()
    first = first_pass(docs, s)
    rows = first.where("n is not null")
    common = first.where("bucket is not null").groupBy("bucket").agg(F.sum("times").alias("times")).toArrow()  # at most 2**WORD_BITS rows
    levels = np.zeros(1 << WORD_BITS, dtype=np.uint8)
    levels[common["bucket"].to_numpy()] = np.round(2 * np.log2(common["times"].to_numpy().astype(float))).astype(np.uint8)
    classes = rows.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("node"))
    sizes = {int(n): int(k) for n, k in classes.where(F.col("n") <= MOST_SMALL + 1).groupBy("n").count().collect()}
    boundary = boundary_of(sizes, s)

    signs = second_pass(docs, s, boundary, levels)
    # only the texts that stand for their class; of rows with one id and one set, one
    same = ["doc_id", "f1", "f2", "n"]
    repeats = bool(rows.groupBy(same).count().where("count > 1").take(1))
    signs = signs.join(classes.withColumnRenamed("node", "doc_id"), same, "left_semi")
    signs = written((signs.dropDuplicates(same) if repeats else signs).withColumnRenamed("doc_id", "node"), "signs")
    pairs, heavy = _lists(signs.select(F.explode("keys").alias("key"), "node", "n", F.lit(0).alias("mask")), 0, s)
    heavy, pairs = written(heavy, "heavy"), written(_filtered(pairs.where("a != b").distinct(), signs, s), "pairs")
    found = sets_of(docs, heavy.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct(), s, levels, repeats)
    links, level = [], 0
    before = None
    while now := heavy.count():
        if before is not None and (2 * now > before or level == 30):
            pairs = pairs.union(_in_blocks(heavy, signs, level, s))
            break
        before = now
        scanned = _against_leader(heavy, found, level, s)
        links.append(scanned.where("linked and node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())
        level += 1
        more, heavy = _lists(scanned.where("key is not null").select("key", "node", "n", "mask"), level, s)
        heavy = written(heavy, "heavy")
        pairs = pairs.union(_filtered(more.where("a != b").distinct(), signs, s))
    pairs = written(pairs.distinct(), "pairs")
    known = docs.sparkSession.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))  # a table from Python would start workers of its own
    for part in links:
        known = known.union(part)
    # first one pair for each set, then those still apart
    roots = components(known) if links else None
    left = _across(pairs, roots) if roots is not None else pairs
    known = written(known.union(_verified(left.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), found, s)), "known")
    roots = components(known)
    rest = _verified(_across(pairs, roots), found, s)
    if rest.take(1):
        roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(rest))
    of = classes.join(roots.withColumnRenamed("id", "node"), "node", "left").select("f1", "f2", "n", F.col("node").alias("class_id"), F.coalesce("root", "node").alias("root"))
    out = rows.join(of, ["f1", "f2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"), "class_id")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_ngram_jaccard_join": op9_ngram_jaccard_join}
