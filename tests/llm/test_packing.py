"""Packing: ids against the plain tokenizer, the plan against its bound, and the placed pieces against each other."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import packing

pytest.importorskip("public_tokenizers")

TEXTS = ["", "a", "a  b", " x", "x ", "a \n b", "  ", "\n", "foo bar  z", "<|endoftext|> foo<|endoftext|>", "it's 's  's", "é  ü  x", "\tt ab\r\n c", "w " * 3000, "x" * 5000]


def test_ids_are_the_tokenizers_own():
    encoder = packing.Encoder(packing.tokenizer_path())
    plain = [e.ids for e in encoder.tokenizer.encode_batch(TEXTS, add_special_tokens=False)]
    for _ in range(2):  # without and with the cache
        assert [x.tolist() for x in encoder.encode(pa.array(TEXTS))] == plain
    rng = np.random.default_rng(1)
    for _ in range(200):
        t = "".join(rng.choice(list("ab ,.'\n\té×1s\u3000\u2009”")) for _ in range(30))
        assert next(encoder.encode(pa.array([t]))).tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
    assert encoder.fast is not None


@pytest.mark.parametrize("counts", [{}, {5: 1}, {16: 7, 9: 4}, {k: 3 * k for k in range(1, 17)}, {9: 50, 7: 50, 16: 9}, {11: 40, 3: 5}])
def test_plan_places_every_piece_once(counts):
    histogram = np.zeros(17, dtype=np.int64)
    for k, n in counts.items():
        histogram[k] = n
    plan = packing.plan(histogram, 16)
    used = np.zeros(17, dtype=np.int64)
    for lengths, n in plan.chosen:
        assert sum(lengths) <= 16 and n > 0
        for k in lengths:
            used[k] += n
    assert (used == histogram).all()
    bound = max(-(-int((histogram * np.arange(17)).sum()) // 16), int(histogram[9:].sum() + -(-histogram[8] // 2)))
    assert plan.n_sequences <= bound + 1


def test_pack(spark):
    texts = TEXTS * 3 + [None, None]
    df = spark.createDataFrame([(i % 20, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = packing.pack(df).collect()
    assert packing.pack(df.limit(0)).count() == 0
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    encoder = packing.Encoder(packing.tokenizer_path())
    want = []
    for i, t in enumerate(texts):
        ids = [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or min(1024, len(ids))
        start = 0
        for k, end in enumerate(range(first, len(ids) + 1, 1024)):
            want.append((i % 20, k, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())))
            start = end
    assert sorted(r[:5] for r in rows) == sorted(want)


@pytest.mark.parametrize("low,high,most", [(1, 1024, 100_089), (300, 399, 72_800)])
def test_plan_at_full_capacity(low, high, most):
    """Where the linear program helps (lengths that fill a sequence in threes), and where best fit alone is better."""
    rng = np.random.default_rng(0)
    histogram = np.bincount(rng.integers(low, high + 1, 200_000), minlength=1025)
    plan = packing.plan(histogram)
    used = np.zeros(1025, dtype=np.int64)
    for lengths, n in plan.chosen:
        assert sum(lengths) <= 1024
        for k in lengths:
            used[k] += n
    bound = -(-int((histogram * np.arange(1025)).sum()) // 1024)
    assert (used == histogram).all() and plan.n_sequences <= (bound * 1.002 if low == 1 else most * 1.01)


def test_fractional_covers_and_bounds():
    """All demand is covered, the price bound lies below the cover, and where threes of lengths fill a sequence the program places most pieces."""
    rng = np.random.default_rng(1)
    for capacity, low, high in [(16, 1, 15), (64, 5, 40), (1024, 300, 399)]:
        demand = np.bincount(rng.integers(low, high + 1, 5000), minlength=capacity + 1)
        found = packing.fractional(demand, capacity)
        use = np.zeros(capacity + 1)
        for key, n in found.counts.items():
            assert sum(k * m for k, m in key) <= capacity and n > 0
            for k, m in key:
                use[k] += n * m
        assert (use[demand > 0] >= demand[demand > 0] * (1 - 1e-9)).all()
        least = int((demand * np.arange(capacity + 1)).sum()) / capacity
        assert least * (1 - 1e-9) <= found.lower <= found.total <= 1.15 * found.lower
    assert packing.plan(np.bincount(rng.integers(300, 400, 200_000), minlength=1025)).by_program > 150_000


def test_knapsack_against_all_choices():
    rng = np.random.default_rng(2)
    for _ in range(20):
        value = np.where(rng.random(10) < 0.6, rng.random(10), 0.0)
        value[0] = 0.0

        def most(room, value=value):
            return max([0.0] + [value[k] + most(room - k, value) for k in range(1, min(room, 9) + 1) if value[k] > 0])

        config = packing.best_configuration(value, 9)
        assert sum(k * n for k, n in config.items()) <= 9 and all(value[k] > 0 for k in config)
        assert abs(sum(value[k] * n for k, n in config.items()) - most(9)) < 1e-9
