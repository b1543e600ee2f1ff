"""The join against all pairs of small corpora, with groups that force every part of the method."""

import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import ngram_join as nj
from tessera.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute(docs):
    found = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in found}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(found):
        for j, b in found[:k]:
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return sorted((i, len(s), top(i)) for i, s in found)


def corpus(seed, n, size, edits, vocabulary=400):
    """Near copies of few bases with more and more edits, among texts of all small sizes."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(vocabulary)}"
    docs = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "a b"), (6, "A  b"), (7, "a b c"), (8, "a b c d")]
    bases = [[word() for _ in range(size)] for _ in range(3)]
    for i in range(n):
        w = list(bases[i % 3])
        for _ in range(rng.integers(0, edits + 1)):
            at = rng.integers(len(w))
            w[at : at + 1] = [[word()], [], [w[at], word()]][rng.integers(3)]
        docs.append((100 + i, " ".join(w)))
    for i in range(n // 2):
        docs.append((5000 + i, " ".join(word() for _ in range(rng.integers(1, 40))) + " common passage of some words that many texts share at their end"))
    return [docs[i] for i in rng.permutation(len(docs))]


@pytest.mark.parametrize("seed,n,size,edits,light", [(0, 60, 14, 2, 2), (1, 60, 25, 3, 3), (2, 90, 60, 6, 2), (3, 60, 120, 12, 4), (4, 40, 31, 4, 24)])
def test_against_all_pairs(spark, seed, n, size, edits, light):
    docs = corpus(seed, n, size, edits)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n int")
    got = nj.join(df, nj.Settings(light=light))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(docs)


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"x{i}" for i in range(50))
    docs = [(5, text), (5, text), (3, text + " y"), (9, "z " * 40_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in nj.join(df).collect()) == [(3, 3), (5, 3), (5, 3), (9, 9)]
    assert nj.join(df.limit(0)).count() == 0


def test_subsets_meet_exactly_where_sets_may_link():
    s = nj.Settings()
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 60, rng.integers(1, 22)).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: max(1, len(a) - rng.integers(0, 3))], rng.integers(0, 1 << 60, rng.integers(0, 3)).astype(np.uint64)]))
        d = len(np.setxor1d(a, b))
        if s.linked(d, len(a) + len(b)):
            assert len(np.intersect1d(nj._subsets(a, s, 25), nj._subsets(b, s, 25)))


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(0, 90)] + [(200, 200 + i) for i in range(1, 80)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1060, (40, 2))]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for e in links for x in e}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k in got} and all(k in got or sum(k in e for e in links if e[0] != e[1]) == 0 for k in root)


def test_workers_hold_no_tables_between_tasks(spark, monkeypatch):
    """A Python worker that has done its task holds no powers, and their table follows the chunk."""
    df, kind, runs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), type(spark.range(0)), []
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, *a, f=kind.mapInArrow: (runs.append(run), f(self, run, *a))[1])
    nj.second_pass(df, nj.Settings(), 5, np.zeros(1 << nj.WORD_BITS, dtype=np.uint8))
    nj.tx.forget()
    out = runs[0](iter([pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "text": pa.array(["a b c d e f"])})]))
    assert next(out).column("n").to_pylist() == [4] and 0 < len(nj.tx._POWERS["up"]) <= 1 << 16
    assert list(out) == [] and not nj.tx._POWERS


@pytest.mark.parametrize("block", [8, 128])
def test_a_family_that_mostly_does_not_link_needs_few_scans(spark, monkeypatch, block):
    """Near copies below the threshold, with few links among them: heavy lists that no leader breaks up are compared whole."""
    rng = np.random.default_rng(5)
    base = [f"v{i}" for i in range(150)]
    docs = []
    for i in range(70):
        w = list(base)
        for at in rng.choice(150, 9, replace=False):
            w[at] = f"n{rng.integers(5)}"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, docs[i][1] + " and more") for i in range(0, 70, 9)] + [(200 + i, docs[i][1][: -4 * i]) for i in range(1, 6)]
    scan, scans = nj._against_leader, []
    monkeypatch.setattr(nj, "_against_leader", lambda *a: (scans.append(1), scan(*a))[1])
    monkeypatch.setattr(nj, "BLOCK", block)
    got = nj.join(spark.createDataFrame(docs, "doc_id long, text string"), nj.Settings(light=4))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(docs)
    assert 1 <= len(scans) <= 8
