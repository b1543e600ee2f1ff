"""Decontamination against a plain search for every window of every item."""

import hashlib
import re

import numpy as np
import pytest

from tessera.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for k, t in items:
        w = plain_words(t)
        for i in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[i : i + 8]), set()).add(str(k))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w = plain_words(text)
        hit, met = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    met |= found
                    hit |= set(range(i, i + n))
        out.append((doc_id, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), len(met) >= 2))
    return out


def cases(seed, letters):
    rng = np.random.default_rng(seed)
    word = lambda: rng.choice(letters)
    items = [(i, " ".join(word() for _ in range(rng.integers(0, 25)))) for i in range(25)]
    items += [(100, "solo"), (101, "two words"), (102, items[3][1]), (103, None), (104, ""), (105, "Ünï é ß x1 y2 z3 a b c")]
    docs = [(0, None), (1, ""), (2, "..."), (3, "A solo two, WORDS! two words"), (4, "ünï é ß x1 y2 z3 a b"), (4, "Ünï é ß x1 y2 z3 a b c d")]
    for i in range(60):
        parts = [word() if rng.random() < 0.7 else (items[rng.integers(25)][1] or "") for _ in range(rng.integers(0, 40))]
        docs.append((10 + i, rng.choice([" ", ", ", "\n"]).join(parts)))
    docs.append((99, "q " * 50_000 + items[5][1]))
    return docs, items


@pytest.mark.parametrize("seed,letters,shard", [(0, list("ab"), 10_000), (1, list("abcdefgh"), 10_000), (2, [f"v{i}" for i in range(60)], 60), (3, list("abc"), 40)])
def test_report(spark, seed, letters, shard):
    docs, items = cases(seed, letters)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, dc.report(d, b, shard_words=shard).collect())) == sorted(brute(docs, items))


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in dc.report(d, b).collect()] == [(1, 2, 0, 0)]
    assert dc.report(d.limit(0), b).count() == 0


def test_spans_go_and_the_rest_stays(spark):
    item = "one two three four five six seven eight nine ten"
    rest = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame(
        [(1, f"Start. {rest} One, two three four five six seven eight nine TEN! End", "k"), (2, item + " z", "k"), (3, rest, "k"), (4, None, "k"), (5, "one two three four five six seven", "k")],
        "doc_id long, text string, item_id string",
    )
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in dc.decontaminate(docs, b).collect()}
    assert got == {1: f"Start. {rest} ! End", 3: rest, 4: None, 5: "one two three four five six seven"}


def test_repeated_items_and_null_ids_count_once(spark):
    """A row that is repeated is one item, texts of one id are one item, and items without an id are one with an empty one."""
    words = "one two three four five six seven eight"
    bench = spark.createDataFrame([("7", words), ("7", words), ("7", "nine ten"), (None, "red blue"), (None, "red green")], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"x {words} nine ten y"), (2, "red blue red green"), (3, f"{words} red blue")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in dc.report(docs, bench).collect()}
    assert got == {1: (10, 1, False), 2: (4, 1, False), 3: (10, 2, True)}
