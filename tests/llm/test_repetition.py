"""Figures of the repetition rules against a plain reading of their definitions."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import repetition

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(grams)
    inside = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def texts():
    rng = np.random.default_rng(5)
    out = [None, "", " ", "\n\n", "a", "a " * 50, "é ü\x0bß\n" * 12, "x\ny\nx\n x\nx", "one two\r\nthree\r\n" * 9, "  　a # <b>", "tail\n", "word " * 19 + "end"]
    for _ in range(150):
        vocabulary = [f"w{i}" for i in range(rng.integers(1, 40))]
        out.append("".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "  ", "\t"], p=[0.8, 0.1, 0.05, 0.05]) for _ in range(rng.integers(0, 120))))
    out.append(" ".join(f"u{i}" for i in range(60_000)))
    return out


@pytest.mark.parametrize("limit", [64, 2_000_000])
def test_against_brute_force(monkeypatch, limit):
    monkeypatch.setattr(repetition.tx.chunks, "__defaults__", (limit,))
    all_texts = texts()
    parts = list(repetition.measure(pa.array(all_texts), repetition.Rules()))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = list(zip(*(np.concatenate([p[k] for p in parts]).tolist() for k in names), strict=True))
    assert got == [brute(t) for t in all_texts]


def test_verdict_follows_coverage():
    clean = " ".join(f"t{i}" for i in range(200))
    half = clean + "\n" + " ".join(f"t{i}" for i in range(26))
    kept = next(repetition.measure(pa.array([clean, half, clean + "\n" + clean]), repetition.Rules()))["kept"]
    assert kept.tolist() == [True, False, False]


def test_query_keeps_every_row_and_ignores_other_columns(spark):
    rows = [(1, "a b " * 30, "x"), (1, "a b " * 30, "x"), (2, None, None), (None, "c " * 5, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = repetition.repetition_rules(df)
    assert out.count() == 4
    assert {r.doc_id: r.kept for r in out.collect()} == {1: False, 2: False, None: False}
    assert repetition.repetition_rules(df.limit(0)).count() == 0
