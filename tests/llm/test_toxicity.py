"""Toxicity: what the model learns from document labels, and the folds it must not see."""

import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import _labels, toxicity
from tessera.llm import _text as tx


def corpus(n, seed, bad=("vile", "grim")):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        sentences = [" ".join(rng.choice([f"w{k}" for k in range(300)], 8)) for _ in range(rng.integers(1, 30))]
        if y:
            sentences[rng.integers(len(sentences))] += f" {rng.choice(bad)} thing"
        rows.append((i, ". ".join(sentences) + ".", y))
    return rows


def test_noisy_or_against_its_definition():
    logits, bounds = np.array([-1.0, 0.5, 2.0]), np.array([0, 2, 2, 3])
    p = 1 / (1 + np.exp(-logits))
    want = [1 - (1 - p[0]) * (1 - p[1]), 1 / (1 + np.exp(4.0)), p[2]]
    assert np.allclose(toxicity.noisy_or(logits, bounds, -4.0), want)


def test_held_out_accuracy_and_location(spark):
    rows = corpus(900, 3)
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(None, None, 1), (900, "", 1), (901, ". . .", 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(2, None)], "doc_id long, toxic int")
    settings = toxicity.Settings()
    model = toxicity.fit(_labels.sample(docs, labels, "toxic", 600), settings)
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(out) == 903
    truth = {i: (t, y) for i, t, y in rows}
    held = [r for r in out.values() if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in held]) > 0.97
    for r in held:
        if r.predicted:
            assert any(w in truth[r.doc_id][0][r.worst_start : r.worst_end] for w in ("vile", "grim"))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert out[900].score == out[None].score < 0.5 and out[901].score < 0.5


def test_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(_labels.sample(docs, labels, "toxic", 10), toxicity.Settings())
    assert toxicity.score(docs, model).count() == 1
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_sample_is_bounded_and_skips_the_held_out(spark):
    rows = corpus(300, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int").drop("y")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = _labels.sample(docs, labels, "toxic", 40)
    held = {t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(got) == 40 and not held & {t for t, _ in got}


def test_chunks_do_not_change_a_score(monkeypatch):
    texts = pa.array([t for _, t, _ in corpus(50, 5)])
    model = toxicity.Model(toxicity.Settings(), -3.0, np.random.default_rng(0).normal(size=1 << 18).astype(np.float32))
    scores = []
    for limit in (100, 10_000_000):
        scores.append(np.concatenate([toxicity.noisy_or(toxicity.sentence_logits(b, model), b.bounds, model.bias) for c in tx.chunks(texts, limit) for b in [toxicity.bags(c)]]))
    assert np.allclose(*scores)


def test_repeated_rows_and_very_long_texts(spark):
    """Repeated rows score alike, each for itself; in a long text the offending sentence is found wherever it stands."""
    model = toxicity.fit([(t, y) for _, t, y in corpus(600, 6)], toxicity.Settings())
    calm = ". ".join(" ".join(f"w{(7 * i + k) % 300}" for k in range(8)) for i in range(20_000))
    docs = spark.createDataFrame([(1, "w1 w2 vile thing.")] * 3 + [(2, calm + ". w1 w2 w3 w4 vile thing. w5 w6."), (None, None), (None, None)], "doc_id long, text string")
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 6 and len({r.score for r in rows if r.doc_id == 1}) == 1 and len({r.score for r in rows if r.doc_id is None}) == 1
    long = next(r for r in rows if r.doc_id == 2)
    assert long.worst_start >= len(calm) and long.score >= 0.5
