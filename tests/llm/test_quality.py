"""Quality: the field's marginals against all labellings, and held-out accuracy."""

import itertools

import numpy as np
import pyarrow as pa

from tessera.llm import _labels, quality
from tessera.llm import _text as tx


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    sizes = [3, 1, 5, 2]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    e, switch = rng.normal(size=bounds[-1]), rng.normal(size=(2, 2))
    bad, expected = quality.marginals(e, bounds, switch)
    want, want_pairs = np.zeros(bounds[-1]), np.zeros((2, 2))
    for a, b in itertools.pairwise(bounds):
        total, mass, pairs = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(e[a + i] * (y[i] - 0.5) for i in range(b - a)) + sum(switch[p] for p in itertools.pairwise(y)))
            total += w
            mass += w * np.array(y)
            for p in itertools.pairwise(y):
                pairs[p] += w
        want[a:b] = mass / total
        want_pairs += pairs / total
    assert np.allclose(bad, want) and np.allclose(expected, want_pairs)


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        good = int(rng.random() < 0.7)
        lines = []
        for _ in range(rng.integers(1, 8)):
            words = ["".join(rng.choice(list("abcdefghij"), rng.integers(1, 9))) for _ in range(rng.integers(3, 20))]
            junk = not good and rng.random() < 0.85
            lines.append(" ### ".join(words) if junk else " ".join(words) + ".")
        rows.append((i, "\n".join(lines), good))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(500, 1)
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(None, None, 0.0), (900, "", 0.0), (901, "\n\n", 0.0), (902, "x" * 300_000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None)], "doc_id long, quality int")
    field = quality.learned(docs, labels, quality.Settings(sample=400))
    out = {r.doc_id: r for r in quality.score(docs, field).collect()}
    truth = {i: y for i, _, y in rows}
    held = [r for r in out.values() if r.held_out and r.doc_id in truth]
    assert len(out) == 504 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())
    kept = {r.doc_id for r in quality.keep_good(docs, field).collect()}
    assert kept == {i for i, r in out.items() if r.score >= 0.3}


def test_without_labels(spark):
    docs, labels = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    field = quality.learned(docs, labels)
    assert [r.score for r in quality.score(docs, field).collect()] == [0.5]
    assert quality.score(docs.limit(0), field).count() == 0
    assert _labels.sample(docs, labels, "quality", 5) == []


def test_chunks_do_not_change_a_score():
    rows = corpus(80, 2)
    field = quality.fit([(t, y) for _, t, y in rows], quality.Settings(steps=30))
    texts = pa.array([t for _, t, _ in rows] + ["", None, "\n"])
    one, many = (np.concatenate([quality.chunk_scores(c, field)[0] for c in tx.chunks(texts, limit)]) for limit in (1, 1 << 30))
    assert np.allclose(one, many)


def test_scoring_agrees_with_the_wide_table():
    rows = corpus(30, 4)
    field = quality.fit([(t, y) for _, t, y in rows], quality.Settings(steps=10))
    chunk = next(tx.chunks(pa.array([t for _, t, _ in rows] + ["", "\n\n"])))
    f, lines, chars = quality.line_features(chunk)
    x = quality.neighbours((f - field.mean) / field.scale, lines.bounds)
    bad, _ = quality.marginals(x @ field.weights, lines.bounds, field.switch)
    assert np.allclose(quality.chunk_scores(chunk, field)[0], quality.document_scores(bad, chars, lines.bounds))


def test_slope_of_the_likelihood():
    """The slope against differences of the likelihood, summed over all labellings."""
    rng = np.random.default_rng(4)
    sizes = [4, 1, 3]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    x, seen = rng.normal(size=(8, 3)), rng.normal(size=8)
    weight = np.repeat([0.5, 0.2, 0.3], sizes)

    def likelihood(theta):
        total, e, switch = 0.0, x @ theta[:-4], theta[-4:].reshape(2, 2)
        for a, b in itertools.pairwise(bounds):
            sums = []
            for given in (e + seen, e):
                labels = itertools.product((0, 1), repeat=b - a)
                sums.append(sum(np.exp(sum(given[a + i] * (y[i] - 0.5) for i in range(b - a)) + sum(switch[p] for p in itertools.pairwise(y))) for y in labels))
            total += weight[a] * np.log(sums[0] / sums[1])
        return total

    theta = rng.normal(size=7)
    want = [(likelihood(theta + d) - likelihood(theta - d)) / 2e-5 for d in np.eye(7) * 1e-5]
    # what was seen shifts the log ratio by half up and half down, a constant of the weights
    assert np.allclose(quality.likelihood_slope(theta, x, bounds, seen, weight), want, atol=1e-6)


def test_bad_lines_of_a_mixed_document_are_located():
    """Learned from labels of documents alone, to a line at each border (its neighbour is junk); the transitions decide a doubtful line by its neighbours."""
    rng = np.random.default_rng(6)
    field = quality.fit([(t, y) for _, t, y in corpus(400, 2)], quality.Settings())
    line = lambda: ["".join(rng.choice(list("abcdefghij"), rng.integers(1, 9))) for _ in range(12)]
    lines = [" ### ".join(line()) if 10 <= k < 20 else " ".join(line()) + "." for k in range(30)]
    bad, _, _ = quality.line_verdicts(next(tx.chunks(pa.array(["\n".join(lines)]))), field)
    assert set(range(10, 20)) <= {k for k in range(30) if bad[k] > 0.5} <= set(range(9, 21))
    assert np.diag(field.switch).min() > max(field.switch[0, 1], field.switch[1, 0])
    doubt = np.where((np.arange(30) >= 10) & (np.arange(30) < 20), 3.0, -3.0)
    doubt[15] = -0.5
    ends = np.array([0, 30])
    assert quality.marginals(doubt, ends, field.switch)[0][15] > 0.5 > quality.marginals(doubt, ends, np.zeros((2, 2)))[0][15]


def test_repeated_rows_score_alike(spark):
    field = quality.fit([(t, y) for _, t, y in corpus(100, 3)], quality.Settings(steps=20))
    docs = spark.createDataFrame([(1, "a b c."), (1, "a b c."), (None, None), (None, None)], "doc_id long, text string")
    scores = [(r.doc_id, r.score) for r in quality.score(docs, field).collect()]
    assert len(scores) == 4 and len(set(scores)) == 2


def test_workers_hold_no_tables_between_tasks(spark, monkeypatch):
    """A Python worker that has scored its texts holds no powers, and texts are scored in small chunks, with the same scores."""
    rows = [(t, good) for _, t, good in corpus(60, 5)]
    field = quality.fit(rows, quality.Settings(steps=5))
    df, kind, runs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string"), type(spark.range(0)), []
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, *a, f=kind.mapInArrow: (runs.append(run), f(self, run, *a))[1])
    quality.score(df, field), quality.keep_good(df, field, 0.5)
    ids, texts = pa.array(range(len(rows))), pa.array([t for t, _ in rows])
    whole = quality.chunk_scores(next(tx.chunks(texts)), field)[0]
    most = max(len(t.encode()) for t, _ in rows)
    monkeypatch.setattr(quality, "CHUNK_BYTES", most, raising=False)
    for run, batch in ((runs[0], pa.record_batch([ids, pa.array([False] * len(rows)), texts], ["doc_id", "held_out", "text"])), (runs[1], pa.record_batch([ids, texts], ["doc_id", "text"]))):
        tx.forget()
        out = list(run(iter([batch])))
        assert len(out) > 1 and not tx._POWERS
        got = pa.Table.from_batches(out)
        assert np.allclose(got["score"], whole) if "score" in got.column_names else got["doc_id"].to_pylist() == np.flatnonzero(whole >= 0.5).tolist()
