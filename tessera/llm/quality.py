"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line is good or bad. Its evidence is what its bytes look like (letters,
capitals, marks, repeats, lengths) and what those of the line before and after
look like; a transition weight for each pair of neighbouring labels ties lines
together. The document's quality is the share of its characters in good lines,
by the forward-backward marginals: the sum of length times P(good), over the sum
of lengths.

Learning: the labels of lines are latent; each line has seen its document's label
through noise (a good line may stand in a bad document, seldom the reverse). The
field climbs the likelihood of what was seen: its slope is the difference of the
expected counts with the document labels and without, both by forward-backward.
It learns on a bounded sample of labelled rows (``Settings.sample``) that come to
the driver. Scoring is one pass over whole texts, without a shuffle.

A good line beside a run of bad ones may be called bad: its neighbour is evidence.

Defined results: a null or empty text is one empty line, scored as such;
repeated rows are scored each for itself; without labels all scores are one
half; extra columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as tx
from ._labels import fold, sample

#: Texts are scored in chunks of so many bytes: a task holds some fifty times that.
CHUNK_BYTES = 500_000

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_lines long, bad_lines long"


@dataclass(frozen=True)
class Settings:
    sample: int = 2000  #: labelled rows that the field is fitted on, at most
    train_block: int = 200  #: for learning, a sampled document's lines are a chain for each so many; all are learned from
    steps: int = 120
    rate: float = 0.15
    decay: float = 1e-3
    cut: float = 0.3
    stray_good: float = 0.15  #: how often a good line stands in a bad document
    stray_bad: float = 0.01  #: how often a bad line stands in a good document

    def evidence(self, bad_document: np.ndarray) -> np.ndarray:
        """What a document's label says for bad, for each of its lines: a log ratio."""
        return np.where(bad_document, np.log((1 - self.stray_bad) / self.stray_good), np.log(self.stray_bad / (1 - self.stray_good)))


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  #: evidence of a line for bad, by feature of itself, the line before and the line after; the last is the bias
    switch: np.ndarray  #: weight of each pair of labels (before, after); label 0 is good, 1 is bad


def _classes() -> np.ndarray:
    """A row of 256 flags for each class of bytes."""
    b = np.arange(256)
    letter = ((b | 32) >= 97) & ((b | 32) <= 122)
    of = lambda chars: np.isin(b, np.frombuffer(chars, np.uint8))
    return np.stack([letter & (b < 97), (letter & (b >= 97)) | (b >= 128), (b >= 48) & (b <= 57), of(b" \t"), of(b".,;:"), of(b"!?"), of(b"#*$%&"), of(b"|<>=_~^"), of(b"\"'()[]{}-/\\@+`")])


CLASSES = _classes()


def line_features(chunk: tx.Chunk) -> tuple[np.ndarray, tx.Spans, np.ndarray]:
    """Features of each line, the lines, and their lengths in characters."""
    lines = tx.split_lines(chunk)
    n = len(lines)
    part = lambda flags: _between(flags, lines)
    size = (lines.ends - lines.starts).astype(float)
    chars = part((chunk.data & 0xC0) != 0x80)
    shares = np.stack([part(c[chunk.data]) for c in CLASSES], axis=1) / np.maximum(size, 1)[:, None]
    words = tx.words(chunk)
    first, last = np.searchsorted(words.starts, lines.starts), np.searchsorted(words.starts, lines.ends)
    n_words = (last - first).astype(float)
    owner = np.repeat(np.arange(n), last - first)
    codes = tx.hashes(chunk, words)
    # words equal to the one before, and distinct ones, within each line
    same = np.zeros(len(words))
    if len(words) > 1:
        same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    keys = np.sort(tx.salted(codes, owner))
    # distinct (line, word) pairs: mark the first of each key, in word order
    order = np.argsort(tx.salted(codes, owner), kind="stable") if len(words) else np.zeros(0, int)
    fresh = np.zeros(len(words))
    if len(words):
        fresh[order] = np.concatenate([[True], keys[1:] != keys[:-1]])
    repeats = np.bincount(owner, weights=same, minlength=n) / np.maximum(n_words, 1)
    variety = np.bincount(owner, weights=fresh, minlength=n) / np.maximum(n_words, 1)
    pairs = tx.rolled(codes, 2)
    pair_owner = owner[:-1] if len(words) > 1 else owner[:0]
    inside = np.flatnonzero(owner[1:] == owner[:-1]) if len(words) > 1 else np.zeros(0, int)
    again = np.zeros(len(pairs))
    again[inside] = tx.repeated(tx.salted(pairs[inside], pair_owner[inside]))
    pair_repeats = np.bincount(pair_owner, weights=again, minlength=n) / np.maximum(n_words, 1)
    marked = ~CLASSES[1][chunk.data] & ~CLASSES[0][chunk.data]
    odd_end = np.bincount(owner, weights=marked[words.ends - 1] if len(words) else None, minlength=n) / np.maximum(n_words, 1)
    # the line again in its text
    code = tx.salted(tx.hashes(chunk, lines), lines.owner())
    again_line = tx.repeated(code) & (size > 0)
    length = np.log1p(chars)
    columns = [np.sqrt(shares), repeats, variety, pair_repeats, odd_end, again_line, length, np.log1p(n_words), chars / np.maximum(n_words, 1) / 10, size == 0, variety * np.log1p(n_words), shares**2]
    features = np.concatenate([np.asarray(c, dtype=float).reshape(n, -1) for c in columns], axis=1)
    return features, lines, chars


def _between(flags: np.ndarray, lines: tx.Spans) -> np.ndarray:
    total = np.zeros(len(flags) + 1)
    np.cumsum(flags, out=total[1:])
    return total[lines.ends] - total[lines.starts]


def neighbours(features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and of the line after (zeros beyond the text), and a one."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    n = np.diff(bounds)
    before[bounds[:-1][n > 0]] = 0
    after[bounds[1:][n > 0] - 1] = 0
    return np.concatenate([features, before, after, np.ones((len(features), 1))], axis=1)


def marginals(evidence: np.ndarray, bounds: np.ndarray, switch: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(bad) of each line, and the expected count of each pair of labels of neighbours, over all texts (each line's pair with the next weighed by ``weight``).

    Forward-backward in scaled form, all texts at once: step t handles line t of every text that has it.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = bounds[:-1][order], sizes[order]
    most = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(most), side="left")  # texts with more than t lines
    e = np.clip(evidence, -30, 30)
    emit = np.stack([np.exp(-e / 2), np.exp(e / 2)], axis=1)
    move = np.exp(switch)
    ahead = np.zeros_like(emit)
    for t in range(most):
        at = first[: alive[t]] + t
        a = emit[at] if t == 0 else (ahead[at - 1] @ move) * emit[at]
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    back = np.ones_like(emit)
    expected = np.zeros((2, 2))
    for t in range(most - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        onward = emit[at + 1] * back[at + 1]
        both = ahead[at][:, :, None] * move[None] * onward[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        expected += both.sum(axis=0) if weight is None else np.tensordot(weight[at], both, 1)
        b = onward @ move.T
        back[at] = b / b.sum(axis=1, keepdims=True)
    joint = ahead * back
    return joint[:, 1] / joint.sum(axis=1), expected


def document_scores(bad: np.ndarray, chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Share of characters in good lines; a text without characters counts its lines alike."""
    weight = chars.copy()
    empty = tx.sums(chars, bounds) == 0
    weight[np.repeat(empty, np.diff(bounds))] = 1
    return np.clip(tx.sums((1 - bad) * weight, bounds) / np.maximum(tx.sums(weight, bounds), 1e-12), 0, 1)


def likelihood_slope(theta: np.ndarray, x: np.ndarray, bounds: np.ndarray, seen: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slope of the log likelihood of what the lines have seen, by the weights of evidence and of pairs: expected counts with it less those without."""
    evidence, switch = x @ theta[:-4], theta[-4:].reshape(2, 2)
    bad, pairs = marginals(evidence, bounds, switch, weight)
    bad_seen, pairs_seen = marginals(evidence + seen, bounds, switch, weight)
    return np.concatenate([x.T @ ((bad_seen - bad) * weight), (pairs_seen - pairs).ravel()])


def fit(rows: list[tuple[str, int]], settings: Settings) -> Field:
    """Gradient steps (Adam) on the likelihood of the document labels that lines have seen, documents weighing alike."""
    width = line_features(next(tx.chunks(pa.array([""]))))[0].shape[1]
    field = Field(np.zeros(width), np.ones(width), np.zeros(3 * width + 1), np.zeros((2, 2)))
    if len({y for _, y in rows}) < 2:
        return field
    blocks, owner = [], []
    for i, (text, _) in enumerate(rows):
        lines_of = text.split("\n")
        for a in range(0, len(lines_of), settings.train_block):
            blocks.append("\n".join(lines_of[a : a + settings.train_block]))
            owner.append(i)
    owner = np.array(owner)
    features, sizes = [], []
    for chunk in tx.chunks(pa.array(blocks, pa.string())):
        f, lines, _ = line_features(chunk)
        features.append(f)
        sizes.append(np.diff(lines.bounds))
    x, sizes = np.concatenate(features), np.concatenate(sizes)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    field.mean, field.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = neighbours((x - field.mean) / field.scale, bounds)
    seen = settings.evidence(np.repeat(np.array([1 - q for _, q in rows])[owner], sizes) == 1)
    weight = np.repeat(1 / np.maximum(np.bincount(owner, sizes)[owner], 1), sizes) / len(rows)
    theta = np.concatenate([field.weights, np.zeros(4)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, settings.steps + 1):
        slope = likelihood_slope(theta, x, bounds, seen, weight) - settings.decay * theta
        slope[3 * width] += settings.decay * theta[3 * width]
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta += settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6) * (1 - step / (settings.steps + 1))
    field.weights, field.switch = theta[:-4], theta[-4:].reshape(2, 2)
    return field


def line_verdicts(chunk: tx.Chunk, field: Field) -> tuple[np.ndarray, tx.Spans, np.ndarray]:
    """P(bad) of each line, the lines, and their lengths in characters."""
    f, lines, chars = line_features(chunk)
    f -= field.mean
    f /= field.scale
    own, before, after = field.weights[:-1].reshape(3, -1)
    evidence = f @ own + field.weights[-1]  # as with neighbours(), without its wide table
    inner = np.ones(len(f) + 1, dtype=bool)
    inner[lines.bounds] = False
    inner = np.flatnonzero(inner[:-1])  # lines with one before them
    evidence[inner] += (f @ before)[inner - 1]
    evidence[inner - 1] += (f @ after)[inner]
    return marginals(evidence, lines.bounds, field.switch)[0], lines, chars


def chunk_scores(chunk: tx.Chunk, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, number of lines and number of bad ones of each text."""
    bad, lines, chars = line_verdicts(chunk, field)
    return document_scores(bad, chars, lines.bounds), np.diff(lines.bounds), tx.sums((bad > 0.5).astype(np.int64), lines.bounds)


def score(docs: DataFrame, field: Field, cut: float = 0.3, text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tx.chunks(batch.column(2), CHUNK_BYTES):
                scores, n_lines, bad = chunk_scores(chunk, field)
                ids, held = batch.column(0).slice(chunk.first, chunk.n), batch.column(1).slice(chunk.first, chunk.n)
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(scores), pa.array((scores >= cut).astype(np.int32)), pa.array(n_lines), pa.array(bad)], [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), (fold(docs["doc_id"]) == 0).alias("held_out"), F.col(text_col)).mapInArrow(tx.freed(run), SCHEMA)


def keep_good(docs: DataFrame, field: Field, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text scores at least ``cut``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tx.chunks(batch.column(at), CHUNK_BYTES):
                yield batch.slice(chunk.first, chunk.n).filter(pa.array(chunk_scores(chunk, field)[0] >= cut))

    return docs.mapInArrow(tx.freed(run), docs.schema)


def learned(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Field:
    settings = settings or Settings()
    return fit(sample(docs, labels, "quality", settings.sample), settings)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, learned(docs, labels), Settings().cut)


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
