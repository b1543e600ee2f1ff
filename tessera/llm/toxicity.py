"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has a probability to offend, from
the hashed words and beginnings of words it holds; the document's score joins
them by noisy-or, 1 - prod(1 - p). Only documents have labels: the noisy-or carries their gradient
to the sentences, so the model also finds which sentences offend.

Learning takes a bounded sample of labelled rows to the driver
(``Settings.sample``); scoring is one pass over whole texts, without a shuffle,
with the model (``2 ** bits`` numbers) broadcast.

Defined results: a null or empty text is one empty sentence, so its score is
that of the bias alone; repeated rows are scored each for itself; without any
labels the bias is all there is; extra columns are neither read nor returned.
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

#: Bytes that end a sentence, with the words around them.
STOPS = b".!?\n"
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_sentences long, n_offending long, worst_start long, worst_end long"


@dataclass(frozen=True)
class Settings:
    sample: int = 6000  #: labelled rows that the model is fitted on, at most
    bits: int = 18  #: features are hashed to 2**bits weights
    prefixes: tuple[int, ...] = (4, 5, 6, 7, 8, 9)  #: bytes of the beginnings of words that are features beside the words
    min_docs: int = 5  #: a feature must be in so many sampled documents
    min_z: float = 4.0  #: and its share of the documents of either label must differ by so many standard errors
    steps: int = 300
    rate: float = 0.5
    decay: float = 1e-4
    bias: float = -6.0
    sentence_cut: float = 0.5


@dataclass
class Model:
    settings: Settings
    bias: float
    weights: np.ndarray


@dataclass
class Bags:
    """Sentences of a chunk and the documents they belong to; what each word holds comes one kind of feature at a time."""

    chunk: tx.Chunk
    words: tx.Spans
    sentence: np.ndarray  #: of each word
    bounds: np.ndarray  #: of documents, in sentences
    spans: tx.Spans

    def features(self, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(feature, sentence) of the words, then of their beginnings."""
        shift = tx.U64(64 - settings.bits)
        for k in (0, *settings.prefixes):
            at = np.flatnonzero(self.words.ends - self.words.starts > k)
            starts = self.words.starts[at]
            part = tx.Spans(starts, starts + k if k else self.words.ends[at], self.words.bounds)
            yield (tx.mix(tx.hashes(self.chunk, part) + tx.U64(k)) >> shift).astype(np.int64), self.sentence[at]


def bags(chunk: tx.Chunk) -> Bags:
    lowered = chunk.lowered()
    stop = np.zeros(256, dtype=bool)
    stop[np.frombuffer(STOPS, np.uint8)] = True
    words = tx.words(lowered, tx.ALNUM)
    sentences = tx.runs(lowered, ~stop[lowered.data])
    return Bags(lowered, words, np.searchsorted(sentences.starts, words.starts, side="right") - 1, sentences.bounds, sentences)


def sentence_logits(bag: Bags, model: Model) -> np.ndarray:
    logits = np.full(len(bag.spans), model.bias)
    for feature, sentence in bag.features(model.settings):
        value = model.weights[feature]
        on = np.flatnonzero(value)
        logits += np.bincount(sentence[on], weights=value[on], minlength=len(bag.spans))
    return logits


def noisy_or(logits: np.ndarray, bounds: np.ndarray, bias: float) -> np.ndarray:
    """1 - prod(1 - p) over the sentences of each document, which has one empty sentence at least."""
    none = tx.sums(np.logaddexp(0.0, logits), bounds)  # -log prod(1 - p)
    none[np.diff(bounds) == 0] = np.logaddexp(0.0, bias)
    return -np.expm1(-none)


def fit(rows: list[tuple[str, int]], settings: Settings) -> Model:
    """Screen the features by label, then gradient steps (Adagrad) on the likelihood of the document labels."""
    size = 1 << settings.bits
    model = Model(settings, settings.bias, np.zeros(size, dtype=np.float32))
    y_all = np.array([y for _, y in rows])
    n1, n0 = int(y_all.sum()), int((1 - y_all).sum())
    if not n1 or not n0:
        return model
    texts = pa.array([t for t, _ in rows], pa.string())
    seen = np.zeros((2, size))
    for chunk in tx.chunks(texts):
        bag = bags(chunk)
        doc = np.repeat(np.arange(chunk.n), np.diff(bag.bounds))
        for feature, sentence in bag.features(settings):
            pairs = np.unique(doc[sentence] * size + feature)
            label = y_all[chunk.first + pairs // size]
            for y in (0, 1):
                seen[y] += np.bincount(pairs[label == y] % size, minlength=size)
    share = (seen.sum(0) / len(rows)).clip(1e-9, 1 - 1e-9)
    z = (seen[1] / n1 - seen[0] / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    kept = np.flatnonzero((seen.sum(0) >= settings.min_docs) & (np.abs(z) >= settings.min_z))
    place = np.full(size, -1)
    place[kept] = np.arange(len(kept))

    parts = []
    for chunk in tx.chunks(texts):
        bag = bags(chunk)
        found = [(place[f][on], s[on]) for f, s in bag.features(settings) for on in [place[f] >= 0]]
        parts.append((y_all[chunk.first : chunk.first + chunk.n], bag.bounds, np.concatenate([f for f, _ in found]), np.concatenate([s for _, s in found])))
    weights, square = np.zeros(len(kept)), np.full(len(kept), 1e-4)
    bias, square_bias = settings.bias, 1e-4
    for _ in range(settings.steps):
        slope, slope_bias = np.zeros(len(kept)), 0.0
        for y, bounds, feature, sentence in parts:
            logits = bias + np.bincount(sentence, weights=weights[feature], minlength=int(bounds[-1]))
            scores = np.clip(noisy_or(logits, bounds, bias), 1e-9, 1 - 1e-9)
            # the likelihood's slope by a sentence's logit: p * (1 - score) / score in a bag marked 1, -p in one marked 0
            pull = np.where(y == 1, (1 - scores) / scores, -1.0) / len(rows)
            grad = np.repeat(pull, np.diff(bounds)) / (1 + np.exp(-logits))
            slope += np.bincount(feature, weights=grad[sentence], minlength=len(kept))
            slope_bias += grad.sum()
        slope -= settings.decay * np.sign(weights) + np.where(weights == 0, np.clip(slope, -settings.decay, settings.decay), 0)
        square += slope**2
        square_bias += slope_bias**2
        moved = weights + settings.rate * slope / np.sqrt(square)
        weights = np.where(weights * moved < 0, 0.0, moved)
        bias += settings.rate * slope_bias / np.sqrt(square_bias)
    model.bias = float(bias)
    model.weights[kept] = weights
    return model


def score(docs: DataFrame, model: Model, cut: float = 0.5, text_col: str = "text") -> DataFrame:
    """Score, prediction and the worst sentence (code points from, to) of every text."""

    sent = docs.sparkSession.sparkContext.broadcast(model)  # 4 * 2**bits bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for chunk in tx.chunks(batch.column(2)):
                bag = bags(chunk)
                logits = sentence_logits(bag, model)
                scores = noisy_or(logits, bag.bounds, model.bias)
                count = np.diff(bag.bounds)
                points = np.zeros(len(chunk.data) + 1, dtype=np.int64)
                np.cumsum((chunk.data & 0xC0) != 0x80, out=points[1:])
                worst = np.full(chunk.n, -1)
                order = np.lexsort((-np.arange(len(logits)), logits, bag.spans.owner()))  # the last of each text: its largest, the first of ties
                worst[count > 0] = order[bag.bounds[1:][count > 0] - 1]
                base = points[chunk.offsets[:-1]]
                begin = np.where(worst >= 0, points[bag.spans.starts[worst]] - base, 0) if len(logits) else np.zeros(chunk.n, np.int64)
                end = np.where(worst >= 0, points[bag.spans.ends[worst]] - base, 0) if len(logits) else np.zeros(chunk.n, np.int64)
                offending = tx.sums((logits > np.log(cut / (1 - cut))).astype(np.int64), bag.bounds)
                ids, held = batch.column(0).slice(chunk.first, chunk.n), batch.column(1).slice(chunk.first, chunk.n)
                columns = [ids, held, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(count), pa.array(offending), pa.array(begin), pa.array(end)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), (fold(docs["doc_id"]) == 0).alias("held_out"), F.col(text_col)).mapInArrow(run, SCHEMA)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    settings = Settings()
    return score(docs, fit(sample(docs, labels, "toxic", settings.sample), settings), settings.sentence_cut)


QUERIES = {"op2_toxicity": op2_toxicity}
