"""Quality rules: how much of a text lies inside its own repeated n-grams and lines.

Rolling hashes of several n-gram lengths are taken over the words of many texts
at once (numpy); words inside an n-gram that occurs twice or more in its text
are marked, and their characters are held against the characters of all words.

Defined results: a null or empty text has no words and fails; rows keep their
order and number, repeated rows are judged each for itself; columns other than
the id and the text are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _text as tx

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Most of a text's word characters that may lie inside repeated n-grams, by n, and inside repeated lines."""

    min_words: int = 20
    window: int = 8
    max_window_percent: int = 30
    ngrams: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    max_line_chars: float = 0.20
    max_dup_lines: float = 0.30


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars double, max_ngram_chars double"


def measure(texts: pa.Array, rules: Rules) -> Iterator[dict[str, np.ndarray]]:
    """The figures of every text, chunk by chunk, in order."""
    for chunk in tx.chunks(texts):
        yield _measure(chunk, rules)


def _measure(chunk: tx.Chunk, rules: Rules) -> dict[str, np.ndarray]:
    spans = tx.words(chunk)
    owner, n_words = spans.owner(), np.diff(spans.bounds)
    points = np.zeros(len(chunk.data) + 1, dtype=np.int64)
    np.cumsum((chunk.data & 0xC0) != 0x80, out=points[1:])
    chars = points[spans.ends] - points[spans.starts]
    word_chars = tx.sums(chars, spans.bounds)
    symbol = np.zeros(256, dtype=bool)
    symbol[np.frombuffer(SYMBOLS, dtype=np.uint8)] = True
    n_symbols = tx.sums(symbol[chunk.data].astype(np.int64), chunk.offsets)

    lines = tx.split_lines(chunk)
    first_word = np.searchsorted(spans.starts, lines.starts)
    last_word = np.searchsorted(spans.starts, lines.ends)
    full = np.flatnonzero(last_word > first_word)
    keys = tx.salted(tx.hashes(chunk, lines)[full] + (lines.ends - lines.starts)[full].astype(np.uint64), lines.owner()[full])
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(full), dtype=bool)
    if len(full):
        later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    totals = np.zeros(len(spans) + 1, dtype=np.int64)
    np.cumsum(chars, out=totals[1:])
    line_chars = (totals[last_word] - totals[first_word])[full]
    line_owner = lines.owner()[full]
    n_lines = np.bincount(line_owner, minlength=chunk.n)
    n_dup_lines = np.bincount(line_owner, weights=later, minlength=chunk.n).astype(np.int64)
    dup_line_chars = np.bincount(line_owner, weights=line_chars * later, minlength=chunk.n)

    codes = tx.hashes(chunk, spans)
    lengths = sorted({rules.window, *rules.ngrams})
    verdict = np.ones(chunk.n, dtype=bool)
    most = np.zeros(chunk.n)
    n_repeat = np.zeros(chunk.n, dtype=np.int64)
    here = np.ones(chunk.n, dtype=bool)  # a text without repeated n-grams has no longer ones either
    for n in lengths:
        at = tx.windows(spans.bounds, n)
        at = at[here[owner[at]]]
        at = at[tx.repeated(tx.salted(tx.rolled(codes, n)[at], owner[at]))]
        here = np.bincount(owner[at], minlength=chunk.n) > 0
        inside = tx.covered(at, n, len(spans))
        if n == rules.window:
            n_repeat = tx.sums(inside.astype(np.int64), spans.bounds)
        if n in rules.ngrams:
            part = tx.sums(chars * inside, spans.bounds) / np.maximum(word_chars, 1)
            most = np.maximum(most, part)
            verdict &= part <= rules.ngrams[n]
    part = dup_line_chars / np.maximum(word_chars, 1)
    verdict &= (part <= rules.max_line_chars) & (n_dup_lines <= rules.max_dup_lines * np.maximum(n_lines, 1))
    failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_window_percent * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat, "base_failed": failed, "kept": verdict & ~failed, "dup_line_chars": part, "max_ngram_chars": most,
    }


def repetition_rules(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of figures and a verdict for every row of ``docs``; one pass, no shuffle."""
    rules = rules or Rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(measure(batch.column(1), rules))
            if parts:
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {k: pa.array(np.concatenate([p[k] for p in parts])) for k in parts[0]})

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col]).mapInArrow(run, SCHEMA)


def op1_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_repetition_coverage": op1_repetition_coverage}
