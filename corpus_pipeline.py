"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``; a stage that changes a text sets its
``n_chars`` anew. What a stage decides takes effect: rejected documents, lines,
copies and benchmark passages are gone for the stages after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, ngram_join, packing, quality
from tessera.llm._shared import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Near copies share four fifths of their runs of five words; op9's query has a contract of its own.
NEAR = ngram_join.Settings(words=5, percent=80)


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: learned from the labels, applied to all documents; those it rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.learned(docs, labels), quality.Settings().cut)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: one occurrence of each group of like lines stays; a document that loses its last line with a word goes."""
    out = line_dedup.dedup_lines(docs)
    n_gone = out.columns[-1]
    return _recounted(out.where((F.col(n_gone) == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")).select(*docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the one with the smallest id stays; of rows with one id that with the smallest text, and of rows that repeat it whole one."""
    groups = ngram_join.join(docs, NEAR).where("component_id = doc_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(groups, "doc_id", "left_semi")
    if docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").take(1):
        row = F.struct(F.col("text").isNull().alias("none"), F.col("text"), *[c for c in docs.columns if c not in ("doc_id", "text")])
        kept = kept.groupBy("doc_id").agg(F.min(row).alias("row"))  # partial minima: copies of an id meet before the shuffle
        kept = kept.select(*["doc_id" if c == "doc_id" else F.col("row")[c].alias(c) for c in docs.columns])
    return kept.unionByName(docs.where("doc_id is null"))


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: passages shared with test items go, and documents that are mostly such passages."""
    return _recounted(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: a row for each piece, with its sequence and place."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_good_documents),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", remove_benchmark_passages),
    ("best_fit_packing", pack_sequences),
]

#: A trained classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents; between them rows lie in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
