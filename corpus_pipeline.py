"""A corpus pipeline in five stages, each one of the operators of brigade.llm over all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brigade.llm import byte_bpe, decontaminate, near_dedup, quality_rules, suffix_dedup
from brigade.llm.joins import attach, fresh
from brigade.operators.spread import settle


def _with_text(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of documents, with the text as it is now."""
    now = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return docs.select(*[now.get(c, F.col(f"`{c}`")).alias(c) for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, the lines that failed go from the others."""
    return _with_text(quality_rules.clean(docs).where("kept"), docs.columns, "clean_text")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each class of near duplicates stays, the one with the smallest id; equal rows count once.

    A row is known by its id and a hash of its text, so repeated and null ids (the last to be chosen) stand for no other row.
    """
    row = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    classes = near_dedup.classes(docs.select(row.alias("doc_id"), "text")).where(F.col("doc_id") == F.col("class_id"))
    # within a struct a null id equals itself
    name = fresh("_id", docs.columns)
    kept = classes.select(F.col("doc_id").alias(name)).distinct()
    left = attach(docs.withColumn(name, row), kept, [name], "inner").select(*[f"`{c}`" for c in docs.columns])
    return left.dropDuplicates(["doc_id", "text"])


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated bytes go, with the rest of a character that was cut; a document that loses all it had goes."""
    cut = suffix_dedup.dedup(docs, whole_characters=True)
    return _with_text(cut.where((F.col("n_removed") == 0) | (F.length("kept") > 0)), docs.columns, "kept")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verbatim passage of the benchmark go."""
    found = decontaminate.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("items") == 0).select(*[f"`{c}`" for c in docs.columns])


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of the ids and of the text they decode to."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    wanted = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return byte_bpe.encode(docs.select("doc_id", "text"), ranks, outputs=wanted).select("doc_id", *wanted)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", suffix_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_bpe", encoding_stage),
]
# Near duplicates and byte-pair merges are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
