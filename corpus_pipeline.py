"""A training corpus in five stages, each written and reread as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import decontaminate, language_id, mixing, near_dedup
from quillspan.llm.queries import token_digest
from quillspan.llm.scratch import Scratch


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the model knows. Null, empty and letterless texts go; repeated rows stay or go together; columns
    stay, whatever they are called; an empty table stays empty (:func:`quillspan.llm.language_id.keep_known`)."""
    return language_id.keep_known(docs, Scratch(spark, "pipeline-languages"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id. Texts without words are like nothing and stay;
    of repeated rows one stays; columns stay, whatever they are called; an empty table stays empty
    (:func:`quillspan.llm.near_dedup.drop_near_duplicates`)."""
    return near_dedup.drop_near_duplicates(docs, Scratch(spark, "pipeline-near"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Null and empty texts stay; repeated rows stay or go together; columns stay,
    whatever they are called; empty tables take nothing away (:func:`quillspan.llm.decontaminate.drop_contaminated`)."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark, "pipeline-benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the targets of their sources ask for. A null source is one source; repeated rows are drawn alike;
    columns stay, whatever they are called; an empty table stays empty (:func:`quillspan.llm.mixing.emit`)."""
    return mixing.emit(docs, Scratch(spark, "pipeline-mix"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token blocks of what is left, and each document's place and checksum in them. Null and empty texts are an end alone, null
    doc_ids come first, repeated rows stand as often as they are there; an empty table gives none
    (:func:`quillspan.llm.token_blocks.write_tokens`)."""
    return token_digest(spark, docs, "pipeline-tokens")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages),
    ("near_dedup", near_duplicates),
    ("decontaminate", without_benchmark),
    ("mix_sources", mixed),
    ("token_blocks", tokens),
]

#: Learned models and a tokenizer decide: SQL can't express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
