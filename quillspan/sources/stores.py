"""Text files to blocks, and the stores of chunks and vectors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: ``spark.checkpoint.dir``, which only a local session may lack."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspan-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/quillspan-{name}-{uuid.uuid4().hex}"


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One paragraph block a file."""
    files = spark.read.format("binaryFile").load(path)
    return text_blocks(files.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), "content"))


def text_blocks(files: DataFrame) -> DataFrame:
    """(doc_id, block_no, type, text) of (doc_id, content): UTF-8, or GBK where the bytes aren't.
    Only the files that aren't UTF-8 leave the JVM."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    known = files.withColumn("text", text)

    def gbk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["text"] = [x.decode("gbk", "replace") for x in frame.pop("content")]
            yield frame

    kind = dict(files.dtypes)["doc_id"]
    other = known.where("text is null and content is not null").select("doc_id", "content").mapInPandas(gbk, f"doc_id {kind}, text string")
    rows = known.where("text is not null").select("doc_id", "text").unionByName(other)
    return rows.select("doc_id", F.lit(0).alias("block_no"), F.lit("paragraph").alias("type"), "text")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Append chunks, a folder for each collection. Rows of a collection are brought together, in tasks of about
    Spark's advisory partition size: a large collection is written by many, small ones share one."""
    chunks.hint("rebalance", F.col("table_id")).write.mode("append").partitionBy("table_id").parquet(path)


def write_vectors(rows: DataFrame, path: str) -> None:
    """Append vectors, a folder for each dimension."""
    rows.withColumn("dim", F.size("vector")).write.mode("append").partitionBy("dim").parquet(path)
