"""Documents to chunks, and the best chunks for each question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import vectors as V
from quillspan.operators import blocks as B
from quillspan.operators import chunks as C
from quillspan.operators import retrieval as R
from quillspan.sources import stores


def contexts(docs: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, context): the ``k`` best chunks of ``docs`` for each (query_id, text), formatted."""
    chunks = C.build_chunks(B.line_block_lists(docs), least=60, most=200)
    made = chunks.select(F.xxhash64("doc_id", "chunk_no").alias("id"), "doc_id", "title_path", "content", V.embed(F.col("content")).alias("vector"))
    # Written once: the search and the contexts both read it.
    path = stores.fresh(docs.sparkSession, "chunks")
    made.write.parquet(path)
    made = docs.sparkSession.read.schema(made.schema).parquet(path)
    found = R.knn_join(questions.select("query_id", V.embed(F.col("text")).alias("vector")), made, k)
    file = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return R.format_hits(found.join(made.drop("vector"), "id").withColumn("file_name", file))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five chunks of all documents for each benchmark item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contexts(docs, items.select(F.col("item_id").alias("query_id"), "text"))
