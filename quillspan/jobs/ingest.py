"""Files to a collection that can be searched, and questions to the best chunks of the collection they are nearest to."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import vectors as V
from quillspan.operators import blocks as B
from quillspan.operators import chunks as C
from quillspan.operators import registry as G
from quillspan.operators import retrieval as R
from quillspan.sources import stores

REGISTRY = "table_id string, description string, dim int, registered_at timestamp"
CHUNKS = "id string, doc_id string, chunk_no int, title_path array<string>, content string, n_tokens int, vector array<double>, create_time timestamp, table_id string"


def ingest(files: DataFrame, store: str, registry: DataFrame, table_id: str, description: str, at: str, embed: V.Model | V.Hook = V.hash_embed, least: int = 500, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Append the chunks of ``files`` (file_name, content), with vectors, to the collection ``table_id`` of a store. Gives the registry with
    the collection in it, and (file_name, parser, ok) of all files: those of other kinds than text aren't read here.

    Texts are UTF-8 or GBK, each a block. Chunks are counted by the library's rule and split by ``embed`` where they are too long."""
    spark = files.sparkSession
    routed = B.route_files(files)
    texts = stores.text_blocks(routed.where("parser = 'text'").select(F.col("file_name").alias("doc_id"), "content"))
    lists = texts.select("doc_id", F.array(F.struct("block_no", "type", F.lit(None).cast("int").alias("level"), "text")).alias("blocks"))
    path, chunks = stores.fresh(spark, "chunks"), C.build_chunks(lists, least=least, most=most, keep_tail=True)
    chunks.write.parquet(path)
    chunks = C.split_chunks(spark.read.schema(chunks.schema).parquet(path), least, most, embed)
    rows = chunks.select(
        F.sha2(F.concat_ws("\u0001", F.lit(table_id), "doc_id", F.col("chunk_no").cast("string"), "content"), 256).alias("id"), "doc_id", "chunk_no", "title_path", "content", "n_tokens",
        V.embed(F.col("content"), embed).alias("vector"), F.to_timestamp(F.lit(at)).alias("create_time"), F.lit(table_id).alias("table_id"),
    )
    stores.write_chunks(rows, store)
    # Of the collection's own description, embedded alike, come its vector and their length.
    dim = len(V.vectors_of(embed, [description])[0])
    new = spark.createDataFrame([(table_id, description, dim)], "table_id string, description string, dim int").withColumn("registered_at", F.to_timestamp(F.lit(at)))
    return G.register(registry, new), routed.select("file_name", "parser", "ok")


def answer_contexts(questions: DataFrame, store: str, registry: DataFrame, k: int = 5, least: float = 0.5, embed: V.Model | V.Hook = V.hash_embed) -> DataFrame:
    """(query_id, table_id, context) for each (query_id, text): the collection whose description is nearest, if near enough, and its ``k``
    nearest chunks, formatted; without such a collection or chunks both are null."""
    spark = questions.sparkSession
    asked = questions.select("query_id", V.embed(F.col("text"), embed).alias("vector"))
    path = stores.fresh(spark, "asked")
    asked.write.parquet(path)
    asked = spark.read.schema(asked.schema).parquet(path)
    routed = R.route_query(asked, registry.select("table_id", V.embed(F.col("description"), embed).alias("vector")), least)
    chosen = asked.join(routed.where("table_id is not null").select("query_id", "table_id"), "query_id")
    rows = stored_chunks(spark, store)
    near = R.knn_join(chosen, rows.select("id", "vector", "table_id"), k, by="table_id")
    hits = near.join(rows.select("id", F.col("doc_id").alias("file_name"), "title_path", "content"), "id")
    return routed.select("query_id", "table_id").join(R.format_hits(hits), "query_id", "left")


def stored_chunks(spark: SparkSession, store: str) -> DataFrame:
    """The chunks of a store's collections; none where nothing is stored."""
    try:
        return spark.read.schema(CHUNKS).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CHUNKS)
