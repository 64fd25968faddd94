"""The table of collections: (table_id, description, dim, registered_at)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def register(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The newest entry of each (description, dim), then the greater id."""
    newest = Window.partitionBy("description", "dim").orderBy(F.desc("registered_at"), F.desc("table_id"))
    return registry.unionByName(new).withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n")


def update(registry: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry with new descriptions by id, and a status for each request."""
    new = changes.groupBy("table_id").agg(F.max("description").alias("new"))
    table = registry.join(new, "table_id", "left").withColumn("description", F.coalesce("new", "description")).drop("new")
    return table, _status(changes, registry)


def delete(registry: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Registry and chunks without the collections, and a status for each request."""
    return registry.join(ids, "table_id", "left_anti"), chunks.join(ids, "table_id", "left_anti"), _status(ids, registry)


def _status(asked: DataFrame, registry: DataFrame) -> DataFrame:
    there = registry.select("table_id", F.lit(True).alias("there")).distinct()
    return asked.join(there, "table_id", "left").select("table_id", F.when(F.col("there"), "success").otherwise("no such id").alias("status"))


def tools(registry: DataFrame) -> DataFrame:
    """``search_knowledge_<n>`` for each collection in order of registration. One short row a collection."""
    order = F.row_number().over(Window.orderBy("registered_at", "table_id")) - 1
    return registry.select(F.concat(F.lit("search_knowledge_"), order.cast("string")).alias("name"), "description", "table_id")


def overview(registry: DataFrame, empty: str = "no collections") -> DataFrame:
    """One line of all descriptions in order."""
    all_ = F.sort_array(F.collect_list(F.struct("registered_at", "table_id", "description")))
    line = F.array_join(F.transform("a", lambda x: F.concat(F.lit("【"), x["description"], F.lit("】"))), " | ")
    return registry.agg(all_.alias("a")).select(F.when(F.size("a") == 0, empty).otherwise(line).alias("overview"))
