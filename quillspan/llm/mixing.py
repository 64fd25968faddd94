"""Mixing sources to target weights with DataFrame functions only.

Words are counted per document and summed per source before any shuffle. Only the table
of sources is ordered and given targets; the driver sees three sums a round. Rates go
back to the documents by a join that is broadcast only if Spark finds the table small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.scratch import Scratch, unused

WEIGHTS, SHARE, CEILING, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the seed and the id: 48 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def numbered(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """``sources`` with ``place``: 0, 1, ... by code point, null last. Ranges are numbered
    apart and moved by the counts of those before, so no task holds all sources."""
    keys = (F.col("source").asc_nulls_last(),)
    parts = scratch.keep(sources.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "sources")
    count = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = count.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*keys)) - 1
    return parts.withColumn("own", own).join(base, "part").withColumn("place", F.col("base") + F.col("own")).drop("part", "own", "base")


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, target) from (doc_id, source, size).

    All targets sum to ``share`` of all sizes, by the weights in turn over the sources in
    order; none goes beyond ``ceiling`` times its source's size, and what is cut is shared
    again by weight. ``share`` may not be above ``ceiling``. Sources without words get 0."""
    if share > ceiling:
        raise ValueError("a share above the ceiling can't be reached")
    table = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), scratch)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = scratch.keep(table.select("source", "source_size", weight.alias("w"), (F.lit(ceiling) * F.col("source_size")).alias("most")), "weighed")
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("most") <= F.lit(level) * F.col("w")
        n, cut, rest, total = table.agg(F.count_if(full), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("w"))), F.sum("source_size")).first()
        if n == capped or not rest:
            break
        level, capped = (share * (total or 0) - (cut or 0.0)) / rest, n
    target = F.least(F.col("most"), F.lit(level or 0.0) * F.col("w"))
    return table.select("source", "source_size", F.round(target, 6).alias("target"))


def mix(docs: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, seed: str = SEED) -> DataFrame:
    """Each document with size, source_size, target and ``copies``: floor(rate), and one more
    with the probability of the fraction, drawn from a hash of seed and doc_id, where rate
    is target / source_size.

    Null text has size 0; null sources are one source, last in order; a source without
    words has rate 0. Rows that repeat a doc_id draw alike. Columns of ``docs`` stay; the
    four new ones take the place of any of the same name. An empty table gives an empty one."""
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    sizes = scratch.keep(docs.select(F.col("source").cast("string"), word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "sizes")
    key = unused(docs, "_source")
    rates = targets(sizes, scratch, weights, share, ceiling).withColumnRenamed("source", key)
    joined = docs.select(*own, word_count(F.col("text")).alias("size")).join(rates, F.col("source").eqNullSafe(F.col(key))).drop(key)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(ceiling))).otherwise(0.0)
    extra = (unit_hash(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", F.floor(rate) + extra)


def emit(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The mix itself: every document of ``docs`` as often as :func:`mix` says, columns as they were, whatever they are called.

    Null and empty texts have no words and so no copies where their source has none; else they are drawn like others. A null source
    is one source. Repeated rows are repeated alike. An empty table gives an empty one."""
    names = {c: unused(docs, f"_{c}") for c in docs.columns if c in ("size", "source_size", "target", "copies")}
    mixed = mix(docs.withColumnsRenamed(names), scratch, **options).where("copies > 0")
    copy = unused(mixed, "_copy")
    repeated = mixed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))
