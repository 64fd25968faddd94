"""Benchmark decontamination by size-partitioned MinHash containment search, with
DataFrame functions only.

A benchmark item is short and a document may be very long, so the resemblance of the two
sets is near nothing and equal minima of both tell nothing either. The sketch is
therefore the item's: the k least of its shingles under a universal hash (a bottom-k
MinHash), where k depends on the size partition of the item, by powers of two. Of an item of q
shingles a document that contains 75 % misses q // 4 at most, so of k > q // 4 minima it
holds at least k - q // 4. Documents' shingles are looked up in the sketches; those with
so many minima are candidates, none is lost, and each is then verified by exact containment.

Shingles of documents are never shuffled while the sketches are few: they are broadcast if
their count, which is checked, stays below a bound, and joined by shuffle otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import Scratch, unused

SHINGLE, PERCENT = 5, 75
#: Minima beyond those that a document may miss: so many must agree at least.
SPARE = 3
#: Rows of sketches or item shingles (two longs each) that are broadcast at most.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def shingle_rows(rows: DataFrame, *keys: str, k: int = SHINGLE) -> DataFrame:
    """(keys, g): the hash of every run of ``k`` words, repeats included. Fewer words are
    one shingle; text without words gives no row."""
    n = F.size("_w")
    starts = F.when(n >= k, F.sequence(F.lit(0), n - k)).when(n > 0, F.array(F.lit(0)))
    return rows.select(*keys, words_of(F.col("text")).alias("_w")).select(*keys, "_w", F.explode(starts).alias("_i")).select(*keys, F.xxhash64(*(F.get("_w", F.col("_i") + j) for j in range(k))).alias("g"))


def item_index(items: DataFrame, scratch: Scratch, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """(item_id, g, q, place): distinct shingles of each item, its size and their order by a
    universal hash. Items are keyed by their shingle sets, so repeated rows count once."""
    keyed = items.where("item_id is not null and text is not null").select("item_id", "text")
    rows = shingle_rows(keyed, "item_id", k=k).distinct()
    sets = rows.groupBy("item_id").agg(F.count("*").alias("q"), F.sort_array(F.collect_list(F.struct(F.xxhash64("g", F.lit(17)).alias("h"), "g"))).alias("all"))
    return scratch.keep(sets.select("item_id", "q", F.posexplode("all").alias("place", "x")).select("item_id", F.col("x.g").alias("g"), F.col("q").cast("int"), "place"), "items")


def sketches(index: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The least hashes of each item: of the partition with up to u shingles, a quarter of u and SPARE."""
    most = F.pow(F.lit(2.0), F.floor(F.log2("q")) + 1) - 1
    missing = lambda n: F.floor(n * (100 - percent) / 100)
    size = F.least(F.col("q"), (missing(most) + SPARE).cast("int"))
    return index.where(F.col("place") < size).select("item_id", "g", (size - missing(F.col("q"))).cast("int").alias("least"))


def _probe(rows: DataFrame, index: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(index) if index.count() <= BROADCAST_ROWS else index, "g")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, which tells rows of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key")).where("text is not null")


def contaminated(docs: DataFrame, items: DataFrame, scratch: Scratch, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, item_id, n_item, n_shared): the pairs where the document holds at least
    ``percent`` of the item's distinct ``k``-word shingles, lower-cased.

    Null or empty texts, and items with a null id, take no part. An item of fewer than ``k``
    words is one shingle, which only a document of just those words holds. Rows that repeat
    a doc_id and text give one pair; with other texts they are judged apart, also where doc_id
    is null. Other columns are ignored. Empty tables give an empty table."""
    index = item_index(items, scratch, percent, k)
    short = scratch.keep(sketches(index, percent), "sketches")
    rows = keyed(docs)
    hits = _probe(shingle_rows(rows, "doc_id", "text_key", k=k), short).groupBy("doc_id", "text_key", "item_id", "g").agg(F.first("least").alias("least"))
    counted = hits.groupBy("doc_id", "text_key", "item_id").agg(F.count("*").alias("n"), F.first("least").alias("least"))
    found = scratch.keep(counted.where("n >= least").select("doc_id", "text_key", "item_id"), "candidates")

    wanted = found.select("doc_id", "text_key").distinct()
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key"))
    texts = rows.alias("a").join(wanted.alias("b"), same, "left_semi")
    shared = _probe(shingle_rows(texts, "doc_id", "text_key", k=k), index.select("item_id", "g", "q")).groupBy("doc_id", "text_key", "item_id", "q", "g").agg(F.lit(1).alias("one"))
    exact = shared.groupBy("doc_id", "text_key", "item_id", "q").agg(F.count("*").alias("n_shared")).where(f"100 * n_shared >= {percent} * q")
    return exact.select("doc_id", "text_key", "item_id", F.col("q").cast("long").alias("n_item"), "n_shared")


def drop_contaminated(docs: DataFrame, items: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; all columns stay, whatever they are called.

    Null and empty texts stay, as do all rows where there are no items. Rows of one doc_id (or none) are judged by their own
    texts; repeated rows go or stay together. An empty table gives an empty one."""
    d, t = unused(docs, "_d"), unused(docs, "_t")
    bad = scratch.keep(contaminated(docs, items, scratch, **options).select(F.col("doc_id").alias(d), F.col("text_key").alias(t)).distinct(), "bad")
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col("text").cast("string")) == F.col(t)), "left_anti")
