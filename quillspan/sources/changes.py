"""A table that is saved as changes: what a batch writes follows the batch, not the table.

    base/upto=N/bucket=B    rows of the bucket's keys as of batch N
    changes/batch=N         rows that batch N added, or put in the place of those with their keys
    manifest/N              one row: the batch is saved
    manifest/N-compacted    one row: the last compaction of each bucket as of batch N

A batch writes its rows and then its manifest, so that it counts as a whole or not at all; one that is tried again, or replayed,
is passed over. Readers take the newest row of each key from the base and the changes since. A compaction
writes the buckets anew that changes since the last one touched, and no others, then its manifest; :func:`vacuum` deletes what
the newest manifest doesn't name, other manifests included, so that as few are read as there were batches since."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
MANIFEST = "batch long, compacted boolean, buckets map<int,long>"


def bucket_of(keys: tuple[str, ...], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def manifests(spark: SparkSession, path: str) -> list:
    """All that is saved, in order; one short row a batch since the last :func:`vacuum`."""
    try:
        return sorted(spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(f"{path}/manifest").collect(), key=lambda r: (r.batch, r.compacted))
    except AnalysisException as e:  # nothing is saved yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _state(known: list) -> tuple[dict[int, int], list[int]]:
    """The last compaction of each bucket, and the batches since."""
    last = max((i for i, r in enumerate(known) if r.compacted), default=-1)
    since = [r.batch for r in known[last + 1 :]]
    return (known[last].buckets or {}) if last >= 0 else {}, since


def _note(spark: SparkSession, path: str, batch: int, compacted: bool, buckets: dict[int, int] | None) -> None:
    name = f"{path}/manifest/{batch}{'-compacted' if compacted else ''}"
    spark.createDataFrame([(batch, compacted, buckets)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(name)


def append(path: str, rows: DataFrame, batch: int) -> bool:
    """Save a batch; its rows have different keys. False if it is saved already."""
    spark = rows.sparkSession
    known = manifests(spark, path)
    if known and known[-1].batch >= batch:
        return False
    rows.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")
    _note(spark, path, batch, False, None)
    return True


def saved(spark: SparkSession, path: str, schema: str | StructType, keys: tuple[str, ...] = ("kind", "id")) -> DataFrame:
    """The newest row of each key. Rows of one key meet where they are read, before the one shuffle."""
    return _newest(spark, path, schema, keys, *_state(manifests(spark, path)))


def _newest(spark: SparkSession, path: str, schema: str | StructType, keys: tuple[str, ...], base: dict[int, int], since: list[int]) -> DataFrame:
    folders = [f"{path}/base/upto={n}/bucket={b}" for b, n in sorted(base.items())]
    old = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    if not since:
        return old
    new = [spark.read.schema(schema).parquet(f"{path}/changes/batch={n}").withColumn("_batch", F.lit(n).cast("long")) for n in since]
    rows = old.withColumn("_batch", F.lit(-1).cast("long"))
    for df in new:
        rows = rows.unionByName(df)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*old.columns), "_batch").alias("r")).select("r.*")


def compact(spark: SparkSession, path: str, schema: str | StructType, keys: tuple[str, ...] = ("kind", "id"), buckets: int = BUCKETS) -> int:
    """Write the buckets that batches since the last compaction touched anew; their number."""
    base, since = _state(manifests(spark, path))
    if not since:
        return 0
    changed = spark.read.schema(schema).parquet(*(f"{path}/changes/batch={n}" for n in since))
    touched = sorted(r.b for r in changed.select(bucket_of(keys, buckets).alias("b")).distinct().collect())
    upto = since[-1]
    rows = _newest(spark, path, schema, keys, {b: n for b, n in base.items() if b in touched}, since).withColumn("bucket", bucket_of(keys, buckets))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base/upto={upto}")
    _note(spark, path, upto, True, base | dict.fromkeys(touched, upto))
    return len(touched)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete what the newest state doesn't name; the number of folders deleted. Not while others read."""
    known = manifests(spark, path)
    base, since = _state(known)
    fs_path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    fs = fs_path(path).getFileSystem(conf)
    names = lambda *at: [s.getPath().getName() for s in fs.listStatus(fs_path("/".join((path, *at))))] if fs.exists(fs_path("/".join((path, *at)))) else []
    last = max((r.batch for r in known if r.compacted), default=None)
    gone = [f"{path}/changes/{n}" for n in names("changes") if int(n.partition("=")[2]) not in since]
    gone += [f"{path}/manifest/{n}" for n in names("manifest") if last is not None and int(n.partition("-")[0]) <= last and n != f"{last}-compacted"]
    for n in names("base"):
        own = {f"bucket={b}" for b, v in base.items() if n == f"upto={v}"}
        gone += [f"{path}/base/{n}/{b}" for b in names("base", n) if b.startswith("bucket=") and b not in own] if own else [f"{path}/base/{n}"]
    for x in gone:
        fs.delete(fs_path(x), True)
    return len(gone)
