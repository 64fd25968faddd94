"""Tables written between the steps of a job, in the folder that every executor shares.

A lineage that is read more than once is cut by writing it as Parquet under
``spark.checkpoint.dir``; a lost executor then costs only the tasks it ran."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local session that has none is given one. On a cluster
    there must be one, as executors don't see a folder of the driver's machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    made = spark.sparkContext.getCheckpointDir()
    if not made:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspan-"))
        made = spark.sparkContext.getCheckpointDir()
    return made.rstrip("/")


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer where ``df`` has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


class Scratch:
    """A folder of one job's intermediate tables."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/quillspan-{job}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        df.write.options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads, and let Spark's cleaner find the shuffle
        files of the plans that wrote them."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
        gc.collect()
        jvm.System.gc()
