"""Numbers and last values in the order of rows within a key, where a key may hold a third of all rows.

A window on the key would order each key in one task. Here rows are dealt to ranges of (key, order), so that a long
key is spread over tasks; each task takes its own rows in order, and what came before it in the key it begins with, one
number and one value for each task, is added from the tasks before. Rows that are alike in key and order stand together."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from quillspan.sources import stores

NAMES = ("_part", "_at", "_n", "_head")


def changes(columns: Sequence[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before, null being like null; the first row doesn't count."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    for x in columns:
        a, b = x.slice(1), x.slice(0, max(n - 1, 0))
        differ = pc.fill_null(pc.not_equal(a, b), False)
        out[1:] |= pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return out


def _scanner(keys: list[str], value: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, n, head, last_key, carried = TaskContext.get().partitionId(), 0, 0, True, None, None
        for batch in batches:
            size = len(batch)
            if not size:
                continue
            own = [batch.column(k) for k in keys]
            new = changes(own)
            new[0] = last_key is not None and [x[0].as_py() for x in own] != last_key
            # Numbers go on from the batch before, until a key begins.
            begins = np.flatnonzero(new)
            start = np.zeros(size, np.int64)
            start[begins] = begins
            start = np.maximum.accumulate(start)
            seen = np.cumsum(new) > 0
            number = np.arange(size) - start + 1 + np.where(seen, 0, n)
            heads = head & ~seen
            extra = [pa.array(np.full(size, part, np.int32)), pa.array(at + np.arange(size)), pa.array(number), pa.array(heads)]
            names = [*batch.schema.names, *NAMES]
            if value is not None:
                x = batch.column(value)
                known = np.where(pc.is_valid(x).to_numpy(zero_copy_only=False), np.arange(size), -1)
                to = np.maximum.accumulate(known)
                to[to < start] = -1  # of another key
                # Row ``size`` is what the batch before carried over.
                both = pa.concat_arrays([x, pa.array([carried], x.type)])
                filled = both.take(pa.array(np.where(to >= 0, to, np.where(seen, size + 1, size)), mask=(to < 0) & seen))
                before = pa.concat_arrays([pa.array([carried], x.type), filled.slice(0, size - 1)])
                extra += [filled, before.take(pa.array(np.arange(size), mask=new))]
                names += ["_upto", "_before"]
                carried = filled[size - 1].as_py()
            at, n, head, last_key = at + size, int(number[-1]), head and not seen[-1], [x[size - 1].as_py() for x in own]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=names)

    return run


def _scanned(rows: DataFrame, keys: list[str], order: list[Column | str], value: str | None) -> tuple[DataFrame, DataFrame]:
    """Rows with what their task found (a written table), and what tasks before theirs add to the key they begin with (one row a task)."""
    by = [*(F.col(k) for k in keys), *(F.col(c) if isinstance(c, str) else c for c in order)]
    more = zip(NAMES, (IntegerType(), LongType(), LongType(), BooleanType()), strict=True)
    values = [(n, rows.schema[value].dataType) for n in ("_upto", "_before")] if value else []
    schema = StructType([*rows.schema.fields, *(StructField(n, t) for n, t in [*more, *values])])
    scanned = rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_scanner(keys, value), schema)
    path = stores.fresh(rows.sparkSession, "ordered")
    scanned.write.parquet(path)
    scanned = rows.sparkSession.read.schema(schema).parquet(path)
    state = F.struct(*keys, "_n", *(["_upto"] if value else []))
    ends = scanned.groupBy("_part").agg(F.max_by(state, "_at").alias("end"), F.min_by(F.struct(*keys), "_at").alias("begin"))
    # What a key has in the tasks before: the last rows of those that end with it. The window has one row a task.
    added, carried = F.sum("end._n"), F.last("end._upto", ignorenulls=True) if value else F.lit(None)
    tasks = ends.select("_part", F.col("begin").alias("key"), "end", F.struct(*(F.col(f"end.{k}").alias(k) for k in keys)).alias("ended"))
    events = tasks.select("_part", "key", F.lit(0).alias("side"), F.lit(None).cast(tasks.schema["end"].dataType).alias("end")).unionByName(tasks.select("_part", F.col("ended").alias("key"), F.lit(1).alias("side"), "end"))
    before = Window.partitionBy("key").orderBy("_part", "side").rowsBetween(Window.unboundedPreceding, -1)
    offsets = events.select("_part", "side", F.coalesce(added.over(before), F.lit(0)).alias("_added"), (carried.over(before) if value else carried).alias("_carried")).where("side = 0").drop("side")
    return scanned, offsets


def numbered(rows: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with their number from 1 in their key's ``order`` as ``name``. Null keys are one key."""
    scanned, offsets = _scanned(rows, keys, order, None)
    number = F.col("_n") + F.when(F.col("_head"), F.col("_added")).otherwise(0)
    return scanned.join(F.broadcast(offsets), "_part").select(*rows.columns, number.alias(name))


def last_before(rows: DataFrame, keys: list[str], order: list[Column | str], value: str, name: str) -> DataFrame:
    """``rows`` with the last ``value`` that isn't null of the rows before them in their key's ``order`` as ``name``."""
    scanned, offsets = _scanned(rows, keys, order, value)
    last = F.coalesce("_before", F.when(F.col("_head"), F.col("_carried")))
    return scanned.join(F.broadcast(offsets), "_part").select(*rows.columns, last.alias(name))
