"""Clustering of vectors by delta Lloyd, in whole numbers and so exactly the same on any cluster.

Vectors are packed once, in blocks of ``BLOCK``, into a table bucketed by block. A round's assignments (each vector's
owner and distance) are a second table with the same buckets, so that a round joins the two without a shuffle. A
round compares a vector with the centroids that changed, and with the others only where its own centroid
moved; vectors that change owner give their components to the new one and take them from the old. Tasks
sum these signed transfers, Spark adds the sums, and the driver, which holds one sum and count for each centroid
whatever the input, moves the centroids.

What a round writes is 12 bytes a vector; the vectors themselves are shuffled once."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.scratch import Scratch

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, "3"
#: Vectors in a block, bytes of vectors in a bucket, and the most buckets (Spark's own limit is twice that).
BLOCK, BUCKET, MOST = 256, 32 << 20, 50_000
PACKED = "block long, ids array<long>, x binary"
STATE = "block long, owner binary, best binary, moved array<long>"


def kept(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): vectors of ``dim`` components, none null or not finite, as whole numbers floor(scale * component)."""
    x = F.col("embedding").cast("array<double>")
    fine = (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(math.inf)))
    return vectors.where(fine).select(F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v * scale)).alias("x"))


def bound(dim: int) -> int:
    """The largest component whose distances surely fit in a long."""
    return math.isqrt((2**63 - 1) // dim) // 2


def _packer(dim: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, most = TaskContext.get().partitionId() << 33, 0, min(bound(dim), 2**31 - 1)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, dim)
            if len(x) and (x.max() > most or x.min() < -most):
                raise ValueError(f"a component beyond {most} has no distance that fits in a long")
            ids = batch.column("vec_id")
            for a in range(0, len(x), block):
                own = ids.slice(a, block)
                row = [pa.array([base + n], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([x[a : a + block].astype("<i4").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["block", "ids", "x"])
                n += 1

    return run


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, exact: by a product of matrices where doubles hold every sum."""
    top = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if 4 * x.shape[1] * int(top) ** 2 < 2**53:
        a, b = x.astype(float), centroids.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x.astype(np.int64) - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray, changed: np.ndarray, owner: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owner of each row now, and its distance; ``owner`` -1: it has none yet. ``changed`` says which centroids did."""
    new, far = owner.copy(), best.copy()
    away = (owner < 0) | changed[owner]
    if away.any():
        all_ = distances(x[away], centroids)
        new[away] = all_.argmin(axis=1)
        far[away] = all_.min(axis=1)
    stay, own = np.flatnonzero(~away), np.flatnonzero(changed)
    if len(stay) and len(own):
        d = distances(x[stay], centroids[own])
        to, at = own[d.argmin(axis=1)], d.min(axis=1)
        go = (at < best[stay]) | ((at == best[stay]) & (to < owner[stay]))
        new[stay[go]], far[stay[go]] = to[go], at[go]
    return new, far


def _assigner(centroids: np.ndarray, changed: np.ndarray, first: bool):
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = np.zeros((k, dim + 1), np.int64)
            owners, bests = [], []
            for i in range(len(batch)):
                x = np.frombuffer(batch.column("x")[i].as_buffer(), "<i4").reshape(-1, dim)
                if first:
                    owner, best = np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)
                else:
                    owner, best = np.frombuffer(batch.column("owner")[i].as_buffer(), "<i4").astype(np.int64), np.frombuffer(batch.column("best")[i].as_buffer(), "<i8")
                new, far = nearest(x, centroids, changed, owner, best)
                go = np.flatnonzero(new != owner)
                for sign, side in ((1, new[go]), (-1, owner[go])):
                    for c in np.unique(side[side >= 0]).tolist():
                        own = go[side == c]
                        moved[c, :dim] += sign * x[own].sum(axis=0, dtype=np.int64)
                        moved[c, dim] += sign * len(own)
                owners.append(new.astype("<i4").tobytes())
                bests.append(far.astype("<i8").tobytes())
            # A batch's transfers stand in its first row.
            sums = [moved.ravel().tolist() if i == 0 and moved.any() else None for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(owners, pa.binary()), pa.array(bests, pa.binary()), pa.array(sums, pa.list_(pa.int64()))], names=["block", "owner", "best", "moved"])

    return run


def _opener(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to rows (vec_id, cluster, distance)."""
    for batch in batches:
        flat = lambda c, t: pa.array(np.concatenate([np.frombuffer(v.as_buffer(), t) for v in batch.column(c)]))
        yield pa.RecordBatch.from_arrays([batch.column("ids").flatten(), flat("owner", "<i4"), flat("best", "<i8")], names=["vec_id", "cluster", "distance"])


class Bucketed:
    """Tables of a job in the same buckets of ``block``; their files lie in the job's folder, their names go at the end."""

    def __init__(self, spark: SparkSession, scratch: Scratch, buckets: int):
        self.spark, self.scratch, self.buckets, self.names = spark, scratch, buckets, []

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        table = f"quillspan_{name}_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, "block").option("path", self.scratch.path(name)).saveAsTable(table)
        self.names.append(table)
        return self.spark.table(table)

    def __enter__(self) -> Bucketed:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def cluster(vectors: DataFrame, scratch: Scratch, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """(vec_id, cluster, distance) of the vectors (vec_id, embedding, ...) that :func:`kept` keeps, and the final centroids.

    Centroids start as the vectors of the least SHA-256 of ``seed:vec_id``; of equal ids, which have one hash, the least
    components first, and null ids last. Each round assigns vectors to the nearest centroid, ties to the
    smaller number, and moves those that own any to the floor of their mean; after ``rounds`` vectors are assigned
    once more. Rounds end early where no centroid changed, as no later one would change anything. Fewer vectors than
    ``clusters``: as many centroids. Repeated rows count as often as they stand. Other columns are ignored; an empty
    table gives an empty one. A component so large that a distance wouldn't fit in a long is an error."""
    spark, own = vectors.sparkSession, kept(vectors, dim, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    seeds = own.orderBy(order.asc_nulls_last(), "x").limit(clusters).collect()
    n = own.count() if seeds else 0
    if not seeds:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    buckets = max(1, min(MOST, -(-n // BLOCK), max(spark.sparkContext.defaultParallelism, -(-n * dim * 4 // BUCKET))))
    centroids, k = [tuple(r.x) for r in seeds], len(seeds)
    totals, changed = [[0] * (dim + 1) for _ in range(k)], np.ones(k, bool)
    with Bucketed(spark, scratch, buckets) as tables:
        packed = tables.keep(own.mapInArrow(_packer(dim, BLOCK), PACKED).repartition(buckets, "block"), "vectors")
        state = None
        for i in range(rounds + 1):
            rows = packed.select("block", "x") if state is None else packed.select("block", "x").join(state.select("block", "owner", "best").hint("shuffle_hash"), "block")
            state = tables.keep(rows.mapInArrow(_assigner(np.array(centroids, np.int64), changed, state is None), STATE), f"state{i}")
            if i == rounds:
                break
            sums = state.where("moved is not null").select(F.posexplode("moved").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
            for r in sums.collect():
                totals[r.at // (dim + 1)][r.at % (dim + 1)] += r.v
            new = [tuple(v // t[dim] for v in t[:dim]) if t[dim] else c for t, c in zip(totals, centroids, strict=True)]
            changed = np.array([a != b for a, b in zip(new, centroids, strict=True)])
            centroids = new
            if not changed.any():
                break
        found = packed.select("block", "ids").join(state.select("block", "owner", "best").hint("shuffle_hash"), "block")
        return scratch.keep(found.mapInArrow(_opener, "vec_id long, cluster int, distance long"), "assigned"), centroids
