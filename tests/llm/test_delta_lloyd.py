import hashlib
import math

import numpy as np
import pytest

from quillspan.llm import delta_lloyd as D
from quillspan.llm.queries import QUERIES
from quillspan.llm.scratch import Scratch

SCHEMA = "vec_id long, embedding array<double>, cluster string, x string, block string"


def plain(rows, clusters=8, rounds=10, dim=64, scale=1024, seed="3"):
    """All vectors against all centroids, in Python's whole numbers."""
    own = [(i, tuple(math.floor(scale * float(v)) for v in x)) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    start = sorted(own, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centroids = [x for _, x in start]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        owner = [near(x)[1] for _, x in own]
        for c in range(len(centroids)):
            mine = [x for (_, x), o in zip(own, owner, strict=True) if o == c]
            if mine:
                centroids[c] = tuple(sum(v) // len(mine) for v in zip(*mine, strict=True))
    return sorted(((i, near(x)[1], near(x)[0]) for i, x in own), key=str), centroids


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, x, "a", "b", "c") for i, x in rows], SCHEMA)
    found, centroids = D.cluster(df, Scratch(spark, "t"), **options)
    return sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=str), centroids


@pytest.mark.parametrize("rounds", (0, 1, 4, 40))
def test_against_plain_lloyd(spark, rounds):
    rng = np.random.default_rng(rounds)
    rows = [(i, (rng.normal(size=5) + 3 * (i % 4)).tolist()) for i in range(700)]
    options = {"clusters": 6, "rounds": rounds, "dim": 5, "scale": 16}
    assert run(spark, rows, **options) == plain(rows, **options)


def test_odd_vectors(spark):
    rows = [(1, [0.5, -0.5]), (1, [0.5, -0.5]), (1, [0.25, 0.0]), (None, [1.0, 1.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [math.nan, 0.0]), (6, [math.inf, 0.0]), (7, [1.0, 2.0, 3.0]), (8, []), (9, [-0.001, 0.001])]
    options = {"clusters": 3, "rounds": 5, "dim": 2}
    assert run(spark, rows, **options) == plain(rows, **options)
    # Fewer vectors than clusters, ties between equal centroids, and none at all.
    assert run(spark, rows[:3], clusters=8, rounds=3, dim=2) == plain(rows[:3], clusters=8, rounds=3, dim=2)
    assert run(spark, rows[4:8], dim=2) == ([], [])


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.integers(-(2**25), 2**25, 3)]) for i in range(60)]
    options = {"clusters": 4, "rounds": 6, "dim": 3, "scale": 1}
    assert run(spark, rows, **options) == plain(rows, **options)
    with pytest.raises(Exception, match="fits in a long"):
        run(spark, [(1, [1e30, 0.0, 0.0])], dim=3)


def test_rounds_join_without_a_shuffle(spark):
    from pyspark.sql import functions as F

    scratch = Scratch(spark, "t")
    with D.Bucketed(spark, scratch, 4) as tables:
        a = tables.keep(spark.range(100).select(F.col("id").alias("block"), F.lit("x").alias("x")).repartition(4, "block"), "a")
        b = tables.keep(spark.range(100).select(F.col("id").alias("block"), F.lit("y").alias("y")).repartition(4, "block"), "b")
        plan = a.join(b.hint("shuffle_hash"), "block")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "ShuffledHashJoin" in plan
        names = tables.names
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_only_what_moved_is_compared():
    x, c = np.array([[0], [10], [20], [29]]), np.array([[0], [11], [30]])
    owner, best = np.array([0, 1, 1, 2]), np.array([0, 0, 100, 1])
    # The second centroid went from 10 to 11: rows of the first and third keep owner and distance unless 11 is nearer.
    assert [v.tolist() for v in D.nearest(x, c, np.array([False, True, False]), owner, best)] == [[0, 1, 1, 2], [0, 1, 81, 1]]
    # Of equal distances the smaller number wins, from either side.
    assert D.nearest(np.array([[5]]), np.array([[0], [10]]), np.array([True, False]), np.array([1]), np.array([25]))[0].tolist() == [0]


def test_query(spark, sf_dir):
    got = QUERIES["op12_delta_lloyd"](spark, sf_dir).collect()
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, centroids = plain(rows)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    assert {r.inertia for r in got} == {sum(d for _, _, d in want)}
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
