"""Order within a key that may be long: numbers, last values, headings, and saved changes."""

import datetime as dt
import random
import time

import pandas as pd
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from quillspan.operators import blocks as B
from quillspan.operators import chunks as C
from quillspan.operators import memory as M
from quillspan.operators import ordered as O
from quillspan.sources import changes
from quillspan.streaming import sessions


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def rows_of(spark, n=900):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, 4, None]), rng.choice(["x", "x", None]), i, rng.choice([None, None, None, f"v{i}"])) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k int, l string, o long, v string")


def test_numbers_and_last_values_are_those_of_a_window(spark):
    df = rows_of(spark)
    w = Window.partitionBy("k", "l").orderBy("o")
    assert plain(O.numbered(df, ["k", "l"], ["o"], "n")) == plain(df.withColumn("n", F.row_number().over(w)))
    before = F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    assert plain(O.last_before(df, ["k", "l"], ["o"], "v", "b")) == plain(df.withColumn("b", before))
    down = O.numbered(df, ["k"], [F.desc("o")], "n")
    assert plain(down) == plain(df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("o")))))
    assert O.numbered(df.limit(0), ["k"], ["o"], "n").collect() == []


def test_a_long_key_is_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # so that few rows have many tasks too
    own = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("o"))
    scanned, _ = O._scanned(own, ["k"], ["o"], None)
    sizes = [r.n for r in scanned.groupBy("_part").agg(F.count("*").alias("n")).collect()]
    parts = scanned.where("k = 7").select("_part").distinct().count()
    assert len(sizes) > 2 and max(sizes) < 2 * sum(sizes) / len(sizes) and parts > 1
    found = O.numbered(own, ["k"], ["o"], "n").where("k = 7")
    assert found.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (1, 6668, 6668)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_checkpoints_of_a_long_session(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1 if i % 3 else i, i, t + dt.timedelta(seconds=i)) for i in range(3000)]
    pairs = spark.createDataFrame(rows, "session_id long, pair_no long, ts timestamp")
    w = Window.partitionBy("session_id").orderBy("ts", "pair_no")
    want = pairs.withColumn("n", F.row_number().over(w) - 1).where("n % 5 = 0").select("session_id", F.col("n").cast("long"), "ts")
    cps = M.replay_checkpoints(pairs)
    assert plain(cps) == plain(want)
    found = M.asof_checkpoint(pairs.withColumnRenamed("pair_no", "seq"), cps)
    times = sorted(r.ts for r in cps.where("session_id = 1").collect())
    for r in found.where("session_id = 1").collect():
        assert r.checkpoint == max((x for x in times if x < r.ts), default=None)


def test_headings_of_long_documents_in_linear_time(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(100_000))), (2, "a\nb")], "doc_id long, text string")
    began = time.time()
    found = C.title_paths(B.line_block_lists(docs)).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("title_path").alias("m"), F.max("block_no").alias("b")).collect()
    assert time.time() - began < 60
    assert {r.doc_id: (r.n, r.b) for r in found} == {1: (85_714, 99_999), 2: (1, 1)}


def test_headings_as_rows_and_as_lists_agree(spark):
    rng = random.Random(8)
    rows = [(d, i, rng.choice(["title", "paragraph", "table"]), rng.choice([None, 0, 1, 2, 3, 5, 9]), f"{d}.{i}") for d in (1, 2, 3, None) for i in range(rng.randint(0, 60))]
    blocks = spark.createDataFrame(rows, "doc_id long, block_no int, type string, level int, text string")
    want, path, doc = [], [], object()
    for d, i, kind, level, text in rows:
        path, doc = ([] if d != doc else path), d
        if kind == "title":
            path = [*path[: max(0, (1 if level is None else level) - 1)], text]
        else:
            want.append((d, i, path, text))
    want = sorted(want, key=str)
    assert plain(C.title_paths(blocks)) == want
    assert plain(C.title_paths(C.block_lists(blocks))) == want


def test_rows_without_an_id(spark):
    rows = [("m", None, 1, "a"), ("m", None, 1, "b"), ("m", None, None, "c"), ("m", None, None, "c"), ("m", "x", 2, "d"), ("m", "x", None, "e"), (None, "y", 1, "f")]
    df = spark.createDataFrame([(k, i, s, None, None, c) for k, i, s, c in rows], "kind string, id string, seq long, create_time timestamp, create_by string, content string")
    kept = M.dedupe_batch(df)
    assert sorted(r.content for r in kept.collect()) == ["a", "b", "c", "c", "e"]
    ids = lambda batch: {r.content: r.id for r in M.fill_defaults(kept, F.to_timestamp(F.lit("2024-01-01")), batch).collect()}
    one, two = ids(0), ids(1)
    assert len(set(one.values())) == 4 and one == ids(0) and one["e"] == two["e"] == "x" and not set(one.values()) & set(two.values()) - {"x"}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_session_state_outlives_a_stop(spark, tmp_path):
    """Each lot is read by a stream of its own, which knows the lots before by its checkpoint alone; a summary that fails is tried again."""
    t, path = dt.datetime(2024, 1, 1), str(tmp_path)
    lots = [[(1, i) for i in range(3)] + [(2, 10)], [(1, i) for i in range(3, 7)], [(1, i) for i in range(7, 16)] + [(2, 17)]]
    for lot in lots:
        rows = [(s, i, t + dt.timedelta(seconds=i)) for s, i in lot]
        spark.createDataFrame(rows, "session_id long, seq long, ts timestamp").write.mode("append").parquet(f"{path}/in")
        read = spark.readStream.schema("session_id long, seq long, ts timestamp").parquet(f"{path}/in")
        out = sessions.session_state(read, summarise=lambda s, ts: ts.second != 5).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.session_id, r.pair_no) for r in spark.read.schema("session_id long, pair_no long, ts timestamp").parquet(f"{path}/out").collect())
    # After the first, four pairs make eight messages: the fifth fails at second 5, the next is the checkpoint, and so on.
    assert got == [(1, 0), (1, 6), (1, 11), (2, 0)]


STORE = "kind string, id string, v long"


def saved(spark, path):
    return sorted((r.kind, r.id, r.v) for r in changes.saved(spark, path, STORE).collect())


def test_changes_are_saved_as_they_come(spark, tmp_path):
    path, want = str(tmp_path), {}
    assert saved(spark, path) == []
    for batch in range(9):
        rows = [("m", str(i), batch) for i in range(batch * 5, batch * 5 + 40)]
        assert changes.append(path, spark.createDataFrame(rows, STORE), batch)
        want |= {(k, i): v for k, i, v in rows}
        # A batch writes its own rows; replayed, none.
        assert spark.read.parquet(f"{path}/changes/batch={batch}").count() == 40
        assert not changes.append(path, spark.createDataFrame([("m", "0", -1)], STORE), batch)
        if batch % 4 == 3:
            assert changes.compact(spark, path, STORE, buckets=8) == 8
            assert changes.compact(spark, path, STORE, buckets=8) == 0
            assert saved(spark, path) == sorted((*k, v) for k, v in want.items())
            assert changes.vacuum(spark, path) > 0 and changes.vacuum(spark, path) == 0
            assert len(changes.manifests(spark, path)) == 1
        assert saved(spark, path) == sorted((*k, v) for k, v in want.items())


def test_a_compaction_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path)
    changes.append(path, spark.createDataFrame([("m", str(i), 0) for i in range(200)], STORE), 0)
    changes.compact(spark, path, STORE, buckets=16)
    changes.append(path, spark.createDataFrame([("m", "5", 1)], STORE), 1)
    assert changes.compact(spark, path, STORE, buckets=16) == 1
    assert spark.read.parquet(f"{path}/base/upto=1").count() < 60
    assert saved(spark, path) == sorted([("m", str(i), int(i == 5)) for i in range(200)])
    changes.vacuum(spark, path)
    assert saved(spark, path) == sorted([("m", str(i), int(i == 5)) for i in range(200)])


def test_a_batch_without_manifest_does_not_count(spark, tmp_path):
    path = str(tmp_path)
    changes.append(path, spark.createDataFrame([("m", "1", 0)], STORE), 0)
    spark.createDataFrame([("m", "1", 9)], STORE).write.parquet(f"{path}/changes/batch=1")
    assert saved(spark, path) == [("m", "1", 0)]
    changes.append(path, spark.createDataFrame([("m", "1", 1)], STORE), 1)
    assert saved(spark, path) == [("m", "1", 1)]


def test_a_session_asks_for_its_state_once():
    """Rows come without a frame, in any order, null times and numbers last; state is got and put once a batch."""

    class State:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

    seen = []
    counts = sessions.Counts(4, lambda s, ts: seen.append(ts) or True, "Asia/Tokyo")
    counts.counts = State()
    row = lambda seq, ts: Row(session_id=7, seq=seq, ts=ts)
    one = list(counts.handleInputRows((7,), iter([row(3, None), row(None, 5), row(1, 5), row(2, 0)]), None))
    assert [(r.session_id, r.pair_no, r.ts) for r in one] == [(7, 0, 0), (7, 3, None)] and counts.counts.value == (4, 0)
    two = list(counts.handleInputRows((7,), iter([row(9, 10**6), row(8, 9), row(7, 8)]), None))
    assert [(r.pair_no, r.ts) for r in two] == [(6, 10**6)] and counts.counts.value == (7, 0) and counts.counts.calls == 4
    assert seen[0] is pd.NaT and seen[1] == pd.Timestamp("1970-01-01 09:00:01")
