from quillspan.llm import mixing
from quillspan.llm.queries import QUERIES
from quillspan.llm.scratch import Scratch


def plain_targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, ceiling=2.0):
    """Targets by round after round of resharing."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total >= ceiling * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = ceiling * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets(spark):
    for sizes in ({"a": 100, "b": 10, "c": 1000, None: 7, "": 50}, {"x": 5}, {"a": 0, "b": 0}, {"a": 0, "b": 3}):
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.targets(rows, Scratch(spark, "t")).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-5 for s in want)


def test_taken_words_come_near_targets_and_reruns_agree(spark):
    rows = QUERIES["op4_mix_sources"](spark, "/root/testdata/sf0.01").collect()
    again = QUERIES["op4_mix_sources"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(rows) == sorted(again)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    assert abs(sum(r.taken for r in rows) / (1.5 * sum(r.size for r in rows)) - 1) < 0.05


def test_rows_come_as_often_as_said(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 9 + 1), f"s{i % 4}", "x") for i in range(400)], "doc_id long, text string, source string, target string")
    mixed = {r.doc_id: r.copies for r in mixing.mix(docs, Scratch(spark, "t")).collect()}
    out = mixing.emit(docs, Scratch(spark, "t"))
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {d: n for d, n in mixed.items() if n}


def test_nulls_empty_texts_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "", "a"), (2, "a b\u00a0c\x0bd", "a"), (2, "a b\u00a0c\x0bd", "a"), (3, "x " * 50_000, None)], "doc_id long, text string, source string")
    got = mixing.mix(docs, Scratch(spark, "t")).orderBy("size").collect()
    assert [r["size"] for r in got] == [0, 0, 3, 3, 50_000]
    assert got[2].copies == got[3].copies
    assert mixing.mix(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_main_path_is_native(spark, sf_dir):
    plan = mixing.emit(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "t"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_each_sources_words_come_near_its_target(spark):
    rows = [(i, "w " * (5 + i % 40), "abc"[i % 3] if i % 50 else None) for i in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), Scratch(spark, "t")).collect()
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        target[r.source] = r.target
    assert set(taken) == {"a", "b", "c", None} and all(abs(taken[s] - target[s]) < 0.06 * target[s] + 100 for s in taken)


def test_columns_that_are_called_as_working_ones_stay(spark):
    rows = [(i, "a b c", "x", i, "s", "c", 7) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, _source string, _copy string, copies long")
    got = mixing.emit(docs, Scratch(spark, "t"))
    assert got.columns == docs.columns and got.count() >= 40
    assert all((r.size, r._source, r._copy, r.copies) == (r.doc_id, "s", "c", 7) for r in got.collect())
