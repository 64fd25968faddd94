"""Searches, overlaps and models whose cost follows their input."""

import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillspan.functions import vectors as V
from quillspan.operators import blocks as B
from quillspan.operators import chunks as C
from quillspan.operators import folds as D
from quillspan.operators import layout as L
from quillspan.operators import retrieval as R
from quillspan.operators import web as W
from quillspan.queries.layout import boxes as line_boxes


def clustered(spark, n, dim=24, groups=40, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    x = centre[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, dim))
    return spark.createDataFrame([(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)], "id long, vector array<double>, g string")


def test_approximate_search_finds_nine_of_ten(spark, monkeypatch):
    v = clustered(spark, 3000).repartition(4)
    asked = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    probes = []
    measured = R._probes
    monkeypatch.setattr(R, "_probes", lambda *a: probes.append(measured(*a)) or probes[0])
    near = {(r.query_id, r.id): r.score for r in R.knn_approximate(asked, v, 10).collect()}
    exact = {(r.query_id, r.id): r.score for r in R.knn_join(asked, v, 10).collect()}
    assert len(near) == len(exact) and len(near.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(near[k] == exact[k] for k in near.keys() & exact.keys())
    # Few of the 54 cells are looked at.
    assert probes[0] <= 12
    # All cells: the exact result.
    assert {(r.query_id, r.id) for r in R.knn_approximate(asked, v, 10, probes=54).collect()} == exact.keys()


def test_approximate_search_in_groups_and_of_odd_rows(spark):
    v = clustered(spark, 800)
    asked = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    near = R.knn_approximate(asked, v, 4, by="g").join(v.select("id", F.col("g").alias("own")), "id").join(asked.select("query_id", "g"), "query_id")
    assert near.where("own <> g").count() == 0 and near.count() == 4 * asked.count()
    odd = spark.createDataFrame([(1, None), (None, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 0.0]), (5, [1.0, 0.0])], "id long, vector array<double>")
    got = {(r.query_id, r.id) for r in R.knn_approximate(odd.withColumnRenamed("id", "query_id").where("query_id in (2, 3)"), odd, 2).collect()}
    assert {(2, 2), (2, 5), (3, 3)} <= got and not {q for q, _ in got} - {2, 3}
    assert R.knn_approximate(odd.withColumnRenamed("id", "query_id").limit(0), odd, 2).count() == 0
    assert R.knn_approximate(asked, v.limit(0), 2).count() == 0


def test_boxes_meet_in_bands(spark):
    """A page of very many characters: what is joined is near what overlaps, and the same pairs as without bands."""
    n = 20_000
    chars = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page_number"), F.col("id").alias("char_no"), (F.col("id") % 100 * 6.0).alias("x0"), (F.col("id") % 100 * 6.0 + 5).alias("x1"), (F.floor(F.col("id") / 100) * 12.0).alias("top"), (F.floor(F.col("id") / 100) * 12.0 + 10).alias("bottom"))
    lines = spark.range(200).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page_number"), F.col("id").alias("region_no"), F.lit(0.0).alias("x0"), F.lit(600.0).alias("x1"), (F.col("id") * 12.0).alias("top"), (F.col("id") * 12.0 + 10).alias("bottom"))
    found = L.best_overlap(chars.withColumnRenamed("char_no", "box_no"), lines)
    assert found.where("region_no = floor(box_no / 100)").count() == found.count() == n
    bands = F.explode(F.sequence(F.floor(F.col("top") / L.BAND), F.floor(F.col("bottom") / L.BAND))).alias("b")
    met = chars.select(bands).groupBy("b").count().join(lines.select(bands).groupBy("b").agg(F.count("*").alias("m")), "b").agg(F.sum(F.col("count") * F.col("m"))).first()[0]
    assert met < 8 * n  # of 200 * n pairs


def test_overlaps_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    make = lambda n, key: spark.createDataFrame([(1, int(rng.integers(1, 3)), i, float(a), float(a + w), float(t), float(t + h)) for i, (a, w, t, h) in enumerate(zip(*(rng.uniform(lo, hi, n) for lo, hi in ((-20, 300), (0, 200), (-50, 500), (0, 300))), strict=True))], f"doc_id long, page_number int, {key} long, x0 double, x1 double, top double, bottom double")
    a, b = make(60, "box_no"), make(30, "region_no")
    meet = (F.col("a.page_number") == F.col("b.page_number")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.top") < F.col("b.bottom")) & (F.col("b.top") < F.col("a.bottom"))
    want = sorted(map(tuple, a.alias("a").join(b.alias("b"), meet).select("a.box_no", "b.region_no").collect()))
    assert sorted(map(tuple, L.overlapping(a, b).select("a.box_no", "b.region_no").collect())) == want and len(want) > 50


def test_captions_find_the_nearest_box_at_any_distance(spark):
    rng = np.random.default_rng(3)
    boxes, caps = [], []
    for d, spread in ((1, 900.0), (2, 60_000.0), (3, 200_000.0)):
        for i in range(25):
            x, t = float(rng.uniform(0, 400)), float(rng.uniform(0, spread))
            boxes.append((d, 1 + int(t // 800), i, x, x + 80, t, t + 40, ["figure", "table", "figure caption"][i % 3]))
            x, t = float(rng.uniform(0, 400)), float(rng.uniform(0, spread))
            caps.append((d, 1 + int(t // 800), 100 + i, x, x + 60, t, t + 10, "x"))
    schema = "doc_id long, page_number int, box_no long, x0 double, x1 double, top double, bottom double, layout_type string"
    got = {(r.doc_id, r.cap_no): (r.kind, r.box_page, r.box_no) for r in L.attach_captions(spark.createDataFrame(caps, schema), spark.createDataFrame(boxes, schema)).collect()}
    for c in caps:
        def far(b, c=c):
            dx = (b[3] + b[4] - c[3] - c[4]) / 2 if b[4] < c[3] or b[3] > c[4] else 0.0
            return round(dx * dx + ((b[5] + b[6] - c[5] - c[6]) / 2) ** 2, 4), b[7] != "figure", b[1], b[2]
        best = min((b for b in boxes if b[0] == c[0] and "caption" not in b[7]), key=far)
        assert got[c[0], c[2]] == (best[7], best[1], best[2])


def test_contents_keep_dotted_pages(spark):
    rows = [(d, 1, i, 0.0, 10.0, 20.0 * i, 20.0 * i + 12, t) for d in (1, 2) for i, t in enumerate([("Contents" if d == 1 else "Intro"), "1 One ···· 2", "2 Two ···· 3", "1 One", "a ··", "b ··", "c ··", "d ··"])]
    b = spark.createDataFrame(rows, "doc_id long, page_number int, box_no long, x0 double, x1 double, top double, bottom double, text string")
    kept = D.drop_contents(b)
    assert kept.where("doc_id = 1").count() > 4
    got = L.dotted_pages(kept, before=b)
    assert got.where("doc_id = 1").count() == kept.where("doc_id = 1").count() and got.where("doc_id = 2").count() == 0


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        open(os.path.join(folder, f"{os.getpid()}-{np.random.default_rng().integers(1 << 60)}"), "w").close()

        def model(texts: pd.Series) -> np.ndarray:
            assert len(texts) <= 3
            return np.array([[float(len(t)), 1.0] for t in texts])

        return model

    hook = V.Hook(f"test-{folder}", factory, batch=3)
    docs = spark.createDataFrame([(i, "x" * i if i else None) for i in range(100)], "i long, t string").repartition(16)
    for _ in range(2):
        assert {r.i: tuple(r.v) for r in docs.select("i", V.embed(F.col("t"), hook).alias("v")).collect()} == {i: (float(i), 1.0) for i in range(100)}
    pids = [f.split("-")[0] for f in os.listdir(folder)]
    assert len(pids) == len(set(pids)) <= 16


def test_a_callers_tokenizer_counts(spark):
    hook = V.Hook("letters", lambda: lambda text: len(text.replace(" ", "")) + 2)
    docs = spark.createDataFrame([(1, "a bc"), (2, None), (3, "")], "doc_id long, text string")
    assert [r.n for r in docs.orderBy("doc_id").select(V.token_counts(F.col("text"), hook).alias("n")).collect()] == [5, 2, 2]
    chunks = C.build_chunks(B.line_block_lists(spark.createDataFrame([(1, "t\naa bb\ncc dd")], "doc_id long, text string")), 5, 8, tokens=hook).collect()
    assert [(r.content, r.n_tokens) for r in chunks] == [("aa bb", 6), ("cc dd", 6)]


def test_oversize_chunks_split_together_as_alone(spark):
    rng = np.random.default_rng(2)
    say = lambda n: " ".join(f"{' '.join(rng.choice(list('abcdefgh'), 6))}{rng.choice(['.', '?', '。'])}" for _ in range(n))
    docs = spark.createDataFrame([(i if i else None, "\n".join(say(int(rng.integers(1, 40))) for _ in range(int(rng.integers(1, 9))))) for i in range(30)], "doc_id long, text string")
    for percentile in (None, 75.0):
        whole = C.build_chunks(B.line_block_lists(docs), 20, 60, split=True, percentile=percentile)
        parts = C.split_chunks(C.build_chunks(B.line_block_lists(docs), 20, 60), 20, 60, percentile=percentile)
        assert sorted(map(tuple, parts.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert parts.count() > 60


def test_links_are_expanded_from_one_look_at_the_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    cands = pages.select(F.floor(F.col("page_id") / 20).alias("query_id"), F.col("page_id").alias("rank"), "url")
    graph = W.link_graph(pages)
    found = W.expand_links(cands, graph.cache())
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, W.expand_links(cands, pages).collect()))
    assert "html:string" not in W.expand_links(cands, pages)._jdf.queryExecution().executedPlan().toString()


def test_cell_types_in_generated_code(spark):
    rows = spark.createDataFrame([(t,) for t in ("2024年3月", " 3,000.5 ", None, "", "One, two, three and four!")], "text string")
    found = L.with_cell_type(rows, "kind")
    assert [r.kind for r in found.collect()] == [r.k for r in rows.select(L.cell_type(F.col("text")).alias("k")).collect()]
    assert "transform" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_line_boxes_lie_on_pages(spark, sf_dir):
    assert line_boxes(spark, sf_dir).where("top < 0 or top > 600").count() == 0


def test_layout_in_one_grouping_is_the_single_operators(spark, sf_dir):
    from quillspan.queries.layout import columns

    b = columns(spark, sf_dir).withColumn("text", F.when((F.col("box_no") == 2) & (F.col("doc_id") % 3 == 0), "Contents").when(F.col("box_no") % 7 < 3, F.concat(F.lit("• "), "text")).when(F.col("box_no") % 5 == 0, F.concat("text", F.lit(" ··· 3"))).otherwise(F.col("text")))
    text = b.where("layout_type not in ('table', 'figure', 'equation')")
    merged = D.merge_paragraphs(D.merge_lines(D.assign_columns(text)))
    kept = L.dotted_pages(D.drop_contents(merged), before=merged)
    done = D.merge_bullets(kept)
    cols = ("doc_id", "page_number", "top", "x0", "type", "text")
    own = done.withColumn("type", F.when(F.col("layout_type") == "title", "title").otherwise("paragraph")).select(*cols)
    want = L.assemble_blocks(own, b.where("layout_type = 'table'").withColumn("type", F.lit("table")).select(*cols)).select("doc_id", "block_no", "type", "text")
    chain = D.document_blocks(b)
    got = chain.select("doc_id", F.inline("blocks")).select("doc_id", "block_no", "type", "text")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    plan = C.build_chunks(chain, 60, 200)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
