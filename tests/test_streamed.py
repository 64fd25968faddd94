"""Folds of many groups in one pass: no call to Python for each group, and groups that go on over batches."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspan.functions import vectors as V
from quillspan.operators import blocks as B
from quillspan.operators import chunks as C
from quillspan.operators import folds as D
from quillspan.operators import layout as L
from quillspan.queries import QUERIES


def rows_of(df):
    return sorted(map(str, df.collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def check(spark, sf_dir, name):
    """One pass, and the same rows in batches of seven, where nearly every group goes on in the next."""
    whole = QUERIES[name](spark, sf_dir)
    assert "FlatMap" not in plan_of(whole) and "MapInArrow" in plan_of(whole)
    want = rows_of(whole)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    assert rows_of(QUERIES[name](spark, sf_dir)) == want and len(want) > 50
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_columns_of_many_pages_are_those_of_each(spark, sf_dir):
    check(spark, sf_dir, "assign_columns")
    rng, pages = np.random.default_rng(5), []
    for i in range(60):
        n = int(rng.integers(1, 40))
        x = rng.uniform(0, 600, n) if i % 3 == 0 else rng.choice([50.0, 300.0], n) if i % 3 == 1 else rng.choice([50.0, 200.0, 400.0], n) + rng.normal(0, 3, n)
        pages.append((x, x + rng.uniform(10, 200, n)))
    edges = np.append(0, np.cumsum([len(x) for x, _ in pages]))
    got = D.column_ids(np.concatenate([x for x, _ in pages]), np.concatenate([y for _, y in pages]), edges)
    assert got.tolist() == [c for x, y in pages for c in D.column_ids(x, y, np.array([0, len(x)])).tolist()] and got.max() >= 2
    for (x, y), a, b in zip(pages, edges[:-1], edges[1:]):
        near = np.flatnonzero(got[a:b] == 0)
        assert x.min() in x[near] and np.all(np.diff(got[a:b][np.argsort(x)]) >= 0)  # from left to right


def test_regions_of_many_pages_are_cleaned_in_one_pass(spark, sf_dir):
    check(spark, sf_dir, "clean_regions")


def test_boxes_of_many_pages_are_suppressed_in_one_pass(spark, sf_dir):
    check(spark, sf_dir, "suppress_boxes")


def test_documents_are_laid_out_in_one_pass(spark, sf_dir):
    check(spark, sf_dir, "layout_chunks")


def test_lines_of_many_pages_are_merged_in_one_pass(spark, sf_dir):
    check(spark, sf_dir, "merge_lines")


def test_contents_of_many_documents_go_in_one_pass(spark, sf_dir):
    check(spark, sf_dir, "dotted_pages")


def test_grids_of_many_tables_in_one_pass(spark, sf_dir):
    check(spark, sf_dir, "table_grid")


def test_paragraphs_of_many_pages_are_merged_in_one_pass(spark, sf_dir):
    check(spark, sf_dir, "merge_paragraphs")


def test_grids_are_brought_together_once(spark, sf_dir):
    """One shuffle of cells; rows and columns that are missing, shared, or repeat as a header."""
    for name in ("grid_html", "grid_sentences"):
        plan = plan_of(QUERIES[name](spark, sf_dir))
        assert plan.count("Exchange hashpartitioning") <= 2 and "SortMergeJoin" not in plan
    schema = "table_no long, row_no int, col_no int, text string, is_header boolean"
    rows = [(1, 0, 0, "h", True), (1, 0, 1, None, True), (1, 1, 0, "b", False), (1, 1, 0, "a", False), (1, 2, 0, "h", True), (1, 3, 2, "c", False), (1, 4, 0, "n", None), (1, 5, 0, "n", None)]
    cells, caps = spark.createDataFrame(rows, schema), spark.createDataFrame([(1, "cap")], "table_no long, caption string")
    row = lambda tag, *own: "<tr>" + "".join(f"<{tag}>{x}</{tag}>" for x in own) + "</tr>"
    want = ["<table><caption>cap</caption>", row("th", "h", "", ""), row("td", "a b", "", ""), row("td", "", "", "c"), row("td", "n", "", ""), "</table>"]
    assert L.grid_html(cells, caps).first().html == "\n".join(want)
    assert {r.row_no: r.sentence for r in L.grid_sentences(cells, caps).collect()} == {1: "h：a b\t——cap", 3: "c\t——cap"}


def test_majority_type_is_one_shuffle_without_sorting(spark, sf_dir):
    plan = plan_of(QUERIES["table_major_type"](spark, sf_dir))
    assert plan.count("Exchange") == 1 and "Window" not in plan
    rows = spark.createDataFrame([(1, "12"), (1, "34"), (1, "ab"), (2, "ab"), (2, "12"), (3, None)], "k long, text string")
    assert {(r.k, r.kind, r.n) for r in L.majority_type(rows, "k").collect()} == {(1, "Nu", 2), (2, "En", 1), (3, "Ot", 1)}


def test_beginnings_rule_out_no_pattern(spark):
    """Texts of every kind of sign, by the plain patterns and by the columns."""
    rng, signs = np.random.default_rng(6), np.array(list("0129 年月日季度第一四ABEZabz.,+-/%$_~'（é中"))
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 9)))) for _ in range(3000)] + ["2021年3月4日", "第2季度", "2021B", "9月", "a b c d e", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = L.with_cell_type(df).select("text", "kind", L.cell_type(F.col("text")).alias("other")).collect()
    assert all(r.kind == r.other == D._kind(r.text) for r in got)


def test_documents_are_chunked_in_bounded_parts():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "n_chars": [10, 900, 5000, None, 20, 30, 40], "n_blocks": [1, 1, 2, None, 1, 1, 1]})
    parts = list(C._parts(batch, 1000))
    assert [d for p in parts for d in p.column("doc_id").to_pylist()] == list(range(7)) and len(parts) > 2
    assert all(sum(x or 0 for x in p.column("n_chars").to_pylist()[1:]) <= 1000 for p in parts)  # and its first document


def test_models_get_bounded_batches(spark):
    """However many rows a batch of Arrow has; vectors come in their rows' order."""

    def model(texts):
        assert len(texts) <= V.BATCH
        return np.array([[float(t or 0), 1.0] for t in texts])

    rows = spark.range(2000).repartition(1).select("id", F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("t"))
    got = rows.select("id", V.embed(F.col("t"), model).alias("v")).collect()
    assert len(got) == 2000 and all(r.v == [r.id if r.id % 7 else 0, 1.0] for r in got)


def test_distances_within_each_list(spark):
    """Lists longer than a model's batch."""
    model = lambda texts: np.array([[1.0, 0.0] if t == "a" else [0.0, 1.0] for t in texts])
    rows = spark.createDataFrame([(1, ["a", "a", "b"]), (2, []), (3, ["a"] * 300 + ["b"] * 300), (4, ["b"])], "id int, s array<string>")
    got = {r.id: r.d for r in rows.select("id", V.distances(F.col("s"), model).alias("d")).collect()}
    assert got == {1: [None, 0.0, 1.0], 2: [], 3: [None, *[0.0] * 299, 1.0, *[0.0] * 299], 4: [None]}


def test_characters_are_shuffled_once(spark, sf_dir, monkeypatch):
    """Characters meet their boxes and become their texts in one shuffle and no join; the same in parts of a few characters."""
    whole = QUERIES["chars_to_boxes"](spark, sf_dir)
    plan = plan_of(whole)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    want = rows_of(whole)
    monkeypatch.setattr(D, "UNPACKED", 50)
    assert rows_of(QUERIES["chars_to_boxes"](spark, sf_dir)) == want and len(want) > 50


def test_characters_go_to_the_box_that_covers_most(spark, monkeypatch):
    """Boxes and characters of any size, some without an edge, by all pairs of each page."""
    rng, rows = np.random.default_rng(9), {"char": [], "box": []}
    for kind, n, high in (("char", 150, 30), ("box", 40, 120)):
        for page in (1, 2, 3):
            for i in range(0 if (kind, page) == ("box", 3) else n):
                x, y = rng.uniform(-50, 300), rng.uniform(-100, 600)
                e = [float(v) for v in (x, x + rng.uniform(-5, 120), y, y + rng.uniform(-3, high))]
                e = [None if i % 17 == 5 and k == i % 4 else v for k, v in enumerate(e)]
                if kind == "box" and i % 8 == 7:
                    e = rows["box"][-1][3:7]  # the same place twice: the first box has it
                rows[kind].append((1, page, i, *e, *((float(rng.uniform(1, 60)), [chr(97 + i % 26), " ", None][0 if i % 9 else i % 2 + 1]) if kind == "char" else ("old",))))

    def share(a, b, of):
        if None in a or None in b:
            return 0.0
        w, h = min(a[1], b[1]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[2], b[2])
        return round(w * h / ((of[1] - of[0]) * (of[3] - of[2])), 6) if w > 0 and h > 0 else 0.0

    texts = {}
    for _, page, i, *e, height, text in rows["char"]:
        e = e[:4]
        best = max(((share(e, r[3:7], e), share(e, r[3:7], r[3:7]), -r[2], r) for r in rows["box"] if r[1] == page), default=(0.0,))
        if best[0] > 0 and (abs(height - (best[3][6] - best[3][5])) / max(height, best[3][6] - best[3][5]) < 0.7 or text == " "):
            texts.setdefault((page, best[3][2]), []).append((e[0], i, text or ""))
    want = {(r[1], r[2]): "".join(t for *_, t in sorted(texts.get((r[1], r[2]), []))) for r in rows["box"]}
    places = "doc_id long, page_number int, {} long, x0 double, x1 double, top double, bottom double, "
    chars, boxes = spark.createDataFrame(rows["char"], places.format("char_no") + "height double, text string"), spark.createDataFrame(rows["box"], places.format("box_no") + "text string")
    assert {(r.page_number, r.box_no): r.text for r in D.chars_to_boxes(chars, boxes).collect()} == want and sum(map(bool, want.values())) > 20
    edges = lambda own: np.array([[np.nan if v is None else v for v in r[3:7]] for r in own]).T
    page = lambda own: np.array([r[1] for r in own])
    best = lambda: D._best_box(edges(rows["char"]), page(rows["char"]), edges(rows["box"]), page(rows["box"]), np.array([r[2] for r in rows["box"]])).tolist()
    at_once = best()
    for n in (1, 7, 100):
        monkeypatch.setattr(D, "PAIRS", n)
        assert best() == at_once


def test_cells_of_a_table_are_grouped_once(spark, sf_dir):
    """One grouping, and one shuffle besides that of the fixture; rows that are null, repeat a place, or lack cells."""
    for name, shuffles in (("table_markdown", 1), ("sheet_blocks", 2)):
        plan = plan_of(QUERIES[name](spark, sf_dir))
        assert plan.count("Exchange hashpartitioning") == shuffles and plan.count("ObjectHashAggregate") == 2
    rows = [(1, 0, 1, "b"), (1, 0, 0, "a|"), (1, 2, 0, " c\nd "), (1, 1, 0, "y"), (1, 1, 0, "x"), (1, 1, 2, None), (1, None, 5, "n"), (1, None, 4, "m"), (2, None, None, None)]
    got = {r.k: r.markdown for r in B.cells_to_markdown(spark.createDataFrame(rows, "k int, row_no int, col_no int, text string"), "k").collect()}
    assert got == {1: "| m | n |  |\n| --- | --- | --- |\n| a\\| | b |  |\n| x | y |  |\n| c d |  |  |", 2: "|  |\n| --- |"}


def test_contents_and_dotted_pages_go_in_the_same_pass(spark, sf_dir):
    """Documents are read, shuffled and given to Python once; boxes without an id or a page number stay, whatever dots they hold."""
    plan = plan_of(QUERIES["dotted_pages"](spark, sf_dir))
    assert plan.count("MapInArrow") == plan.count("FileScan") == plan.count("Exchange") == 1 and "Join" not in plan
    rng = np.random.default_rng(11)
    headings = ("Contents", "CON TENTS", "目 录", "\u3000致谢", "Ac\u212anowledge")
    pool = (*headings, "contentſ", "Contents\n", "Contents 1", "", "  ", None, *["1 One ·· 2", "1 One", "第一章 ··", "第一章", "a ··", "··"] * 3)
    rows = []
    for doc in (None, *range(60)):
        own = [x for x in pool if x not in headings] if doc is not None and doc % 2 else pool
        for i in range(int(rng.integers(1, 60))):
            rows.append((doc, None if rng.random() < 0.1 else int(rng.integers(1, 4)), i, float(rng.integers(2)), float(rng.integers(9)), own[rng.integers(len(own))]))
    want = []
    for doc in (None, *range(60)):
        left = sorted((r for r in rows if r[0] == doc), key=lambda r: (r[1] or 9, r[4], r[3], r[2]))
        kept, headed = [], False
        while left:
            box = left.pop(0)
            if (box[5] or "").lower().replace(" ", "").replace("\u3000", "") not in D.CONTENTS:
                kept.append(box)
                continue
            headed = True
            while left and not (left[0][5] or "").strip():
                left.pop(0)
            if left:
                entry = left.pop(0)[5].strip()
                head = " ".join(entry.split()[:2]) if box[5].isascii() else entry[:3]
                n = next((j for j, r in enumerate(left[:7]) if (r[5] or "").startswith(head)), 0)
                left = left[n:]
        dots = [r[1] for r in kept if "··" in (r[5] or "")]
        want += [r for r in kept if headed or None in r[:2] or dots.count(r[1]) <= 3]
    b = spark.createDataFrame(rows, "doc_id long, page_number int, box_no long, x0 double, top double, text string").repartition(3)
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert rows_of(D.drop_contents(b, 7, dotted=3)) == rows_of(spark.createDataFrame(want, b.schema))
        assert rows_of(L.dotted_pages(D.drop_contents(b, 7), before=b)) == rows_of(spark.createDataFrame(want, b.schema))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert 0 < len(want) < len(rows)
