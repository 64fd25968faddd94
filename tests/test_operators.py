"""Hand cases: quirks, nulls, ties, and properties that no table shows."""

import datetime as dt

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions import vectors as V
from quillspan.operators import blocks as B
from quillspan.operators import chunks as C
from quillspan.operators import folds as D
from quillspan.operators import layout as L
from quillspan.operators import memory as M
from quillspan.operators import registry as G
from quillspan.operators import retrieval as R
from quillspan.operators import web as W
from quillspan.sources import changes, stores
from quillspan.streaming import sessions

BLOCK = "doc_id long, block_no int, type string, level int, text string"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_chinese_text_counts_each_character(spark):
    assert one(spark, T.token_count, "你好 world, 3") == 7
    assert one(spark, T.token_count, None) == 2


def test_sentences_split_after_ends_and_lines(spark):
    assert one(spark, T.sentences, "A b. C? D。 E\n\nF") == ["A b.", "C?", "D。", "E", "F"]


def test_urls(spark):
    assert one(spark, T.real_url, "//s.example/l/?uddg=https%3A%2F%2Fa.b%2Fc&x=1") == "https://a.b/c"
    assert one(spark, T.page_key, "https://a.b.c/d/e?x") == "a_b_c_d_e"
    assert one(spark, T.risky, "https://a.b/Login") and not one(spark, T.risky, None)
    assert one(spark, T.extension, "a.tar.GZ") == "gz" and one(spark, T.extension, "none") == ""


def test_level_skips_cut_the_stack_by_length(spark):
    rows = [(1, 0, "title", 1, "a"), (1, 1, "title", 3, "b"), (1, 2, "title", 3, "c"), (1, 3, "paragraph", None, "t"), (1, 4, "title", None, "d"), (1, 5, "table", None, "u")]
    got = {r.block_no: r.title_path for r in C.title_paths(spark.createDataFrame(rows, BLOCK)).collect()}
    assert got == {3: ["a", "b", "c"], 5: ["d"]}


def test_tail_below_the_minimum_is_lost_unless_kept(spark):
    rows = [(1, i, "paragraph", None, "w " * 50) for i in range(40)] + [(2, 0, "paragraph", None, "short")]
    blocks = spark.createDataFrame(rows, BLOCK)
    assert {r.doc_id for r in C.build_chunks(blocks, 60, 200).collect()} == {1}
    kept = C.build_chunks(blocks, 60, 200, keep_tail=True).collect()
    assert {r.doc_id for r in kept} == {1, 2}
    assert "\n".join(r.content for r in sorted(kept, key=lambda r: r.chunk_no) if r.doc_id == 1) == "\n".join("w " * 50 for _ in range(40))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(1, 3), st.integers(0, 40)), max_size=30), st.integers(3, 30), st.integers(31, 80))
def test_chunks_cover_the_text_in_order(parts, least, most):
    blocks = [{"type": "title" if t else "paragraph", "level": level, "text": " ".join(["w"] * n), "n": n} for t, level, n in parts]
    out = list(C.pack(blocks, least, most, False, True))
    assert "\n".join(c for _, c, _ in out).split() == [w for b in blocks if b["type"] != "title" for w in b["text"].split()]
    assert all(n >= least for _, _, n in out[:-1])


def test_whole_documents_are_chunked_where_they_are(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = C.build_chunks(B.line_block_lists(docs), 60, 200)
    assert "Exchange" not in narrow._jdf.queryExecution().executedPlan().toString()
    wide = C.build_chunks(B.line_blocks(docs), 60, 200)
    assert sorted(map(str, narrow.collect())) == sorted(map(str, wide.collect()))


def test_a_callers_tokenizer_counts(spark):
    blocks = spark.createDataFrame([(1, i, "paragraph", None, "x" * 10) for i in range(8)], BLOCK)
    got = C.build_chunks(blocks, 5, 25, tokens=len).orderBy("chunk_no").collect()
    assert [(r.content, r.n_tokens) for r in got] == [("\n".join(["x" * 10] * 2), 21)] * 4
    far = lambda s: np.array([[1.0, 0.0] if "a" in x else [0.0, 1.0] for x in s])
    assert C.cut("a a\na a\nb b\nb b\nb b", 1, 1000, far, percentile=75) == ["a a\na a", "b b\nb b\nb b"]


def test_words_weigh_as_in_the_vectors(spark):
    rows = spark.createDataFrame([(1, "A a b c_d É"), (2, ""), (3, None)], "i long, text string")
    want = {(1, j): w for j, w in enumerate(V.hash_embed(pd.Series(["A a b c_d É"]))[0]) if w}
    got = {(r.i, r.bucket): r.weight for r in V.word_weights(rows, "text", "i").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_a_batch_is_saved_once(spark, tmp_path):
    schema = "kind string, id string, seq long, create_time timestamp, create_by string, content string"
    t = dt.datetime(2024, 1, 1)
    first = spark.createDataFrame([("m", "1", 1, t, None, "a"), ("m", "1", 2, t, None, "again"), ("m", "2", 3, t, "u", "b"), ("s", "1", 4, None, None, "c"), (None, "9", 5, t, None, "x"), ("m", None, 6, t, None, "d")], schema)
    second = spark.createDataFrame([("m", "2", 7, t, None, "new"), ("m", "3", 8, t, None, "e")], schema)
    save, path = sessions.save_batch(str(tmp_path), embed=V.hash_embed), str(tmp_path)
    read = lambda: sorted((r.kind, r.content, r.create_by, len(r.vector)) for r in changes.saved(spark, path, schema + ", vector array<double>").collect())
    assert read() == []
    save(first, 0)
    one = read()
    assert one == [("m", "a", "system", 256), ("m", "b", "u", 256), ("m", "d", "system", 256), ("s", "c", "system", 256)]
    save(first, 0)
    assert read() == one
    for _ in range(2):
        save(second, 1)
        assert read() == [("m", "a", "system", 256), ("m", "d", "system", 256), ("m", "e", "system", 256), ("m", "new", "system", 256), ("s", "c", "system", 256)]
    save(second.limit(0), 2)
    assert len(read()) == 5


def test_split_joins_small_pieces():
    text = "\n".join(f"{w} " * 12 for w in "a b c d e f".split())
    out = C.cut(text, 20, 30)
    assert "".join("".join(out).split()) == "".join(text.split()) and len(out) > 1


def test_gbk_files_are_read(spark):
    rows = spark.createDataFrame([(1, "中文".encode("gbk")), (2, "中文".encode()), (3, None)], "doc_id long, content binary")
    assert {r.doc_id: r.text for r in stores.text_blocks(rows).collect()} == {1: "中文", 2: "中文"}


def test_heading_without_number_is_level_one(spark):
    rows = spark.createDataFrame([(1, 0, "Heading", " a "), (1, 1, "Heading 2", "b"), (1, 2, None, "c"), (1, 3, "Normal", "  ")], "doc_id long, para_no int, style string, text string")
    assert [(r.type, r.level, r.text) for r in B.blocks_from_paragraphs(rows).orderBy("block_no").collect()] == [("title", 1, "a"), ("title", 2, "b"), ("paragraph", None, "c")]


def test_routing_takes_the_best_of_those_that_reach_the_threshold(spark):
    reg = spark.createDataFrame([("low", [0.0, 1.0]), ("best", [1.0, 0.1]), ("other", [1.0, 1.0])], "table_id string, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, -1.0])], "query_id long, vector array<double>")
    assert {r.query_id: r.table_id for r in R.route_query(q, reg).collect()} == {1: "best", 2: None}


def test_knn_join_is_brute_force_in_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).round(3)
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").repartition(5)
    q = base.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, int(j)) for i in range(0, 300, 10) for j in sorted(range(300), key=lambda j: (-round(float(u[i] @ u[j]), 6), j))[:4]}
    for block in (4096, 7):
        assert {(r.query_id, r.id) for r in R.knn_join(q, base, 4, block=block).collect()} == want


def test_knn_join_takes_odd_input(spark):
    schema = "id long, vector array<double>, g string"
    base = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, [1.0, 0.0, 0.0], "a"), (4, None, "a"), (5, [0.0, 0.0], "a"), (None, [1.0, 0.0], "a"), (6, [1.0, 0.0], None)], schema)
    q = spark.createDataFrame([(7, [1.0, 0.1], "a"), (8, [0.0, 0.0, 1.0], "b"), (9, None, "a"), (10, [1.0, 0.0, 0.0], "a"), (11, [1.0, 0.0], "none")], "query_id long, vector array<double>, g string")
    for block in (100, 2):
        assert sorted((r.query_id, r.id, r["rank"]) for r in R.knn_join(q, base, 2, block=block).collect()) == [(7, 1, 1), (7, 6, 2), (8, 3, 1), (10, 3, 1), (11, 1, 1), (11, 6, 2)]
        assert sorted((r.query_id, r.id) for r in R.knn_join(q, base, 2, block=block, by="g").collect()) == [(7, 1), (7, 5), (10, 3)]
    assert R.knn_join(q.limit(0), base, 2).count() == 0 and R.knn_join(q, base.limit(0), 2).count() == 0
    named = R.knn_join(q.withColumn("query_id", F.col("query_id").cast("string")), base.withColumn("id", F.lit("x")), 1, by="g")
    assert named.schema["query_id"].dataType.typeName() == "string" and named.count() == 2
    reg = spark.createDataFrame([], "table_id string, vector array<double>")
    assert {r.table_id for r in R.route_query(q, reg).collect()} == {None}


def test_history_items_and_prompts(spark):
    rows = spark.createDataFrame([(1, (" a ", None)), (2, (None, "b")), (3, (None, None)), (4, None)], "i int, item struct<system:string,user:string>")
    assert [(r.i, r.role, r.text) for r in M.normalize_history(rows).orderBy("i").collect()] == [(1, "system", "a"), (2, "user", "b")]
    maps = spark.createDataFrame([(1, {"user": "x"}), (2, {"other": "y"})], "i int, item map<string,string>")
    assert [(r.i, r.role, r.text) for r in M.normalize_history(maps).collect()] == [(1, "user", "x")]
    prompts = spark.createDataFrame([("a\nb", ["s"], ["r", "t"]), ("", None, []), (None, ["s"], None)], "s string, l array<string>, r array<string>")
    assert [r.p for r in prompts.select(M.render_history(F.col("s"), F.col("l"), F.col("r")).alias("p")).collect()] == ["【a b】s【r, t】", "【】", "s【】"]


def test_memory_of_requests(spark):
    t = dt.datetime(2024, 1, 1)
    s = spark.createDataFrame([(1, t, "sum")], "session_id long, create_time timestamp, summary string")
    m = spark.createDataFrame([(1, 1, t + dt.timedelta(1), "user", "q")], "session_id long, seq long, ts timestamp, role string, content string")
    v = spark.createDataFrame([(1, "user", "near", [1.0, 0.0]), (2, "system", "far", [0.0, 1.0]), (3, "user", "other", [1.0])], "id long, role string, content string, vector array<double>")
    asked = spark.createDataFrame([(7, 1, [1.0, 0.1]), (8, 5, None)], "query_id long, session_id long, vector array<double>")
    got = {r.query_id: (r.recent, r.related, r.summary) for r in M.load_memory(asked, s, m, v, k=1).collect()}
    assert got == {7: (["user: q"], ["user: near"], "sum"), 8: ([], [], "")}


def test_long_texts_are_cut_to_the_nearest_chunks(spark):
    text = "\n".join([f"line{i} about cats " + "word " * 60 for i in range(12)] + ["the moon and the tide " * 40])
    docs = spark.createDataFrame([(1, "short ---- text"), (2, text), (3, None), (4, "")], "doc_id long, text string")
    got = R.gate_long_text(docs, "moon tide", k=1, longest=500).collect()
    assert sorted((r.doc_id, r.content) for r in got if r.doc_id != 2) == [(1, "short  text"), (4, "")]
    assert [("moon" in r.content, len(r.content) < len(text)) for r in got if r.doc_id == 2] == [(True, True)]


def test_links_are_resolved_as_browsers_do(spark):
    base = "http://h/a/b/c.html?x=1#y"
    cases = {"../x": "http://h/a/x", "./d": "http://h/a/b/d", "?q=1": "http://h/a/b/c.html?q=1", "../../../z": "http://h/z", "/p/./q/..": "http://h/p/", "//o/k": "http://o/k", "m.html": "http://h/a/b/m.html", "": base, "http://o/../a?b=../c": "http://o/a?b=../c", " e ": "http://h/a/b/e"}
    rows = spark.createDataFrame([(k, base) for k in cases], "h string, u string")
    assert {r.h: r.r for r in rows.select("h", T.resolve(F.col("h"), F.col("u")).alias("r")).collect()} == cases
    pages = spark.createDataFrame([(1, "http://h/a", "<a href='/s?a=1&amp;b=2'>x</a><A class=k HREF = /t>y</A><a href=\"/u\">z</a>")], "page_id long, url string, html string")
    assert [r.url for r in W.extract_links(pages).orderBy("link_no").collect()] == ["http://h/s?a=1&b=2", "http://h/t", "http://h/u"]
    assert one(spark, T.real_url, "//s.example/l/?uddg=%ZZ") == "https://s.example/l/?uddg=%ZZ"


def test_equal_times_hide_the_checkpoints_own_pair(spark):
    t = dt.datetime(2024, 1, 1)
    s = spark.createDataFrame([(1, t, "b"), (2, t, None)], "session_id long, create_time timestamp, brief string")
    m = spark.createDataFrame([(1, 0, t, "user", "a"), (1, 1, t, "system", "b"), (1, 2, t + dt.timedelta(1), "user", "c")], "session_id long, seq long, ts timestamp, role string, content string")
    got = {r.session_id: (r.n, r.messages) for r in M.recent_messages(s, m).collect()}
    assert got == {1: (1, ["user: c"]), 2: (0, [])}
    assert {r.session_id: r.n_late for r in M.late_messages(m, s).collect()} == {1: 2}


def replayed(n, threshold):
    out, count = [], 0
    for i in range(n):
        if i == 0 or count >= threshold:
            out.append(i)
            count = 0
        else:
            count += 2
    return out


def test_closed_form_of_checkpoints_is_the_row_by_row_rule(spark):
    rows = [(1, i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)) for i in range(60)]
    pairs = spark.createDataFrame(rows, "session_id long, pair_no long, ts timestamp")
    for threshold in (2, 3, 4, 7, 8):
        assert sorted(r.pair_no for r in M.replay_checkpoints(pairs, threshold).collect()) == replayed(60, threshold)


def test_upsert_twice_is_once(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    batch = spark.createDataFrame([(2, None), (3, "c")], "id long, v string")
    once = M.upsert(target, batch)
    assert sorted(map(tuple, M.upsert(once, batch).collect())) == sorted(map(tuple, once.collect())) == [(1, "a"), (2, None), (3, "c")]


def test_payloads_that_dont_fit_are_marked(spark):
    rows = ['{"session_id": "1", "message": {"user": "u", "system": "s"}}', '{"message": {"user": "u", "system": "s"}}', '{"session_id": "1", "message": "text"}', "not json", None]
    got = M.parse_payloads(spark.createDataFrame([(x,) for x in rows], "value string")).collect()
    assert [r.ok for r in got] == [True, False, False, False, False] and got[0].chat_type == "chat"


def test_each_id_gets_its_own_status(spark):
    reg = spark.createDataFrame([("a", "d_1", 4, dt.datetime(2024, 1, 1))], "table_id string, description string, dim int, registered_at timestamp")
    ids = spark.createDataFrame([("a",), ("b",)], "table_id string")
    left, _, status = G.delete(reg, ids, ids)
    assert left.count() == 0 and {r.table_id: r.status for r in status.collect()} == {"a": "success", "b": "no such id"}
    assert G.overview(reg.limit(0)).first().overview == "no collections"


def test_links_of_pages_that_arent_leaves(spark):
    text = "<article>" + "<p>" + "word " * 200 + "</article>"
    pages = spark.createDataFrame([(1, "http://h/a", '<a href="#x">t</a><a href="/b">b</a><a href="http://o/c">c</a><a href="mailto:x">m</a>'), (2, "http://h/b", text), (3, "http://o/c", text)], "page_id long, url string, html string")
    assert [r.url for r in W.extract_links(pages).where("page_id = 1").orderBy("link_no").collect()] == ["http://h/b", "http://o/c"]
    found = W.expand_links(spark.createDataFrame([(7, 1, "http://h/a")], "query_id long, rank long, url string"), pages)
    assert [(r.query_id, r.sub, r.url) for r in found.collect()] == [(7, 1, "http://h/b")]


REGION = "doc_id long, page_number int, region_no int, type string, score double, x0 double, x1 double, top double, bottom double"


def test_suppression_leaves_no_overlapping_pair(spark):
    rng = np.random.default_rng(2)
    rows = [(1, 1, i, "text", float(s), float(x), float(x + 30), float(y), float(y + 30)) for i, (x, y, s) in enumerate(rng.uniform(0, 100, (60, 3)))]
    kept = D.suppress(spark.createDataFrame(rows, REGION), 0.45).toPandas()
    for i in range(len(kept)):
        both, area = D.overlaps(kept, i), D.areas(kept)
        assert ((both / (area + area[i] - both))[np.arange(len(kept)) != i] <= 0.45).all()
    assert len(kept) < 60


def test_clean_regions_keeps_the_better_of_two(spark):
    rows = [(1, 1, 0, "text", 0.5, 0.0, 10.0, 0.0, 10.0), (1, 1, 1, "text", 0.9, 0.0, 10.0, 1.0, 11.0), (1, 1, 2, "table", 0.1, 0.0, 10.0, 2.0, 12.0)]
    assert sorted(r.region_no for r in D.clean_regions(spark.createDataFrame(rows, REGION)).collect()) == [1, 2]


BOX = "doc_id long, page_number int, box_no long, x0 double, x1 double, top double, bottom double, text string, layout_type string, layoutno string"


def box(n, x0, x1, top, text, page=1, no="text-0", kind="text"):
    return (1, page, n, float(x0), float(x1), float(top), float(top + 10), text, kind, no)


def test_lines_paragraphs_and_bullets_merge(spark):
    rows = spark.createDataFrame([box(0, 0, 10, 0, "a"), box(1, 10, 20, 1, "b"), box(2, 0, 200, 14, "c."), box(3, 0, 200, 28, "D")], BOX)
    lines = D.merge_lines(rows)
    assert [r.text for r in lines.orderBy("top").collect()] == ["ab", "c.", "D"]
    assert [r.text for r in D.merge_paragraphs(lines.withColumn("is_english", F.lit(True))).orderBy("top").collect()] == ["ab c.", "D"]
    assert [r.text for r in D.merge_paragraphs(lines).orderBy("top").collect()] == ["ab c. D"]
    two = [box(2 * i + k, 50 + 300 * k, 250 + 300 * k, 14 * i, f"{'left' if k == 0 else 'RIGHT'} {i},") for i in range(4) for k in range(2)]
    pages = spark.createDataFrame(two, BOX)
    assert sorted(r.text for r in D.merge_paragraphs(pages).collect()) == ["RIGHT 0, RIGHT 1, RIGHT 2, RIGHT 3,", "left 0, left 1, left 2, left 3,"]
    assert D.merge_lines(pages).count() == 8 and D.merge_lines(spark.createDataFrame([box(0, 0, 10, 0, "a", no=""), box(1, 10, 20, 1, "b", no="")], BOX)).count() == 2
    ended = spark.createDataFrame([(*box(0, 0, 20, 0, "Ends."), True), (*box(1, 0, 20, 12, "Next"), True), (*box(2, 0, 20, 24, None), True)], BOX + ", is_english boolean")
    assert D.merge_paragraphs(ended).count() == 2
    bullets = spark.createDataFrame([box(0, 0, 9, 0, "• a"), box(1, 0, 9, 12, "• b"), box(2, 0, 9, 24, "x"), box(3, 0, 9, 36, " ")], BOX)
    assert [r.text for r in D.merge_bullets(bullets).orderBy("top").collect()] == ["• a\n• b", "x"]


def test_columns_of_a_two_column_page(spark):
    rows = spark.createDataFrame([box(i, 50 + 300 * (i % 2) + i % 3, 200 + 300 * (i % 2), 20 * i, "t") for i in range(20)], BOX)
    assert {r.box_no % 2: r.col_id for r in D.assign_columns(rows).collect()} == {0: 0, 1: 1}


def test_contents_go(spark):
    texts = ["Intro", "Contents", " ", "1 One two", "2 Two", "1 One and so on", "text"]
    rows = spark.createDataFrame([box(i, 0, 10, 20 * i, t) for i, t in enumerate(texts)], BOX)
    assert [r.text for r in D.drop_contents(rows).orderBy("top").collect()] == ["Intro", "1 One and so on", "text"]
    texts = ["目 录", "第一章 甲", "2 Two", "第一章", "text"]
    rows = spark.createDataFrame([box(i, 0, 10, 20 * i, t) for i, t in enumerate(texts)], BOX)
    assert [r.text for r in D.drop_contents(rows).orderBy("top").collect()] == ["第一章", "text"]
    texts = ["Intro", "Contents", "1 One", "2 Two", "1 One", "text"]
    rows = spark.createDataFrame([box(i, 0, 10, 20 * i, t) for i, t in enumerate(texts)], BOX)
    assert [r.text for r in D.drop_contents(rows).orderBy("top").collect()] == ["Intro", "1 One", "text"]


def test_a_grid_from_cells(spark):
    rows = pd.DataFrame([(1, 0, r * 3 + c, 40.0 * c, 40.0 * c + 30, 20.0 * r, 20.0 * r + 15, False, "h" if r == 0 else str(r * c)) for r in range(5) for c in range(3)], columns=["doc_id", "table_no", "box_no", "x0", "x1", "top", "bottom", "is_header", "text"])
    got = D.table_grid(spark.createDataFrame(rows, "doc_id long, table_no int, box_no long, x0 double, x1 double, top double, bottom double, is_header boolean, text string")).collect()
    assert all((r.row_no, r.col_no) == divmod(r.box_no, 3) for r in got)
    assert all(r.is_header == (r.row_no == 0) for r in got)


def test_lone_cells_move_to_their_neighbours(spark):
    schema = "doc_id long, table_no int, box_no long, x0 double, x1 double, top double, bottom double, is_header boolean, text string"
    cell = lambda n, r, c, x, text="t", no=0: (1, no, n, x, x + 30.0, 20.0 * r, 20.0 * r + 15, False, text)
    # Column 1 has one cell, in a row without a cell in column 0: it goes there, as column 2 is farther.
    rows = [cell(i, i, 0, 0.0) for i in range(4)] + [cell(9, 4, 1, 35.0)] + [cell(10 + i, i, 2, 100.0) for i in range(5)]
    got = {r.box_no: (r.row_no, r.col_no) for r in D.table_grid(spark.createDataFrame(rows, schema)).collect()}
    assert got[9] == (4, 0) and got[10] == (0, 1)
    # A row of one cell between rows of four that lack it: it goes to the nearer, and rows move up.
    rows = [(1, 1, 10 * r + c, 40.0 * c, 40.0 * c + 30, t, t + 10, False, "t") for r, t in ((0, 0.0), (2, 60.0)) for c in range(4) if not (r == 0 and c == 1)] + [(1, 1, 99, 40.0, 70.0, 20.0, 30.0, False, "lone")]
    got = {r.box_no: (r.row_no, r.col_no) for r in D.table_grid(spark.createDataFrame(rows, schema)).collect()}
    assert got[99] == (0, 1) and got[20] == (1, 0)


def test_regions_without_scores_go_by_the_text_they_cover(spark):
    rows = [(1, 1, 0, "text", None, 0.0, 10.0, 0.0, 10.0), (1, 1, 1, "text", 0.9, 0.0, 10.0, 1.0, 11.0)]
    boxes = spark.createDataFrame([box(0, 0, 10, 0, "a")], BOX).withColumn("bottom", F.lit(5.0))
    regions = spark.createDataFrame(rows, REGION)
    assert [r.region_no for r in D.clean_regions(regions, boxes).collect()] == [0]
    assert [r.region_no for r in D.clean_regions(regions).collect()] == [1]


def test_page_heights_without_characters_are_those_of_boxes(spark):
    pages = spark.createDataFrame([(1, 1, 600.0), (1, 2, 600.0)], "doc_id long, page_number int, page_height double")
    chars = spark.createDataFrame([(1, 1, 7.0, 5.0)], "doc_id long, page_number int, height double, width double")
    boxes = spark.createDataFrame([box(0, 0, 10, 0, "a", page=2), box(1, 0, 10, 0, " ", page=2)], BOX)
    assert [(r.mean_height, r.mean_width, r.cum) for r in L.page_stats(chars, pages, boxes).orderBy("page_number").collect()] == [(7.0, 5.0, 0.0), (10.0, 8.0, 600.0)]


def test_cell_types(spark):
    cases = {"2024年3月": "Dt", "2024-01-05": "Dt", "3,000.5": "Nu", "ABC-1": "Ca", "abc def": "En", "12kg": "NE", "中": "Sg", "第1234567890": "Nr", "": "Ot", "2020": "Nu", "2020-05": "Dt", "1/2": "Nu", "2024A": "Dt", "2024年1季度": "Dt", " 2020年 ": "Dt", "$1,234.56": "Nr", "第2季度": "Dt", "3月5日": "Dt", "One, two, three and four!": "Tx"}
    rows = spark.createDataFrame([(k,) for k in cases], "text string").withColumn("kind", L.cell_type(F.col("text")))
    assert {r.text: r.kind for r in rows.collect()} == cases


def test_native_operators_have_no_python_and_no_cartesian_product(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for df in (C.title_paths(B.line_blocks(docs)), C.effective_min(B.line_blocks(docs)), B.html_blocks(pages), W.extract_links(pages), W.page_text(pages), W.leaf_flags(pages)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoop"))
