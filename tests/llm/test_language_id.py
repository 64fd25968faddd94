import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspan.llm import language_id
from quillspan.llm.queries import QUERIES
from quillspan.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string"


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op8_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98


def grams(text):
    data = "".join(c.lower() if c.isascii() else c for c in text).encode()
    return {data[i : i + n] for n in (1, 2, 3) for i in range(len(data) - n + 1)}


def test_kernel_is_that_of_the_sets():
    texts = ["Hello there", "hello", "Où êtes-vous", ""]
    rows = np.zeros((4, language_id.BUCKETS), np.float32)
    from quillspan.llm import words

    data, offsets = words.utf8(__import__("pyarrow").array(texts))
    language_id.presence(data, offsets, rows)
    sizes = np.sqrt(np.maximum(rows.sum(axis=1), 1))
    got = language_id.kernel(rows, rows, sizes)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            want = len(grams(a) & grams(b)) / max(1, len(grams(a)) * len(grams(b))) ** 0.5
            assert abs(got[i, j] - want) < 0.06


def test_letters():
    assert [language_id.has_letter(t) for t in (None, "", "123 ²½ _-", "ж", "中", "1a")] == [False, False, False, True, True, True]


def test_nulls_odd_texts_and_clashing_columns(spark):
    rows = [(i, ("the quick brown fox of the house " if i % 2 else "der schnelle braune Fuchs und das Haus ") * (i % 5 + 1), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !!", "en"), (103, "Haus " * 60_000, None), (None, "the house of the fox", "de"), (3, "the quick", "en"), (3, "the quick", "en")]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], DOCS + ", lang_pred string, score double").repartition(3)
    got = language_id.identify(docs, Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (100, 101, 102))
    assert by[103].lang_pred == "de" and by[None].lang_pred == "en" and by[None].held_out is False
    odd = docs.withColumns({"_text": F.lit(7), "Score_": F.lit("y")})
    kept = language_id.keep_known(odd, Scratch(spark, "t"))
    assert kept.columns == odd.columns
    left = kept.collect()
    assert {100, 101, 102}.isdisjoint({r.doc_id for r in left})
    assert {(r.lang_pred, r.score, r["_text"], r["Score_"]) for r in left} == {("x", 0.5, 7, "y")}


def test_nothing_to_learn_from_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "text", None)], DOCS)
    assert language_id.identify(docs, Scratch(spark, "t")).first().lang_pred == "und"
    assert language_id.identify(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_text_of_no_learned_language_is_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").where("length(text) > 200")
    odd = [(-1, "съешь же ещё этих мягких французских булок да выпей чаю " * 20, None), (-2, "ξεσκεπάζω την ψυχοφθόρα βδελυγμία", None), (-3, "天地玄黃宇宙洪荒日月盈昃辰宿列張", None), (-4, "x9q zk7 qqx0 9jz kx3 " * 9, None)]
    kept = {r.doc_id for r in language_id.keep_known(docs.unionByName(spark.createDataFrame(odd, DOCS)), Scratch(spark, "t")).collect()}
    assert kept.isdisjoint({d for d, *_ in odd})
    clean = {r.doc_id for r in docs.collect()}
    assert len(kept & clean) > 0.97 * len(clean)


def test_rare_languages_have_landmarks_and_rows(spark):
    rare = "съешь же ещё этих мягких французских булок "
    rows = [(i, f"the quick brown fox {i} of the house", "en") for i in range(4000)] + [(5000 + i, rare * (i + 1), "ru") for i in range(6)]
    model = language_id.fit(spark.createDataFrame(rows, DOCS), Scratch(spark, "t"), landmarks=16)
    own = sum(zlib.crc32(str(5000 + i).encode()) % 4 != 2 for i in range(6))
    bits = next(language_id.rows_of(pa.array([rare])))[1]
    assert (language_id.kernel(bits, model.landmarks, model.sizes)[0] > 0.8).sum() == own
    many = [(i, f"text{i} of{i}", f"l{i}") for i in range(300)]
    learned = {f"l{i}" for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(language_id.fit(spark.createDataFrame(many, DOCS), Scratch(spark, "t"), rows=20).languages) == learned


def test_so_many_languages_are_learned_at_most(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 5)
    rows = [(i, f"{'abcdefghijklmnop'[i % 12] * 4} {i % 12} text", f"l{i % 12:02}") for i in range(300)] + [(1000 + i, "more of one", "zz") for i in range(200)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), Scratch(spark, "t"))
    assert len(model.languages) == 5 and "zz" in model.languages
