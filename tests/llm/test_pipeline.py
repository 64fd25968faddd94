import corpus_pipeline
from quillspan.llm import decontaminate, mixing, near_dedup
from quillspan.llm.queries import token_digest
from quillspan.llm.scratch import Scratch


def test_stages_are_what_their_operators_say(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, seen = Scratch(spark, "t"), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch.keep(stage(spark, seen, sf_dir), name)
        assert out.columns == docs.columns
        ids, before = [r.doc_id for r in out.collect()], {r.doc_id for r in seen.collect()}
        assert set(ids) <= before
        if name == "near_dedup":
            want = {r.doc_id for r in near_dedup.near_duplicates(seen, Scratch(spark, "t")).where("kept").collect()}
            assert sorted(ids) == sorted(want) and len(want) < len(before)
        elif name == "decontaminate":
            bad = {r.doc_id for r in decontaminate.contaminated(seen, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark, "t")).collect()}
            assert sorted(ids) == sorted(before - bad) and bad & before
        elif name == "mix_sources":
            copies = {r.doc_id: r.copies for r in mixing.mix(seen, Scratch(spark, "t")).collect()}
            assert sorted(ids) == sorted(d for d, n in copies.items() for _ in range(n))
        seen = out
    want = sorted(map(tuple, token_digest(spark, seen, "t").select("doc_id", "n_tokens", "ids_crc32").collect()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want
    assert len(want) > 50


def test_odd_rows_pass_through(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = [(None, "some words of a text here", "en", None, 5), (1, None, None, "s", None), (2, "", "en", "s", 0), (3, "a text with a few words", "en", "s", 1), (3, "a text with a few words", "en", "s", 1), (4, "text " * 40_000, "en", None, 1)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark, "t").keep(stage(spark, docs, sf_dir), "x")
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark, "t").keep(stage(spark, docs, sf_dir), "x")
    assert docs.count() == 0
