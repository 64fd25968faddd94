import public_tokenizers
import pytest

from quillspan.llm import token_counts as C
from quillspan.llm.queries import QUERIES
from quillspan.llm.scratch import Scratch

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, n_bytes string, digest string, n_tokens string"
TEXTS = ["", None, "a", "Hello,  World!\n\n it's 2024", "HELLO, world! it's 2024", "<|endoftext|> x <|endoftext|>", "<|ENDOFTEXT|> x", "naïve Ångström 中文 \U0001f600", " \t\n ", "x" * 5000, "word " * 30_000]


def plain(tokenizer: str, text: str | None) -> int:
    if tokenizer.endswith(".json"):
        from tokenizers import Tokenizer

        return len(Tokenizer.from_file(tokenizer).encode(text or "", add_special_tokens=False).ids)
    from sentencepiece import SentencePieceProcessor

    return len(SentencePieceProcessor(model_file=tokenizer).encode(text or ""))


@pytest.mark.parametrize("tokenizer", (BYTES, WORDS, PIECES))
def test_counts_are_the_librarys(spark, tmp_path, tokenizer):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None, None), (3, TEXTS[3], None, None, None), (None, "a", None, None, None)]
    scratch = Scratch(spark, "t")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in C.count_tokens(spark.createDataFrame(rows, DOCS), tokenizer, str(tmp_path / "cache"), scratch).collect()), key=str)
    assert got == sorted(((r[0], len((r[1] or "").encode()), plain(tokenizer, r[1])) for r in rows), key=str)


def test_only_misses_are_encoded(spark, tmp_path):
    cache = str(tmp_path / "cache")
    encoded = lambda: spark.read.parquet(f"{cache}/version={C.version_of(BYTES)}").count()
    docs = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    count = lambda df, tokenizer=BYTES: {r.doc_id: r.n_tokens for r in C.count_tokens(df, tokenizer, cache, Scratch(spark, "t")).collect()}
    count(docs("one two", "one two", "three", None, ""))
    assert encoded() == 3
    assert count(docs("three", "four", "one two", "four")) == {0: 1, 1: 1, 2: 2, 3: 1}
    assert encoded() == 4
    # What is stored is taken as it is, and another tokenizer has counts of its own.
    spark.createDataFrame([("five", 99)], "t string, n_tokens long").selectExpr("unhex(sha2(t, 256)) as digest", "n_tokens").write.mode("append").parquet(f"{cache}/version={C.version_of(BYTES)}")
    assert count(docs("five")) == {0: 99}
    assert count(docs("five"), WORDS) == {0: 1}


def test_contents_are_normalised_as_the_tokenizer_does(spark, tmp_path):
    own = C.normaliser(WORDS)
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in ("A  b\nC", "a b c", "<|ENDOFTEXT|> A", "Å  B", None)], "t string")
    assert [r.x for r in df.select(own(F.col("t")).alias("x")).collect()] == ["a b c", "a b c", "<|ENDOFTEXT|> A", "Å  B", ""]
    assert [r.x for r in df.select(C.normaliser(BYTES)(F.col("t")).alias("x")).collect()][0] == "A  b\nC"
    assert C.unit_wise(BYTES) and not C.unit_wise(WORDS) and not C.unit_wise(PIECES)


def test_two_runs_that_append_one_digest_count_it_once(spark, tmp_path):
    cache, docs = str(tmp_path / "cache"), spark.createDataFrame([(1, "again")], "doc_id long, text string")
    C.count_tokens(docs, BYTES, cache, Scratch(spark, "t")).collect()
    path = f"{cache}/version={C.version_of(BYTES)}"
    spark.read.parquet(path).write.mode("append").parquet(path)
    assert C.count_tokens(docs, BYTES, cache, Scratch(spark, "t")).count() == 1


def test_empty_table(spark, tmp_path):
    got = C.count_tokens(spark.createDataFrame([], "doc_id long, text string"), BYTES, str(tmp_path / "cache"), Scratch(spark, "t"))
    assert got.collect() == [] and got.columns == ["doc_id", "n_bytes", "n_tokens"]


def test_query(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {(r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in docs}
    got = QUERIES["op11_token_counts"](spark, sf_dir).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in got} == want and len(got) == len(docs)
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
