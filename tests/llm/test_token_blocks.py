import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspan.llm import token_blocks
from quillspan.llm.queries import QUERIES, token_digest

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain(rows):
    """doc_id, start, count and checksum of (doc_id, text) in order."""
    out, start = [], 0
    for d, text in rows:
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 60), max_size=300), max_size=6), st.integers(50, 100))
def test_a_shard_gives_back_its_ids(docs, percentile):
    ids = np.array([x for d in docs for x in d], np.uint32)
    shard = token_blocks.Shard(token_blocks.encode_shard(ids, [None, *range(1, len(docs))][: len(docs)], [len(d) for d in docs], percentile))
    assert (shard.ids() == ids).all()
    assert shard.doc_ids == [None, *range(1, len(docs))][: len(docs)]
    assert shard.lengths.tolist() == [len(d) for d in docs]
    for first in range(0, len(ids), 97):
        assert (shard.ids(first, first + 50) == ids[first : first + 50]).all()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sZ 1²_.,!\n\t\r\u00a0\u2028\x1c\x85éßж中<|>")))
def test_cached_units_are_the_tokenizers(text):
    encoder = token_blocks.CachedEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_special_token_text_is_as_the_tokenizer_takes_it():
    encoder = token_blocks.CachedEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = "a<|endoftext|> b"
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_query_is_the_plain_encoding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = QUERIES["op1_token_blocks"](spark, sf_dir).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == plain([(r.doc_id, r.text) for r in docs])


def test_nulls_long_texts_ties_and_other_columns(spark):
    rows = [(3, "c"), (1, None), (None, "x y"), (2, ""), (5, "word " * 200_000), (4, "d"), (4, "d")]
    docs = spark.createDataFrame([(*r, "p", 7) for r in rows], "doc_id long, text string, part string, n_ids int").repartition(3)
    got = token_digest(spark, docs, "t").orderBy("start").collect()
    order = [rows[2], rows[1], rows[3], rows[0], rows[5], rows[6], rows[4]]
    assert [tuple(r) for r in got] == plain(order)


def test_empty_table(spark):
    assert token_digest(spark, spark.createDataFrame([], "doc_id long, text string"), "t").count() == 0


def test_garbage_is_refused():
    with pytest.raises(ValueError):
        token_blocks.Shard(b"\0" * 40)
