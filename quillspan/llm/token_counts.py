"""Token counts of whole texts with a cache of what was counted before.

The cache is a table in a folder: for each tokenizer version (the SHA-256 of its file) the digest of a
normalised content and its count. A run joins digests, which are short, to the cache; only distinct contents
that it lacks are encoded, and their counts are appended. A content is normalised no further than the tokenizer
itself would, so that texts with one digest have one count.

Scale: copies of a content meet in the tasks that read them, before anything is shuffled, so a hot one costs no
more than others. Where few contents are missing they are broadcast by Spark, below the grouping,
and no text is shuffled; where many are, each distinct one is shuffled once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import words
from quillspan.llm.scratch import Scratch
from quillspan.llm.token_blocks import UNITS, _encoder

PIECE = 4 << 20
CACHE = "digest binary, n_tokens long"
#: Counters that a Python worker has made, by path.
_made: dict[str, Callable[[list[str]], list[int]]] = {}


def version_of(tokenizer: str) -> str:
    return hashlib.sha256(Path(tokenizer).read_bytes()).hexdigest()


def _described(tokenizer: str) -> dict:
    """A ``.json`` tokenizer's parts but for its vocabulary; nothing for other kinds."""
    return {k: v for k, v in json.loads(Path(tokenizer).read_text()).items() if k != "model"} if tokenizer.endswith(".json") else {}


def normaliser(tokenizer: str) -> Callable[[Column], Column]:
    """What of a text its count depends on: null is empty. A tokenizer that lower-cases texts and puts white space together
    counts texts of ASCII characters alike whatever their case and white space, unless they hold one of its special strings."""
    own = _described(tokenizer)
    steps = own.get("normalizer") or {}
    steps = steps.get("normalizers", [steps] if steps else [])
    kinds = {x["type"] for x in steps}
    space = any(x["type"] == "Replace" and x.get("pattern") == {"Regex": "\\s+"} and x.get("content") == " " for x in steps)
    special = [x["content"].lower() for x in own.get("added_tokens", [])]

    def form(text: Column) -> Column:
        text = F.coalesce(text, F.lit(""))
        if "Lowercase" not in kinds or not space or kinds - {"NFC", "NFD", "NFKC", "NFKD", "Replace", "Lowercase"}:
            return text
        plain = text.rlike(r"^[\x00-\x7F]*$")
        for s in special:
            plain &= ~F.contains(F.lower(text), F.lit(s))
        return F.when(plain, F.lower(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))).otherwise(text)

    return form


def _plain_counter(tokenizer: str) -> Callable[[list[str]], list[int]]:
    if tokenizer not in _made:
        if tokenizer.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(tokenizer)
            t.no_truncation()
            t.no_padding()
            _made[tokenizer] = lambda texts: [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            from sentencepiece import SentencePieceProcessor

            s = SentencePieceProcessor(model_file=tokenizer)
            _made[tokenizer] = lambda texts: [len(x) for x in s.encode(texts, num_threads=1)]
    return _made[tokenizer]


def unit_wise(tokenizer: str) -> bool:
    """Whether texts may be encoded unit by unit (:class:`quillspan.llm.token_blocks.CachedEncoder`)."""
    own = _described(tokenizer)
    before = own.get("pre_tokenizer") or {}
    bytewise = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    return bool(own) and bytewise and not any(own.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))


def _counter(tokenizer: str, units: int):
    by_unit = unit_wise(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.utf8(batch.column("text"))
            counts = [np.zeros(0, np.int64)]
            for a, b in words.chunks(offsets, PIECE):
                own = offsets[a : b + 1]
                piece = data[own[0] : own[-1]]
                if by_unit:
                    counts.append(_encoder(tokenizer, units).encode_all(piece, own - own[0])[1])
                else:
                    at = (own - own[0]).tolist()
                    counts.append(np.array(_plain_counter(tokenizer)([piece[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(at[:-1], at[1:], strict=True)]), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(np.concatenate(counts).astype(np.int64))], names=["digest", "n_tokens"])

    return run


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of a tokenizer version, one row a digest whoever appended it; none where there is no such folder yet."""
    try:
        rows = spark.read.schema(CACHE).parquet(f"{cache}/version={version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, scratch: Scratch, units: int = UNITS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs`` (doc_id, text, ...), by the library of ``tokenizer``: tokenizers for
    ``.json``, sentencepiece for ``.model``; without begin, end or added special tokens, truncation or padding.

    ``cache`` is a folder that all executors share; what it lacks is appended before the counts are given out. A null or empty text
    has 0 bytes and the count of an empty one. Repeated rows and null doc_ids have their rows; equal texts are encoded
    once. A very long text is encoded whole. Other columns are ignored. An empty table gives an empty one."""
    spark, version = docs.sparkSession, version_of(tokenizer)
    text, form = F.coalesce(F.col("text").cast("string"), F.lit("")), normaliser(tokenizer)
    digest = F.unhex(F.sha2(form(text), 256)).alias("digest")
    short = scratch.keep(docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), digest), "digests")
    missing = scratch.keep(short.select("digest").distinct().join(stored(spark, cache, version), "digest", "left_anti"), "missing")
    texts = docs.select(digest, text.alias("text")).groupBy("digest").agg(F.first("text").alias("text")).join(missing, "digest", "left_semi")
    texts.select("digest", "text").mapInArrow(_counter(tokenizer, units), CACHE).write.mode("append").parquet(f"{cache}/version={version}")
    return short.join(stored(spark, cache, version), "digest").select("doc_id", "n_bytes", "n_tokens")
