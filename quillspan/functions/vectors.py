"""Vector expressions, and the embedding hook."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIM = 256
_WORD = re.compile(r"[^\W_]+")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(a: Column) -> Column:
    """v / (|v| + 1e-8), in doubles."""
    n = norm(a) + F.lit(1e-8)
    return F.transform(a, lambda x: x.cast("double") / n)


@lru_cache(maxsize=200_000)
def bucket(word: str, dim: int = DIM) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim


def hash_embed(texts: pd.Series, dim: int = DIM) -> np.ndarray:
    """Rows of unit length: counts of lower-cased words by a hash, each distinct word of a batch hashed once."""
    out = np.zeros((len(texts), dim))
    found = [_WORD.findall((text or "").lower()) for text in texts]
    codes, distinct = pd.factorize(np.array([w for own in found for w in own], object))
    if len(distinct):
        place = np.array([bucket(w, dim) for w in distinct])[codes]
        np.add.at(out, (np.repeat(np.arange(len(found)), [len(own) for own in found]), place), 1)
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(size > 0, size, 1)


def word_weights(rows: DataFrame, text: str, *keys: str, dim: int = DIM) -> DataFrame:
    """(keys, bucket, weight): the places of :func:`hash_embed`'s vectors that aren't 0, all in the JVM. Keys name a row."""
    found = rows.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("_w"))
    place = (F.conv(F.substring(F.md5("_w"), 1, 8), 16, 10).cast("long") % dim).cast("int")
    counts = found.groupBy(*keys, place.alias("bucket")).agg(F.count("*").alias("_n"))
    whole = F.sqrt(F.sum((F.col("_n") * F.col("_n")).cast("double")).over(Window.partitionBy(*keys)))
    return counts.select(*keys, "bucket", (F.col("_n") / whole).alias("weight"))


Model = Callable[[pd.Series], np.ndarray]
#: Models and tokenizers that a Python worker has loaded, by the name of their hook.
_models: dict[str, Callable] = {}


def loaded(name: str, factory: Callable[[], Callable]) -> Callable:
    if name not in _models:
        _models[name] = factory()
    return _models[name]


@dataclass(frozen=True)
class Hook:
    """A model from outside: what loads it, called once in each Python worker, and how many texts it takes at once. Only the
    factory travels with a query, so a model may be as large as a worker's memory; hooks of one name share theirs."""

    name: str
    factory: Callable[[], Callable]
    batch: int = 256


def resolved(fn):
    """What a hook loads, in the worker that asks; any other function as it is."""
    return loaded(fn.name, fn.factory) if isinstance(fn, Hook) else fn


def token_counts(text: Column, tokens: Callable[[str], int] | Hook) -> Column:
    """Counts by a caller's tokenizer, with its special tokens: a function of one text, or a :class:`Hook` that loads one; a null text is empty."""

    @F.pandas_udf("int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = resolved(tokens)
        for texts in parts:
            yield texts.fillna("").map(count).astype("int32")

    return run(text)


def vectors_of(fn: Model | Hook, texts: list[str]) -> np.ndarray:
    """Vectors of a few texts, here and now."""
    return resolved(fn)(pd.Series(texts))


#: So many texts are given to a model that is no hook, and to a hook without a number of its own, at once.
BATCH = 256


def embed(text: Column, fn: Model | Hook = hash_embed) -> Column:
    """Vectors of a text column by any function of a batch of texts, or by a :class:`Hook`; a null text is empty. Vectors leave the
    worker a few hundred at a time, however many rows a batch of Arrow has."""
    step = fn.batch if isinstance(fn, Hook) else BATCH

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = resolved(fn)
        for texts in parts:
            for i in range(0, len(texts), step):
                yield pd.Series(list(model(texts.iloc[i : i + step].fillna(""))), dtype=object)

    return run(text)


def distances(parts: Column, fn: Model | Hook = hash_embed) -> Column:
    """Of each text of an array its cosine distance from the one before, null for the first. ``fn`` gives vectors of unit length."""
    step = fn.batch if isinstance(fn, Hook) else BATCH

    @F.pandas_udf("array<double>")
    def run(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = resolved(fn)
        for rows in lists:
            out, size = [], np.array([len(x) for x in rows], np.int64)
            texts = np.concatenate([np.zeros(0, object), *rows])
            far, last = np.empty(len(texts)), None
            for i in range(0, len(texts), step):
                v = np.asarray(model(pd.Series(texts[i : i + step])), float)
                before = v[:1] if last is None else last
                far[i : i + len(v)] = 1 - (v * np.concatenate([before, v[:-1]])).sum(axis=1)
                last = v[-1:]
            for a, n in zip((np.cumsum(size) - size).tolist(), size.tolist(), strict=True):
                out.append([None, *far[a + 1 : a + n].tolist()] if n else [])
            yield pd.Series(out, dtype=object)

    return run(parts)
