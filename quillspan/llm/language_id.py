"""Language ID by string kernels: the blended-spectrum presence kernel of byte n-grams,
Nyström landmarks and one-versus-rest kernel ridge regression.

A text is the set of its distinct n-grams of one to three UTF-8 bytes (A-Z lower-cased),
as bits of a hashed row; the kernel of two texts is the size of the common part over the
root of both sizes. The model is fit on a bounded sample of the labelled documents,
``FIT_ROWS``, drawn evenly over the languages by a hash, of which there may be ``LANGUAGES``; landmarks are dealt to them in
turn. The driver holds only their bits. Every document is scored over its whole text: a batch's rows
times the landmarks times the regression's weights."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm import words
from quillspan.llm.scratch import Scratch, unused

BUCKETS, ORDER = 1 << 14, 3
FIT_ROWS, LANDMARKS, RIDGE = 2_000, 256, 0.1
#: Of each language about so many rows are learned from at least, or all it has, however many languages there are.
LEAST_ROWS = 16
#: So many languages are learned at most, the most frequent ones: with ``LEAST_ROWS`` this bounds what the driver holds.
LANGUAGES = 512
#: A document whose best language has no more than this score is rejected by the pipeline's stage.
REJECT = 0.3
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def presence(data: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
    """Set the bits of each text's n-grams in its row of ``out``."""
    low = words.LOWER[data].astype(np.uint32)
    grams, key = [], np.zeros(len(low), np.uint32)
    for n in range(1, ORDER + 1):
        key = key[: len(low) - n + 1] * np.uint32(257) + low[n - 1 :] + np.uint32(n)
        grams.append((key * np.uint32(2654435769)) >> np.uint32(18))
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for n, g in enumerate(grams):
            out[i, g[a : max(a, b - n)]] = 1


def rows_of(column: pa.Array, batch: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """Number of the first text and the presence rows, for up to ``batch`` texts at a time."""
    data, offsets = words.utf8(column)
    for first in range(0, len(offsets) - 1, batch):
        own = offsets[first : first + batch + 1]
        out = np.zeros((len(own) - 1, BUCKETS), np.float32)
        for a, b in words.chunks(own):
            part = own[a : b + 1]
            presence(data[part[0] : part[-1]], part - part[0], out[a:b])
        yield first, out


def has_letter(text: str | None) -> bool:
    return text is not None and any(m[0].isalpha() or any(map(str.isalpha, m[0])) for m in LETTERS.finditer(text))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


@dataclass
class Model:
    """Landmarks (rows of bits) and the weight of each landmark for each language."""

    languages: list[str]
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray

    def decide(self, rows: np.ndarray) -> np.ndarray:
        return kernel(rows, self.landmarks, self.sizes) @ self.weights


def kernel(rows: np.ndarray, landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    own = np.sqrt(np.maximum(rows.sum(axis=1), 1))
    return (rows @ landmarks.T) / (own[:, None] * sizes[None, :])


def solve(rows: np.ndarray, labels: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on Nyström features, one language (1) against the rest (0): text
    unlike every landmark has kernels near 0, and so a decision near 0 for each language."""
    marks = rows[:landmarks].astype(np.float32)
    sizes = np.sqrt(np.maximum(marks.sum(axis=1), 1))
    values, vectors = np.linalg.eigh(kernel(marks, marks, sizes).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = np.concatenate([kernel(rows[i : i + 1024].astype(np.float32), marks, sizes) @ root for i in range(0, len(rows), 1024)])
    goal = np.where(labels[:, None] == np.arange(len(languages)), 1.0, 0.0)
    beta = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ goal)
    return Model(languages, marks, sizes.astype(np.float32), (root @ beta).astype(np.float32))


def fit(docs: DataFrame, scratch: Scratch, folds: int = 4, fold: int = 2, rows: int = FIT_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on about ``rows`` labelled documents outside the held-out fold; None if there are none. Of more than ``LANGUAGES`` labels the
    most frequent are learned, ties by name; documents of others get the learned label they are most like, or a low score."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), folds, fold)).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    counts = scratch.keep(known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES), "langs")
    quota = max(rows / max(1, counts.count()), LEAST_ROWS)
    place = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = known.join(counts, "lang").withColumn("place", place).where(F.col("place") * F.col("n") < quota).select("doc_id", "text", "lang", "place")

    def bits(batches):
        for batch in batches:
            ok = [has_letter(t) for t in batch.column("text").to_pylist()]
            rows = [x for _, part in rows_of(batch.column("text")) for x in np.packbits(part.astype(bool), axis=1)]
            some = batch.filter(pa.array(ok, pa.bool_()))
            own = pa.array([r.tobytes() for r, y in zip(rows, ok, strict=True) if y], pa.binary())
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("lang"), some.column("place"), own], names=["doc_id", "lang", "place", "bits"])

    got = sorted(chosen.mapInArrow(bits, "doc_id long, lang string, place double, bits binary").collect(), key=lambda r: (r.place, r.doc_id, r.bits))
    if not got:
        return None
    # Landmarks are the first rows: languages take turns.
    turn = Counter()
    turns = [turn.update([r.lang]) or turn[r.lang] for r in got]
    got = [r for _, r in sorted(zip(turns, got, strict=True), key=lambda x: x[0])]
    languages = sorted({r.lang for r in got})
    grid = np.unpackbits(np.frombuffer(b"".join(r.bits for r in got), np.uint8).reshape(len(got), -1), axis=1)
    return solve(grid, np.array([languages.index(r.lang) for r in got]), languages, landmarks)


def predict(docs: DataFrame, model: Model | None, *keep: str, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score (0 to 1, near 0 for text unlike any learned),
    called ``names``, which aren't among them.

    Text that is null or has no letter is ``und`` with score 0; so is any text if there was
    nothing to learn from. Neither lang nor source nor doc_id is looked at."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    spread = docs.sparkSession.sparkContext.broadcast(model)
    columns, source = [*keep], unused(docs, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = spread.value
        for batch in batches:
            texts = batch.column(source)
            ok = np.array([has_letter(t) for t in texts.to_pylist()], bool)
            best, score = np.full(len(ok), UNKNOWN, object), np.zeros(len(ok))
            if m is not None:
                for first, rows in rows_of(texts):
                    value = m.decide(rows)
                    top = value.argmax(axis=1)
                    own = slice(first, first + len(rows))
                    best[own] = np.array(m.languages, object)[top]
                    score[own] = np.clip(value[np.arange(len(top)), top], 0, 1)
                best[~ok], score[~ok] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(best.tolist(), pa.string()), pa.array(score)], names=[*columns, *names])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in columns), f"`{names[0]}` string", f"`{names[1]}` double"])
    return docs.select(*columns, F.col("text").cast("string").alias(source)).mapInArrow(run, schema)


def identify(docs: DataFrame, scratch: Scratch, folds: int = 4, fold: int = 2, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang, ...).

    A null doc_id is not held out and not learned from; rows that repeat one are scored
    alike for equal texts. An empty table gives an empty table."""
    rows = docs.withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
    return predict(rows, fit(docs, scratch, folds, fold, **options), "doc_id", "held_out")


def keep_known(docs: DataFrame, scratch: Scratch, reject: float = REJECT, **options) -> DataFrame:
    """``docs`` without the rows that get no language, or one with a score up to ``reject``. All columns stay, whatever they are called.

    Null and empty texts and those without a letter go; a null doc_id or lang is no reason to go. Repeated rows go or stay
    together. With nothing to learn from every row goes. An empty table gives an empty one."""
    names = unused(docs, "lang_pred"), unused(docs, "score")
    judged = predict(docs, fit(docs, scratch, **options), *docs.columns, names=names)
    return judged.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) > reject)).select(*docs.columns)
