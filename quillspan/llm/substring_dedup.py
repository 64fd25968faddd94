"""Removal of bytes covered by a repeated string of ``LENGTH`` bytes.

The column-wise construction that was asked for inserts one symbol of every document a
round, so it has as many rounds as the longest document has bytes, each over the whole
transform on disk; with documents of 100,000 bytes that can't be done in bounded time (see the
README). What is built here is a sampled suffix order. Every window of LENGTH bytes chooses the
``gram`` bytes within it that have the least hash as its anchor; equal windows choose equal
anchors, so only anchors, one for some 50 bytes, are put in order, by range partitions.

1. Neighbouring windows with one anchor are a run. Runs are sorted by anchor and by the bytes
   they cover; a row is compared with its neighbours alone, and the ends of partitions with
   each other. An anchor that stands once rules its windows out; a run whose bytes stand
   twice is repeated as a whole.
2. The few runs left (their anchor is repeated, their bytes differ, as at the ends of a
   passage) are treated again with longer anchors, together with one run of each sort they
   may meet; at the last step an anchor is the window itself, so the result is exact up to
   collisions of 64-bit hashes.

Equal texts are told by a 128-bit hash and put in order once a task. No group is ever held: sorted rows
stream by, and a hot anchor is split over range partitions like any others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm import words
from quillspan.llm.scratch import Scratch

LENGTH, GRAMS = 200, (100, 160, 200)
PLACE = np.uint64((1 << 20) - 1)
#: Bytes that are treated at once; places within them fit PLACE.
STRETCH = 900_000
RUNS = "a long, r long, t1 long, t2 long, p long, s0 long, s1 long"
KEYS = ("a", "r", "t1", "t2", "p")
SORTED = f"{RUNS}, a_twice boolean, r_twice boolean, r_first boolean, edge int"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours, by doubling."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class Hashed:
    """Prefix sums of a stretch of bytes: the hash of any part of it in a few operations."""

    def __init__(self, data: np.ndarray):
        up, self.down = words.powers(len(data))
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.total[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return words.mix((self.total[last] - self.total[first]) * self.down[first])


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: the piece (of those that ``offsets`` part), its
    first and last window and the anchor's place in the piece, and the hashes of anchor and run."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < length:
        return none
    h = Hashed(data)
    x = words.mix((h.total[gram:] - h.total[:-gram]) * h.down[: len(data) - gram + 1])
    y = (x & ~PLACE) | np.arange(len(x), dtype=np.uint64)
    at = (sliding_min(y, length - gram + 1) & PLACE).astype(np.int64)
    piece = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    own = np.flatnonzero(np.arange(len(at)) + length <= offsets[1:][piece])
    if not len(own):
        return none
    p = at[own]
    new = np.ones(len(own), bool)
    new[1:] = (p[1:] != p[:-1]) | (own[1:] != own[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(own)) - 1
    s0, s1, a = own[first], own[last], p[first]
    region = words.mix(h.of(s0, s1 + length) + ((a - s0) * 1024 + (s1 - a + 512)).astype(np.uint64))
    i = piece[s0]
    return i, s0 - offsets[i], s1 - offsets[i], a - offsets[i], x[a], region


def stretches(pieces: list[tuple[int, int, int]], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """(number, start, end) of byte ranges, put together to about STRETCH bytes; longer
    ranges are cut so that each window lies in one part."""
    held, size = [], 0
    for n, start, end in pieces:
        while True:
            stop = min(end, start + STRETCH)
            if held and size + stop - start > STRETCH:
                yield held
                held, size = [], 0
            held.append((n, start, stop))
            size += stop - start
            if stop == end:
                break
            start = stop - length + 1
    if held:
        yield held


def run_rows(data: np.ndarray, pieces: list[tuple[int, int, int]], t1: np.ndarray, t2: np.ndarray, base: np.ndarray, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows of RUNS for byte ranges of ``data``; t1, t2 and the place in the text by number."""
    for part in stretches(pieces, length):
        number, start, end = (np.array(x, np.int64) for x in zip(*part, strict=True))
        bytes_ = data[start[0] : end[0]] if len(part) == 1 else np.concatenate([data[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)])
        i, s0, s1, p, a, r = runs(bytes_, np.concatenate([[0], np.cumsum(end - start)]), length, gram)
        n, move = number[i], start[i] - base[number[i]]
        arrays = [a.view(np.int64), r.view(np.int64), t1[n], t2[n], p + move, s0 + move, s1 + move]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["a", "r", "t1", "t2", "p", "s0", "s1"])


def first_runs(length: int, gram: int):
    """For mapInArrow over (t1, t2, text): runs of each distinct text of the task."""

    def go(batches):
        seen = set()
        for batch in words.sliced(batches, 2048):
            data, offsets = words.utf8(batch.column("text"))
            t1, t2 = batch.column("t1").to_numpy(), batch.column("t2").to_numpy()
            pieces = []
            for i, key in enumerate(zip(t1.tolist(), t2.tolist(), strict=True)):
                if offsets[i + 1] - offsets[i] >= length and key not in seen:
                    seen.add(key)
                    pieces.append((i, int(offsets[i]), int(offsets[i + 1])))
            yield from run_rows(data, pieces, t1, t2, offsets, length, gram)

    return go


def next_runs(length: int, gram: int):
    """For mapInArrow over (t1, t2, text, part: the windows to look at): their runs."""

    def go(batches):
        for batch in words.sliced(batches):
            data, offsets = words.utf8(batch.column("text"))
            pieces = [(i, int(offsets[i]) + x["s0"], int(offsets[i]) + x["s1"] + length) for i, part in enumerate(batch.column("part").to_pylist()) for x in part]
            yield from run_rows(data, pieces, batch.column("t1").to_numpy(), batch.column("t2").to_numpy(), offsets, length, gram)

    return go


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a sorted partition: whether a row's anchor, and its run, stand in a neighbouring row."""
    names = ["a", "r", "t1", "t2", "p", "s0", "s1"]
    held, a_before, r_before, begun = None, False, False, False

    def out(rows: list[np.ndarray], a_twice, r_twice, r_first, edge) -> pa.RecordBatch:
        keep = a_twice | (edge > 0)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (*rows, a_twice, r_twice, r_first, edge)], names=[*names, "a_twice", "r_twice", "r_first", "edge"])

    for batch in batches:
        rows = [batch.column(n).to_numpy() for n in names]
        if held is not None:
            rows = [np.concatenate([x, y]) for x, y in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        new = np.ones(len(rows[0]), bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in rows[:5]], axis=0)
        rows = [x[new] for x in rows]
        same_a = rows[0][1:] == rows[0][:-1]
        same_r = same_a & (rows[1][1:] == rows[1][:-1])
        a_twice, r_twice = (np.append(False, s) | np.append(s, False) for s in (same_a, same_r))
        r_first = np.append(True, ~same_r)
        a_twice[0], r_twice[0], r_first[0] = a_twice[0] | a_before, r_twice[0] | r_before, r_first[0] & (not r_before)
        edge = np.zeros(len(rows[0]), np.int32)
        edge[0] = int(not begun)
        held = [x[-1:] for x in rows]
        a_before, r_before = (bool(same_a[-1]), bool(same_r[-1])) if len(same_a) else (a_before, r_before)
        if len(rows[0]) > 1:
            begun = True
            yield out([x[:-1] for x in rows], a_twice[:-1], r_twice[:-1], r_first[:-1], edge[:-1])
    if held is not None:
        yield out(held, np.array([a_before]), np.array([r_before]), np.array([not r_before]), np.array([2 if begun else 3], np.int32))


def classify(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows of RUNS whose anchor is repeated, with r_twice and r_first. Reads ``rows`` twice."""
    ordered = rows.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
    marked = scratch.keep(ordered.mapInArrow(compare, SORTED), name)
    order = Window.orderBy(*KEYS)  # over the ends of partitions, two each
    near = lambda c, f: F.coalesce(f(c).over(order) == F.col(c), F.lit(False))
    ends = marked.where("edge > 0").withColumns({"_a0": near("a", F.lag), "_a1": near("a", F.lead), "_r0": near("r", F.lag), "_r1": near("r", F.lead)})
    ends = ends.withColumns({"r_twice": F.expr("r_twice or (_a0 and _r0) or (_a1 and _r1)"), "a_twice": F.expr("a_twice or _a0 or _a1")}).drop("_a0", "_a1", "_r0", "_r1")
    return marked.where("edge = 0").unionByName(ends.where("a_twice")).drop("edge")


def texts_of(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` without nulls and its 128-bit hash in t1 and t2."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text")})


def repeated(docs: DataFrame, scratch: Scratch, length: int = LENGTH, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """(t1, t2, whole, spans) for texts with repeated windows. ``whole``: the text stands in
    several rows and all of it is repeated; ``spans``: byte ranges, not merged."""
    rows = texts_of(docs)
    long_ = F.octet_length("text") >= length
    copies = rows.where(long_).groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("d"))
    copies = scratch.keep(copies, "copies")
    now = scratch.keep(rows.where(long_).select("t1", "t2", "text").mapInArrow(first_runs(length, grams[0]), RUNS), f"runs{grams[0]}")
    done, texts = [], None
    for gram, longer in zip(grams, [*grams[1:], None], strict=True):
        marked = classify(now, scratch, f"marked{gram}")
        done.append(marked.where("r_twice").select("t1", "t2", F.struct(F.col("s0"), (F.col("s1") + length).alias("s1")).alias("span")))
        if longer is None:
            break
        left = marked.where("not r_twice")
        known = marked.where("r_twice and r_first").join(left.select("a").distinct(), "a", "left_semi")
        look = left.select("t1", "t2", "s0", "s1").unionByName(known.select("t1", "t2", "s0", "s1"))
        look = scratch.keep(look.groupBy("t1", "t2").agg(F.collect_list(F.struct("s0", "s1")).alias("part")), f"look{longer}")
        if texts is None:
            wanted = look.select("t1", "t2").join(copies, ["t1", "t2"]).select("t1", "t2", "d")
            texts = rows.withColumn("d", F.coalesce("doc_id", F.lit(-(2**63)))).join(wanted, ["d", "t1", "t2"], "left_semi").select("t1", "t2", "text")
            texts = scratch.keep(texts, "texts", compression="zstd")
        now = scratch.keep(texts.join(look, ["t1", "t2"]).mapInArrow(next_runs(length, longer), RUNS), f"runs{longer}")
        scratch.drop(f"runs{gram}")
    spans = done[0]
    for more in done[1:]:
        spans = spans.unionByName(more)
    spans = spans.groupBy("t1", "t2").agg(F.collect_list("span").alias("spans"))
    whole = copies.where("n > 1").select("t1", "t2", F.lit(True).alias("whole"))
    found = scratch.keep(spans.join(whole, ["t1", "t2"], "full").select("t1", "t2", F.coalesce("whole", F.lit(False)).alias("whole"), F.when(F.col("whole").isNull(), F.col("spans")).alias("spans")), "found")
    scratch.drop(f"runs{grams[-1]}", "texts", *(f"marked{g}" for g in grams), *(f"look{g}" for g in grams[1:]))
    return found


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Byte ranges in order, put together where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["s0"], x["s1"]) for x in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (doc_id, text, whole, spans): what is removed of each text, and what stays."""
    for batch in words.sliced(batches):
        data, offsets = words.utf8(batch.column("text"))
        data = data.tobytes()
        n, removed, count, kept = [], [], [], []
        for i, (whole, spans) in enumerate(zip(batch.column("whole").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
            text = data[offsets[i] : offsets[i + 1]]
            gone = [(0, len(text))] if whole else merged(spans or [])
            n.append(len(text))
            removed.append(sum(b - a for a, b in gone))
            count.append(len(gone))
            kept.append(b"".join(text[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(text)], strict=True)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of ``docs`` (doc_id, text, ...).

    Each byte of the UTF-8 text goes that a ``length``-byte string covers which also starts
    anywhere else, in the same row or another. Null text is empty; texts shorter than ``length``
    stay. Repeated rows are copies of each other, also under one doc_id or none. ``kept`` is
    binary, as a cut may split a character. Other columns are ignored. An empty table gives
    an empty table."""
    found = repeated(docs, scratch, length, grams)
    return texts_of(docs).join(found, ["t1", "t2"], "left").select("doc_id", "text", "whole", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
