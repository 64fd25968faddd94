"""Media columns: chroma fingerprints of recordings, and their alignment.

A recording (WAV, 16-bit PCM, in a binary column) is cut into overlapping frames, whose
spectra are folded into twelve pitch classes. Sixteen rectangle filters over that image, each
a few differences in its integral image, are quantized to two bits; together they are one
packed 32-bit integer a frame. Recordings align where runs of equal integers agree on an
offset: a histogram of offsets gives the best one, and the bit errors of the overlap
at it say how alike they are.

Scale: equal fingerprints are one class and take part once. A key is two integers whose stretches
of frames don't overlap, ``WIDTH`` apart: two consecutive ones share all but one frame and say little
more than one does, and meet by chance in numbers that grow with the square of the input. Held tones have
no keys, only their changes do. What is
asked for is printed at ``PHASES`` places within a hop, as a recording seldom begins where
another's frame does. Votes are summed up before the shuffle, and joins on keys stay divisible."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.scratch import Scratch

RATE, FRAME, HOP = 4000, 1024, 256
#: Kind (0: all against nothing, 1: upper against lower pitches, 2: later against earlier, 3: crossed), first pitch, pitches, frames.
FILTERS = tuple((kind, first, height, width) for kind, first, height, width in (
    (1, 0, 12, 8), (1, 0, 6, 8), (1, 6, 6, 8), (1, 3, 6, 16), (1, 0, 4, 4), (1, 4, 4, 4), (1, 8, 4, 4), (2, 0, 12, 16),
    (2, 0, 4, 8), (2, 4, 4, 8), (2, 8, 4, 8), (2, 2, 2, 12), (3, 0, 12, 8), (3, 0, 6, 16), (3, 6, 6, 16), (3, 4, 4, 8),
))
WIDTH = max(f[3] for f in FILTERS)
VOTES, ERRORS, PHASES = 3, 0.35, 4
#: Edges of the four levels of a filter. 0, the value of most filters where a tone is held, lies well within one, so that noise doesn't move it.
CUTS = (-0.2, 0.05, 0.2)
#: Bits in which an integer may differ from the next, and from the one WIDTH later, where a tone is held.
STEADY = 4
GRAY = np.array([0, 1, 3, 2], np.uint32)


def samples_of(audio: bytes | None) -> np.ndarray:
    """Samples in -1 to 1 at RATE, channels averaged; none if the bytes aren't such a recording."""
    try:
        with wave.open(io.BytesIO(audio or b"")) as f:
            if f.getsampwidth() != 2:
                return np.zeros(0, np.float32)
            x = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels()).mean(axis=1) / 32768
            rate = f.getframerate()
    except (wave.Error, EOFError, ValueError, struct.error):
        return np.zeros(0, np.float32)
    if rate != RATE and len(x):
        x = np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x)
    return x.astype(np.float32)


def _pitches() -> np.ndarray:
    """Pitch class of each spectral line from 60 Hz on, as columns of a matrix."""
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hertz), 12), np.float32)
    use = np.flatnonzero((hertz >= 60) & (hertz < RATE / 2))
    out[use, np.round(12 * np.log2(hertz[use] / 440.0)).astype(int) % 12] = 1
    return out


FOLD, SHAPE = _pitches(), np.hanning(FRAME).astype(np.float32)


def chroma(x: np.ndarray, block: int = 512) -> np.ndarray:
    """Rows of twelve pitch classes, each frame's strongest being 1; silent frames are 0."""
    n = max(0, (len(x) - FRAME) // HOP + 1)
    out = np.zeros((n, 12), np.float32)
    for i in range(0, n, block):
        own = np.lib.stride_tricks.sliding_window_view(x[i * HOP :], FRAME)[::HOP][: min(block, n - i)]
        power = np.abs(np.fft.rfft(own * SHAPE, axis=1)).astype(np.float32) ** 2 @ FOLD
        top = power.max(axis=1, keepdims=True)
        out[i : i + len(own)] = np.where(top > 1e-4, power / np.maximum(top, 1e-9), 0)
    return out


def integers(image: np.ndarray) -> np.ndarray:
    """One packed integer for each stretch of WIDTH frames."""
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.astype(np.float64).cumsum(axis=0).cumsum(axis=1)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return total[t1 : t1 + n, p1] - total[t0 : t0 + n, p1] - total[t1 : t1 + n, p0] + total[t0 : t0 + n, p0]

    out = np.zeros(n, np.uint32)
    for i, (kind, p, h, w) in enumerate(FILTERS):
        if kind == 1:
            a, b = area(0, w, p + h // 2, p + h), area(0, w, p, p + h // 2)
        elif kind == 2:
            a, b = area(w // 2, w, p, p + h), area(0, w // 2, p, p + h)
        else:
            a = area(0, w // 2, p, p + h // 2) + area(w // 2, w, p + h // 2, p + h)
            b = area(0, w // 2, p + h // 2, p + h) + area(w // 2, w, p, p + h // 2)
        value = np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0)))
        out |= GRAY[np.searchsorted(CUTS, np.round(value, 9))] << np.uint32(2 * i)
    return out


#: The integer of silence: it says nothing of a recording, so no key has it.
SILENT = integers(np.zeros((WIDTH, 12), np.float32))[0]


def _printer(phases: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, rows = [], [], []
            for i, audio in zip(batch.column("id").to_pylist(), batch.column("audio"), strict=True):
                x = samples_of(audio.as_py())
                for phase in range(0, HOP, HOP // phases):
                    ids.append(i)
                    starts.append(phase)
                    rows.append(integers(chroma(x[phase:])).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(rows, pa.binary())], names=["id", "phase", "print"])

    return run


def fingerprints(media: DataFrame, phases: int = 1) -> DataFrame:
    """(id, phase, print) for (id, audio): packed integers as little-endian u32, from ``phases`` samples
    on that divide a hop evenly. Null, broken or too short recordings have an empty print."""
    return media.select(F.col("id").cast("long"), F.col("audio").cast("binary")).mapInArrow(_printer(phases), "id long, phase int, print binary")


def keys_of(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a print, and the place of each. Where a tone is held, nothing changes from one frame to the next nor to those
    WIDTH later: all such places have much the same key, which says nothing of an offset, and so they have none."""
    own = ints.astype(np.uint64)
    first, second, after = own[: max(0, len(own) - WIDTH)], own[WIDTH:], own[1 : max(1, len(own) - WIDTH + 1)]
    held = (np.bitwise_count(first ^ second) <= STEADY) & (np.bitwise_count(first ^ after) <= STEADY)
    place = np.flatnonzero((first != SILENT) & (second != SILENT) & ~held)
    return ((first << np.uint64(32)) | second).view(np.int64)[place], place.astype(np.int32)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = ("id", "phase", "take")
    for batch in batches:
        found = [keys_of(np.frombuffer(x, "<u4")) for x in batch.column("print").to_pylist()]
        n = [len(k) for k, _ in found]
        flat = lambda j, t: pa.array(np.concatenate([np.zeros(0, t), *(x[j] for x in found)]))
        yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in kept), flat(0, np.int64), flat(1, np.int32)], names=[*kept, "key", "at"])


def overlap_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Integers that both have where b begins at place ``offset`` of a, and the bits in which they differ."""
    a, b = a[max(0, offset) :], b[max(0, -offset) :]
    n = min(len(a), len(b))
    return n, int(np.bitwise_count(a[:n] ^ b[:n]).sum())


def _errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = ("id", "phase", "other", "offset", "votes")
    for batch in batches:
        found = [overlap_errors(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), o) for x, y, o in zip(*(batch.column(c).to_pylist() for c in ("print", "other_print", "offset")), strict=True)]
        sums = [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *sums], names=[*kept, "overlap", "bit_errors"])


def align(prints: DataFrame, asked: DataFrame, scratch: Scratch, votes: int = VOTES, errors: float = ERRORS) -> tuple[DataFrame, DataFrame]:
    """Members (id, rep) of the classes of equal prints, and the alignments (id, other, phase, offset,
    votes, overlap, bit_errors) of what is asked for with classes.

    ``prints`` is (id, print, ...), ``asked`` (id, phase, print), which need not be among them: an id
    that is stands for its class and isn't aligned with it. A pair aligns at the phase and offset of the
    fewest bit errors for its overlap, the most votes, the nearest to 0 and then the least of equal ones, among
    those on which ``votes`` keys agree at least and ``errors`` of the overlap's bits differ at most.
    ``offset`` is the place in the asked print where other's begins.
    Empty prints, null ids and repeated rows: in no class, in the class, in the class once. Other columns
    are ignored; empty tables give empty tables."""
    hashes = {"take": F.xxhash64("print"), "take2": F.xxhash64(F.lit(5), "print")}
    prints = scratch.keep(prints.where("length(print) > 0").select("id", "print").withColumns(hashes), "prints")
    hashed = prints.select("id", "take", "take2")
    classes = scratch.keep(hashed.where("id is not null").groupBy("take", "take2").agg(F.min("id").alias("rep")), "classes")
    members = hashed.join(classes, ["take", "take2"]).select("id", "rep")
    own = prints.join(classes.withColumnRenamed("rep", "id"), ["id", "take", "take2"], "left_semi").dropDuplicates(["id", "take", "take2"])
    own = scratch.keep(own.select("id", F.lit(0).alias("phase"), "take", "print"), "own")
    named = asked.where("length(print) > 0 and id is not null").select("id", "phase", "print").withColumns(hashes).join(members.distinct(), "id", "left")
    asked = scratch.keep(named.select(F.coalesce("rep", "id").alias("id"), "phase", "print", "take", "take2").dropDuplicates(["id", "phase", "take", "take2"]), "asked")
    keyed = "id long, phase int, take long, key long, at int"
    other = own.mapInArrow(_keys, keyed).select(F.col("id").alias("other"), F.col("take").alias("other_take"), "key", F.col("at").alias("other_at"))
    met = asked.mapInArrow(_keys, keyed).join(other, "key").where("id != other")
    counts = met.groupBy("id", "phase", "take", "other", "other_take", (F.col("at") - F.col("other_at")).alias("offset")).agg(F.count("*").alias("votes")).where(F.col("votes") >= votes)
    both = counts.join(asked.drop("take2"), ["id", "phase", "take"]).join(own.select(F.col("id").alias("other"), F.col("take").alias("other_take"), F.col("print").alias("other_print")), ["other", "other_take"])
    matched = both.mapInArrow(_errors, "id long, phase int, other long, offset int, votes long, overlap long, bit_errors long")
    order = Window.partitionBy("id", "other").orderBy(F.col("bit_errors") / F.col("overlap"), F.desc("votes"), F.abs("offset"), "offset", "phase")
    passing = matched.where(F.col("bit_errors") <= errors * 32 * F.col("overlap"))
    return members, passing.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def wav_of(samples: np.ndarray) -> bytes:
    """A recording of 16-bit samples at RATE."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(RATE)
        f.writeframes(samples.astype("<i2").tobytes())
    return out.getvalue()


def _hearer(noise: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("id").to_pylist(), []
            for i, audio in zip(ids, batch.column("audio"), strict=True):
                rng, x = np.random.default_rng([7, abs(i or 0)]), samples_of(audio.as_py())
                x = x[int(rng.integers(0, len(x) // 3 + 1)) :]
                x = np.clip(x + rng.normal(0, noise, len(x)), -1, 1)
                rows.append(wav_of(x * 32767) if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.binary())], names=["id", "audio"])

    return run


def heard(media: DataFrame, noise: float = 0.01) -> DataFrame:
    """(id, audio): each recording as another device may have taken it, from a place in its first third
    on that its id gives, with white noise of amplitude ``noise``. No recording stays none."""
    return media.select(F.col("id").cast("long"), F.col("audio").cast("binary")).mapInArrow(_hearer(noise), "id long, audio binary")


def _tones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    length = 2 * HOP
    time = np.arange(length) / RATE
    hertz = 110.0 * 2 ** (np.arange(48) / 12)
    notes = (np.sin(2 * np.pi * hertz[:, None] * time) * np.minimum(1, np.minimum(np.arange(length), np.arange(length)[::-1]) / 32) * 12000).astype("<i2")
    notes = np.concatenate([notes, np.zeros((1, length), "<i2")])
    for batch in batches:
        ids, vectors = batch.column("id"), batch.column("values").to_pylist()
        for i in range(0, len(vectors), 64):
            rows = []
            for v in vectors[i : i + 64]:
                x = np.array([np.nan if y is None else y for y in v or []], float)
                note = np.where(np.isfinite(x), np.clip(np.nan_to_num(x) * max(1, len(x)) ** 0.5 * 8 + 24, 0, 47), 48).astype(int)
                rows.append(wav_of(notes[note].ravel()) if len(x) else None)
            yield pa.RecordBatch.from_arrays([ids.slice(i, len(rows)), pa.array(rows, pa.binary())], names=["id", "audio"])


def sonified(rows: DataFrame) -> DataFrame:
    """(id, audio) for (id, values): a recording that plays a vector's values as notes of 128 ms,
    higher ones for larger values; nulls are rests, and a null or empty vector is no recording."""
    return rows.select(F.col("id").cast("long"), F.col("values").cast("array<float>")).mapInArrow(_tones, "id long, audio binary")
