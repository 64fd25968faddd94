import io
import wave
from collections import Counter

import numpy as np

from quillspan.llm import audio
from quillspan.llm.queries import QUERIES
from quillspan.llm.scratch import Scratch


def wav(x, rate=audio.RATE):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(x, -1, 1) * 32000).astype("<i2").tobytes())
    return out.getvalue()


def tune(seed, notes=60):
    rng = np.random.default_rng(seed)
    time = np.arange(1024) / audio.RATE
    return np.concatenate([np.sin(2 * np.pi * 110 * 2 ** (n / 12) * time) for n in rng.integers(0, 40, notes)]) * 0.4


def test_shifted_noisy_recordings_align(spark):
    a = tune(1)
    noisy = a[40 * audio.HOP :] + np.random.default_rng(5).normal(0, 0.002, len(a) - 40 * audio.HOP)
    rows = [(20, wav(a)), (1, wav(noisy)), (2, wav(tune(2))), (3, wav(a)), (4, None), (5, b"junk"), (6, wav(np.zeros(50_000))), (7, wav(a[:100])), (None, wav(a)), (20, wav(a))]
    media = spark.createDataFrame([(*r, 1, "x") for r in rows], "id long, audio binary, rep int, take string").repartition(3)
    prints, asked = audio.fingerprints(media), audio.fingerprints(media.where("id % 20 = 0"), audio.PHASES)
    members, found = audio.align(prints, asked, Scratch(spark, "t"))
    assert sorted((r.id, r.rep) for r in members.where("id is not null").collect()) == [(1, 1), (2, 2), (3, 3), (6, 6), (20, 3), (20, 3)]
    got = found.collect()
    assert [(r.id, r.other, r.phase, r.offset) for r in got] == [(3, 1, 0, 40)]
    assert got[0].bit_errors < 0.1 * 32 * got[0].overlap


def test_alignments_are_those_of_a_plain_search(spark):
    """All phases, offsets and pairs by loops, on recordings of which some share stretches."""
    tunes = [tune(i, 30) for i in range(6)]
    rng = np.random.default_rng(9)
    rows = [(i, wav(x)) for i, x in enumerate(tunes)] + [(10 + i, wav(np.concatenate([tune(50 + i, 10), x[1000 * i + 300 :] + rng.normal(0, 0.003, len(x) - 1000 * i - 300)]))) for i, x in enumerate(tunes)]
    media = spark.createDataFrame(rows, "id long, audio binary").repartition(4)
    asked = media.where("id % 2 = 0")
    got = {(r.id, r.other): (r.phase, r.offset, r.votes, r.overlap, r.bit_errors) for r in audio.align(audio.fingerprints(media), audio.fingerprints(asked, audio.PHASES), Scratch(spark, "t"))[1].collect()}
    base = {i: audio.integers(audio.chroma(audio.samples_of(x))) for i, x in rows}
    want = {}
    for i, x in rows:
        for j, b in base.items():
            best = []
            for phase in range(0, audio.HOP, audio.HOP // audio.PHASES) if i % 2 == 0 and i != j else ():
                a = audio.integers(audio.chroma(audio.samples_of(x)[phase:]))
                (ka, pa_), (kb, pb) = audio.keys_of(a), audio.keys_of(b)
                agree = Counter(int(p - q) for k, p in zip(ka, pa_, strict=True) for l, q in zip(kb, pb, strict=True) if k == l)
                for offset, votes in agree.items():
                    x0, y0 = a[max(0, offset) :], b[max(0, -offset) :]
                    n = min(len(x0), len(y0))
                    errors = sum(bin(int(u) ^ int(v)).count("1") for u, v in zip(x0[:n], y0[:n], strict=True)) if votes >= audio.VOTES else 0
                    if votes >= audio.VOTES and errors <= audio.ERRORS * 32 * n:
                        best.append((errors / n, -votes, abs(offset), offset, phase, n, errors))
            if best:
                _, votes, _, offset, phase, n, errors = min(best)
                want[i, j] = (phase, offset, -votes, n, errors)
    assert got == want and len(want) >= 5


def test_excerpts_are_found_again(spark):
    """Of noisy excerpts of the rows asked for, nine of ten at least lead to their row, and to few others."""
    got = QUERIES["op5_audio_fingerprints"](spark, "/root/testdata/sf0.01").collect()
    rep = {r.other_id: r.vec_id for r in got if r.kind == "member"}
    asked = [i for i in rep if i % 20 == 0]
    hits = {(r.vec_id, r.other_id) for r in got if r.kind == "heard"}
    assert sum((i, rep[i]) in hits for i in asked) >= 0.9 * len(asked)
    assert len(hits) < 1.1 * len(asked) + sum(r.kind == "aligned" for r in got)


def test_silence_makes_no_key():
    x = np.concatenate([np.zeros(60_000), tune(3, 10)])
    keys, places = audio.keys_of(audio.integers(audio.chroma(x.astype(np.float32))))
    assert len(places) and places.min() >= (60_000 - audio.FRAME) // audio.HOP - audio.WIDTH - 1


def tones(seed, seconds=3.0, notes=8):
    """Tones held for some seconds each, of four frequencies with their fifths."""
    rng, time = np.random.default_rng(seed), np.arange(int(seconds * audio.RATE)) / audio.RATE
    return np.concatenate([np.sin(2 * np.pi * f * time) + 0.5 * np.sin(3 * np.pi * f * time) for f in 220 * 2 ** (rng.integers(0, 12, notes) / 12)]) * 0.3


def test_held_tones_are_found_by_their_changes(spark):
    rng = np.random.default_rng(6)
    whole = [tones(i) for i in range(20)]
    heard = [x[(a := int(rng.integers(0, len(x) // 3))) :] + rng.normal(0, 0.01, len(x) - a) for x in whole]
    media = spark.createDataFrame([(i, wav(x)) for i, x in enumerate(whole)], "id long, audio binary").repartition(3)
    asked = spark.createDataFrame([(100 + i, wav(x)) for i, x in enumerate(heard)], "id long, audio binary").repartition(3)
    found = audio.align(audio.fingerprints(media), audio.fingerprints(asked, audio.PHASES), Scratch(spark, "t"))[1].collect()
    # Most of what the excerpt and its recording share agrees; other recordings align where they happen to hold the same tones.
    own = {r.id: r for r in found if r.other == r.id - 100 and r.bit_errors < 0.15 * 32 * r.overlap and r.overlap > 150}
    assert len(own) >= 18


def test_held_tones_do_not_meet_all_against_all():
    """Of recordings of one tone, of 20 seconds and with noise, hardly a place has a key: before, each did, and all met."""
    rng, time = np.random.default_rng(8), np.arange(20 * audio.RATE) / audio.RATE
    made = [audio.keys_of(audio.integers(audio.chroma((0.4 * np.sin(2 * np.pi * 440 * time) + rng.normal(0, 0.002 * i, len(time))).astype(np.float32))))[0] for i in range(12)]
    counts = Counter(k for keys in made for k in keys.tolist())
    assert sum(n * n for n in counts.values()) < 3000
    keys, places = audio.keys_of(audio.integers(audio.chroma(tones(1).astype(np.float32))))
    assert 7 * audio.WIDTH / 2 < len(places) < 7 * 4 * audio.WIDTH


def test_filters_are_differences_of_plain_sums():
    image = np.random.default_rng(3).random((40, 12)).astype(np.float32)
    got = audio.integers(image)
    assert len(got) == 40 - audio.WIDTH + 1
    for t in (0, 7):
        want = 0
        for i, (kind, p, h, w) in enumerate(audio.FILTERS):
            x = image[t : t + w, p : p + h].astype(float)
            if kind == 1:
                a, b = x[:, h // 2 :].sum(), x[:, : h // 2].sum()
            elif kind == 2:
                a, b = x[w // 2 :].sum(), x[: w // 2].sum()
            else:
                a, b = x[: w // 2, : h // 2].sum() + x[w // 2 :, h // 2 :].sum(), x[: w // 2, h // 2 :].sum() + x[w // 2 :, : h // 2].sum()
            value = round(float(np.log((1 + a) / (1 + b))), 9)
            want |= int(audio.GRAY[sum(value > c for c in audio.CUTS)]) << (2 * i)
        assert int(got[t]) == want


def test_a_pure_tone_is_one_pitch_class():
    c = audio.chroma(np.sin(2 * np.pi * 440 * np.arange(8000) / audio.RATE).astype(np.float32))
    assert (c.argmax(axis=1) == 0).all() and len(audio.chroma(np.zeros(10, np.float32))) == 0


def test_query_places_every_row(spark, sf_dir):
    got = QUERIES["op5_audio_fingerprints"](spark, sf_dir).collect()
    ids = {r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    assert {r.other_id for r in got if r.kind == "member"} == ids


def test_null_vectors_rests_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [None, 0.1, float("nan")])], "id long, values array<float>")
    got = {r.id: r.audio for r in audio.sonified(rows).collect()}
    assert got[1] is None and got[2] is None and len(audio.samples_of(got[3])) == 3 * 2 * audio.HOP
    empty = spark.createDataFrame([], "id long, phase int, print binary")
    members, found = audio.align(empty, empty, Scratch(spark, "t"))
    assert members.count() == 0 and found.count() == 0
