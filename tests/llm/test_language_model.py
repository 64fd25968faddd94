import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from quillspan.llm import language_model, words
from quillspan.llm.queries import QUERIES
from quillspan.llm.scratch import Scratch


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def plain(rows):
    """doc_id, held out, tokens, known ones, training tokens and base score."""
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(t for d, x in rows if not out(d) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return [(d, out(d), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x))) for d, x in rows]


def same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 4))
    have = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=key)
    assert len(have) == len(want)
    for a, b in zip(have, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = QUERIES["op7_language_model"](spark, sf_dir).collect()
    same(got, plain([(r.doc_id, r.text) for r in docs]))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(language_model, "KNOWN", 5)
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b a B c"), (None, "a b"), (5, "x " * 100_000), (4, "a b a B c"), (9, "É é new words"), (10, "end"), (11, "a b c d e f g h")]
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, n long, score string").repartition(3)
    got = language_model.score(docs, Scratch(spark, "t")).collect()
    same(got, plain(rows))
    assert all(math.isfinite(r.score) for r in got)


def test_empty_and_all_held_out(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert language_model.score(none, Scratch(spark, "t")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = language_model.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string"), Scratch(spark, "t")).first()
    assert (got.n_tokens, got.n_known, got.train_tokens) == (3, 0, 0)


def some_model(seed=0):
    rng = np.random.default_rng(seed)
    weights = rng.normal(size=(language_model.FEATURES * language_model.BUCKETS, language_model.CLASSES)).astype(np.float32)
    bias = rng.normal(size=language_model.CLASSES).astype(np.float32)
    ones = np.ones(language_model.CLASSES)
    return language_model.Model(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16), weights, bias, ones, 0, 0)


def some_features(n, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.integers(0, language_model.BUCKETS, (n, language_model.FEATURES)) + np.arange(language_model.FEATURES) * language_model.BUCKETS).astype(np.int32)


def plain_softmax(m, features):
    logits = m.bias.astype(float) + m.weights.astype(float)[features].sum(axis=1)
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def test_classes_have_a_distribution():
    m, f = some_model(), some_features(2500)
    want = plain_softmax(m, f)
    for c in (0, 5, language_model.CLASSES - 1):
        assert np.allclose(language_model.Softmax(m).log_of(f, np.full(len(f), c)), np.log(want[:, c]), atol=1e-4)


def test_gradient_is_expected_less_observed(spark):
    """The packed sums of all tasks are those of a plain loop over tokens."""
    rows = [(i, " ".join(f"w{(i * j) % 11}" for j in range(40 + i))) for i in range(40)] + [(99, ""), (100, None)]
    train = language_model.texts_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 7, 2)
    m = some_model(3)
    spread = spark.sparkContext.broadcast(m)
    got = np.zeros((language_model.FEATURES * language_model.BUCKETS + 1, language_model.CLASSES + 1))
    for block, x in language_model.summed(train.select("text").mapInArrow(language_model.gradients(spread), language_model.PACKED), 5):
        x = x.reshape(-1, language_model.CLASSES + 1)
        got[block * language_model.BLOCK : block * language_model.BLOCK + len(x)] = x
    want = np.zeros_like(got)
    for _, text in rows:
        data, offsets = words.utf8(pa.array([text], pa.string()))
        tokens_, group, start = language_model.tokens_of(data, offsets)
        y, features = m.classes(m.table().find(tokens_), group), language_model.features_of(tokens_, start)
        for p, c, f in zip(plain_softmax(m, features), y, features, strict=True):
            g = np.append(p, 1.0)
            g[c] -= 1
            for i in (*f, -1):
                want[i] += g
    assert np.allclose(got, want, atol=1e-3)


def test_score_is_the_models_probability(spark, monkeypatch):
    """Each text's score by a loop over its tokens, from the model's weights and all counts."""
    rows = [(i, " ".join(f"w{(i * j * j) % 23}{'ing' if j % 3 else 'ed'}" for j in range(5 + i % 9))) for i in range(80)] + [(200, None), (201, "unseen words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept, learn = [], language_model.learn
    monkeypatch.setattr(language_model, "learn", lambda *a: kept.append(learn(*a)) or kept[0])
    monkeypatch.setattr(language_model, "KNOWN", 20)
    got = {r.doc_id: r.score for r in language_model.score(docs, Scratch(spark, "t")).collect()}
    m, counts = kept[0][0], {r.word: r.n for r in kept[0][1].collect()}
    for d, text in rows:
        data, offsets = words.utf8(pa.array([text], pa.string()))
        tokens_, group, start = language_model.tokens_of(data, offsets)
        y, features = m.classes(m.table().find(tokens_), group), language_model.features_of(tokens_, start)
        want = 0.0
        for p, c, w in zip(plain_softmax(m, features), y.tolist(), tokens_.tolist(), strict=True):
            want += math.log10(p[c]) + (math.log10((counts.get(w, 0) + 1) / m.within[c]) if c >= language_model.SINGLE else 0)
        assert abs(got[d] - want) < 1e-3 * max(1, abs(want))


def test_rounds_raise_the_held_out_score(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = []
    for rounds in (0, language_model.ROUNDS):
        fit = language_model.fit
        monkeypatch.setattr(language_model, "fit", lambda model, train, r=rounds, fit=fit: fit(model, train, r) if r else None)
        sums.append(language_model.score(docs, Scratch(spark, "t")).where("held_out").agg({"score": "sum"}).first()[0])
        monkeypatch.undo()
    assert sums[1] > sums[0]
    print("held-out sum of log10, start and trained:", sums)
    # Of what the start gains on probabilities of words alone, the rounds add a tenth at least.
    base = language_model.score(docs, Scratch(spark, "t")).where("held_out").agg({"base_score": "sum"}).first()[0]
    assert sums[1] - sums[0] > 0.1 * (sums[0] - base)


def test_words_of_one_class_share_its_probability(spark):
    """The probabilities of all words, seen or not, sum to one after any history."""
    rows = spark.createDataFrame([(i, "a b c dd ee a b fff") for i in range(6)], "doc_id long, text string")
    model, counts = language_model.learn(rows, Scratch(spark, "t"))
    table, seen = model.table(), {r.word: r.n for r in counts.collect()}
    total = np.zeros(language_model.CLASSES)
    data, offsets = words.utf8(pa.array(["a b c dd ee fff"]))
    tokens_, group, _ = language_model.tokens_of(data, offsets)
    for number, g, w in zip(table.find(tokens_), group, tokens_, strict=True):
        c = model.classes(np.array([number]), np.array([g]))[0]
        total[c] += 1.0 if c < language_model.SINGLE else (seen[int(w)] + 1) / model.within[c]
    assert (total <= 1 + 1e-9).all()


def test_features_do_not_cross_documents():
    t = np.array([5, 6, 7, 5, 6, 7], np.int64)
    a = language_model.features_of(t, np.array([0, 3, 6]))
    assert (a[:3] == a[3:]).all()


def test_every_training_document_is_in_one_gradient_round(spark, monkeypatch):
    """The tokens of all rounds are those of all training documents, with copies of a text in every round."""
    seen, summed, last = [], language_model.summed, language_model.FEATURES * language_model.BUCKETS // language_model.BLOCK

    def noted(rows, tasks):
        for block, x in summed(rows, tasks):
            if block == last:
                seen.append(x[-1])
            yield block, x

    monkeypatch.setattr(language_model, "summed", noted)
    rows = [(i, "a common text" if i % 3 == 0 else f"w{i} x{i % 7} y") for i in range(6000)]
    language_model.learn(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"))
    assert len(seen) == language_model.ROUNDS and sum(seen) == 4 * len(rows)
    assert all(0.8 < x * len(seen) / sum(seen) < 1.2 for x in seen)
