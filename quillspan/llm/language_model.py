"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | before) = P(class | before) * P(word | class). The most frequent words are classes of
their own; other words fall into classes by a hash of their ending. The class has a softmax
over hashed features: the word before, the pair before, and skips to the second and third
word before. Within a class words have their counts plus one, and one more share for all
words never seen, so that every text has a probability.

Learning. Word counts, class counts and counts of features with classes are of all training
documents, summed up in tasks and then by Spark. The weights start as damped log ratios of
those counts, and are then trained by distributed gradient updates: a hash deals the training
documents to ``ROUNDS`` slices, written once; in each round tasks sum their gradient over the next slice,
Spark adds the sums, and the driver, which holds ``FEATURES * BUCKETS * CLASSES`` weights
whatever the input, takes a step, divided by how often a feature met a class, and so nearly the second derivative:
rare and frequent pairs move alike. Every training document is in one round, at any size.

Scoring reads each text once, in sparse numpy batches. The counts of the ``KNOWN`` most frequent
words, a number fixed beforehand, go to the tasks; the other words' counts, however many, are
joined to the documents that hold them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm import words
from quillspan.llm.scratch import Scratch

SINGLE, ENDINGS, BUCKETS, FEATURES = 64, 64, 2048, 4
CLASSES = SINGLE + ENDINGS
KNOWN, ROUNDS, LIMIT = 400_000, 6, 12.0
#: How much of the log ratios of counts weights start with; the first step and by how much later ones are smaller; counts that rare pairs are taken to have.
DAMP, STEP, DECAY, FEW = 0.25, 0.4, 0.85, 10.0
#: Tokens whose probabilities are held at once, and buckets in a row of sums.
STRIDE, SPAN, BLOCK = 1024, 8192, 64
END = np.int64(-0x61C8864680B583EB)
LOG10 = np.log(10.0)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every token, its class by ending, and where documents begin; each ends with END."""
    hashes, begin = words.words_of(data, offsets)
    tail = endings(data, offsets)
    n = np.diff(begin)
    start = np.concatenate([[0], np.cumsum(n + 1)])
    out, group = np.full(start[-1], END, np.int64), np.zeros(start[-1], np.int16)
    place = np.arange(len(hashes)) + np.repeat(np.arange(len(n)), n)
    out[place], group[place] = hashes.view(np.int64), tail
    return out, group, start


def endings(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A class for each word by a hash of its last three bytes (fewer where it is shorter)."""
    if not len(data):
        return np.zeros(0, np.int16)
    low = words.LOWER[data]
    solid = ~words.SPACE[low]
    first = np.zeros(len(low), bool)
    first[offsets[:-1][offsets[:-1] < len(low)]] = True
    last = np.append(~solid[1:] | first[1:], True) & solid
    end = np.flatnonzero(last)
    key = low[end].astype(np.uint64)
    inside = np.ones(len(end), bool)
    for back in (1, 2):
        at = end - back
        inside &= (at >= 0) & ~first[np.minimum(at + 1, len(low) - 1)] & solid[np.maximum(at, 0)]
        key = key * np.uint64(257) + np.where(inside, low[np.maximum(at, 0)], 0).astype(np.uint64)
    return (words.mix(key) % np.uint64(ENDINGS)).astype(np.int16)


class Table:
    """Numbers of known words by their hash, in an open-addressed array."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.slots, self.value = np.zeros(1 << self.bits, np.int64), np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._place(keys)
        while len(left):
            free = self.value[at] < 0
            self.value[at[free]] = left[free]
            done = self.value[at] == left
            self.slots[at[done]] = keys[left[done]]
            left, at = left[~done], (at[~done] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * words.BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where it is unknown."""
        out, at = np.full(len(keys), -1, np.int32), self._place(keys)
        left = np.arange(len(keys))
        while len(left):
            value = self.value[at]
            hit = (value >= 0) & (self.slots[at] == keys[left])
            out[left[hit]] = value[hit]
            go = (value >= 0) & ~hit
            left, at = left[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out


def features_of(tokens: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Buckets of each token's features, rows of FEATURES; before a document's first words stands nothing."""
    n = len(tokens)
    place = np.arange(n) - np.repeat(start[:-1], np.diff(start))
    back = []
    for d in (1, 2, 3):
        shifted = np.zeros(n, np.uint64)
        shifted[d:] = tokens.view(np.uint64)[: n - d] if n > d else tokens.view(np.uint64)[:0]
        shifted[place < d] = 0
        back.append(shifted)
    keys = (back[0], back[0] * words.BASE + back[1], back[1], back[2])
    out = np.empty((n, FEATURES), np.int32)
    for i, k in enumerate(keys):
        out[:, i] = (words.mix(k ^ np.uint64(i + 1)) >> np.uint64(64 - 11)).astype(np.int32) + i * BUCKETS
    return out


@dataclass
class Model:
    """What tasks need to score: known words and their counts, weights, totals of classes."""

    known: np.ndarray
    counts: np.ndarray
    single: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    within: np.ndarray
    total: int
    distinct: int
    #: Counts of features with classes, for the driver's steps; not sent to tasks.
    seen: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": None}

    def table(self) -> Table:
        return Table(self.known)

    def classes(self, number: np.ndarray, group: np.ndarray) -> np.ndarray:
        own = np.where(number >= 0, self.single[np.maximum(number, 0)], -1) if len(self.single) else number
        return np.where(own >= 0, own, group + SINGLE).astype(np.int64)


class Softmax:
    """Class probabilities as products: e to a sum of weights is a product of rows of e to the weights.

    Weights stay within ``LIMIT``, so that four of them and a bias neither overflow nor vanish."""

    def __init__(self, model: Model):
        self.rows = np.exp(np.clip(model.weights, -LIMIT, LIMIT))
        # Each token has one feature of the first kind, so these rows can carry the bias.
        self.rows[:BUCKETS] *= np.exp(np.maximum(model.bias, -30))
        self.out, self.more = (np.empty((STRIDE, CLASSES), np.float32) for _ in range(2))

    def products(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For at most STRIDE tokens: numbers in proportion to the probabilities of classes, and their sums.
        The array is used again by the next call."""
        n = len(features)
        out, more = self.out[:n], self.more[:n]
        np.take(self.rows, features[:, 0], axis=0, out=out, mode="clip")
        for i in range(1, FEATURES):
            np.take(self.rows, features[:, i], axis=0, out=more, mode="clip")
            np.multiply(out, more, out=out)
        return out, np.einsum("ij->i", out)

    def log_of(self, features: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each token's class."""
        said = np.empty(len(y))
        for a in range(0, len(y), STRIDE):
            out, total = self.products(features[a : a + STRIDE])
            said[a : a + STRIDE] = np.log(out[np.arange(len(out)), y[a : a + STRIDE]].astype(float)) - np.log(total.astype(float))
        return said


def parts(batch: pa.RecordBatch, size: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = words.utf8(batch.column("text"))
    for a, b in words.chunks(offsets, size):
        own = offsets[a : b + 1]
        yield a, b, *tokens_of(data[own[0] : own[-1]], own - own[0])


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, ending, n) of each batch of texts."""
    for batch in batches:
        data, offsets = words.utf8(batch.column("text"))
        for a, b in words.chunks(offsets, 8 << 20):
            own = offsets[a : b + 1]
            tokens, group, _ = tokens_of(data[own[0] : own[-1]], own - own[0])
            key, first, n = np.unique(tokens, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(group[first].astype(np.int32)), pa.array(n)], names=["word", "ending", "n"])


def texts_of(docs: DataFrame, folds: int, fold: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out(F.col("doc_id"), folds, fold).alias("held_out"))


def learn(train: DataFrame, scratch: Scratch) -> tuple[Model, DataFrame]:
    """The model of (doc_id, text) rows, and (word, n) of all their words."""
    counts = scratch.keep(train.select("text").mapInArrow(count_words, "word long, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n")), "counts")
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    level = F.floor(F.log2("n") * 8)
    sizes = {r.level: r.m for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("m")).collect()}
    held, least = 0, None
    for x in sorted(sizes, reverse=True):
        if held + sizes[x] > KNOWN:
            break
        held, least = held + sizes[x], x
    top = sorted(counts.where(level >= least).collect(), key=lambda r: (-r.n, r.word)) if least is not None else []
    known, own, n = (np.array([r[i] for r in top], t) for i, t in enumerate((np.int64, np.int64, np.int64)))
    single = np.full(len(known), -1, np.int16)
    single[: SINGLE - 1] = np.arange(len(single[: SINGLE - 1]))
    if not (single[known == END] >= 0).all():
        single[known == END] = SINGLE - 1
    within_n, within_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        within_n[SINGLE + r.ending], within_v[SINGLE + r.ending] = r.n, r.v
    alone = single >= 0
    np.subtract.at(within_n, SINGLE + own[alone], n[alone])
    np.subtract.at(within_v, SINGLE + own[alone], 1)
    class_n = within_n.copy()
    class_n[single[alone]] = n[alone]
    bias = np.log((class_n + 0.5) / (class_n.sum() + 0.5 * CLASSES)).astype(np.float32)
    model = Model(known, n, single, np.zeros((FEATURES * BUCKETS, CLASSES), np.float32), bias, within_n + within_v + 1, int(total or 0), int(distinct))
    start(model, train)
    fit(model, sliced(train, scratch))
    return model, counts.select("word", "n")


def pair_counts(spread):
    """For mapInArrow: counts of a task's buckets by class, as packed blocks."""

    def run(batches):
        m, table, sums = spread.value, None, np.zeros(FEATURES * BUCKETS * CLASSES, np.int64)
        for batch in batches:
            table = table or m.table()
            for _, _, tokens, group, start_ in parts(batch, 1 << 20):
                y = m.classes(table.find(tokens), group)
                sums += np.bincount((features_of(tokens, start_) * np.int64(CLASSES) + y[:, None]).ravel(), minlength=len(sums))
        if table:
            yield from packed(sums.reshape(-1, CLASSES).astype(np.float32))

    return run


PACKED = "block int, part int, sums binary"


def packed(grid: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's sums in blocks of ``BLOCK`` buckets, so that a group of Spark's has few rows."""
    part = TaskContext.get().partitionId()
    for a in range(0, len(grid), 32 * BLOCK):
        own = range(a // BLOCK, min(a // BLOCK + 32, -(-len(grid) // BLOCK)))
        blocks = [np.ascontiguousarray(grid[i * BLOCK : (i + 1) * BLOCK]).tobytes() for i in own]
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())], names=["block", "part", "sums"])


def summed(rows: DataFrame, tasks: int) -> Iterator[tuple[int, np.ndarray]]:
    """(block, floats) of packed rows added up, in two levels: no task adds many more than the root of
    ``tasks`` rows, however many tasks there were."""

    def add(key, table):
        total = np.zeros(len(table.column("sums")[0].as_py()) // 4)
        for x in table.column("sums"):
            total += np.frombuffer(x.as_buffer(), np.float32)
        return pa.table({"block": table.column("block").slice(0, 1), "part": table.column("part").slice(0, 1), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    level = rows.withColumn("part", (F.col("part") / math.ceil(math.sqrt(max(tasks, 1)))).cast("int"))
    for keys in (("block", "part"), ("block",)):
        level = level.groupBy(*keys).applyInArrow(add, PACKED)
    for r in level.collect():
        yield r.block, np.frombuffer(r.sums, np.float32)


def start(model: Model, train: DataFrame) -> None:
    """Weights from the counts of features with classes over all training documents."""
    spread = train.sparkSession.sparkContext.broadcast(model)
    seen = np.zeros((FEATURES * BUCKETS, CLASSES), np.float32)
    for block, x in summed(train.select("text").mapInArrow(pair_counts(spread), PACKED), train.rdd.getNumPartitions()):
        seen[block * BLOCK : (block + 1) * BLOCK] = x.reshape(-1, CLASSES)
    spread.unpersist()
    share = np.exp(model.bias)
    ratio = np.log((seen + 20 * share) / (seen.sum(axis=1, keepdims=True) + 20)) - model.bias
    model.weights, model.seen = np.clip(ratio * DAMP, -LIMIT, LIMIT).astype(np.float32), seen


def gradients(spread):
    """For mapInArrow: the gradient of a task's documents by bucket, and how often each bucket was seen; the last row is the bias."""

    def run(batches):
        m, table = spread.value, None
        softmax, n = Softmax(m), FEATURES * BUCKETS
        expected, observed = np.zeros((CLASSES, n)), np.zeros(n * CLASSES, np.int64)
        expected_bias, observed_bias = np.zeros(CLASSES), np.zeros(CLASSES, np.int64)
        by_class = np.empty((CLASSES, SPAN))
        for batch in batches:
            table = table or m.table()
            for _, _, tokens, group, start_ in parts(batch, 1 << 20):
                y, features = m.classes(table.find(tokens), group), features_of(tokens, start_)
                observed += np.bincount((features * np.int64(CLASSES) + y[:, None]).ravel(), minlength=len(observed))
                observed_bias += np.bincount(y, minlength=CLASSES)
                for a in range(0, len(tokens), SPAN):
                    f = features[a : a + SPAN]
                    for b in range(0, len(f), STRIDE):
                        out, total = softmax.products(f[b : b + STRIDE])
                        np.divide(out.T, total, out=by_class[:, b : b + len(out)])
                    own = [np.ascontiguousarray(f[:, i], np.int64) - i * BUCKETS for i in range(FEATURES)]
                    for c in range(CLASSES):
                        p = by_class[c, : len(f)]
                        for i in range(FEATURES):
                            expected[c, i * BUCKETS : (i + 1) * BUCKETS] += np.bincount(own[i], p, BUCKETS)
                        expected_bias[c] += p.sum()
        if table:
            observed = observed.reshape(n, CLASSES)
            grid = np.zeros((n + 1, CLASSES + 1), np.float32)
            grid[:n, :-1], grid[:n, -1] = expected.T - observed, observed.sum(axis=1)
            grid[n, :-1], grid[n, -1] = expected_bias - observed_bias, observed_bias.sum()
            yield from packed(grid)

    return run


def sliced(train: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """(slice, text): the training documents, dealt by a hash to slices that lie in folders of their own, so that a round
    reads no other. Copies of a text under several ids are dealt to all slices, and count as often as they stand."""
    dealt = F.pmod(F.xxhash64("doc_id", "text", F.lit(31)), F.lit(rounds)).cast("int")
    train.select(dealt.alias("slice"), "text").write.partitionBy("slice").parquet(scratch.path("slices"))
    return train.sparkSession.read.schema("text string, slice int").parquet(scratch.path("slices"))


def fit(model: Model, slices: DataFrame, rounds: int = ROUNDS, step: float = STEP) -> None:
    """Gradient rounds, each over its slice, in as many tasks as reading it has. A step is divided by the pair's share of all
    counts (and ``FEW``), and moves no weight by more than itself; each is smaller than the last."""
    spark, whole = slices.sparkSession, model.seen.sum(axis=1, keepdims=True)
    for i in range(rounds):
        spread, now = spark.sparkContext.broadcast(model), step * DECAY**i
        own = slices.where(F.col("slice") == i).select("text")
        for block, x in summed(own.mapInArrow(gradients(spread), PACKED), own.rdd.getNumPartitions()):
            x, a = x.reshape(-1, CLASSES + 1), block * BLOCK
            if a == len(model.weights):
                # What classes were seen, from their share of all tokens.
                share = np.exp(model.bias) / np.exp(model.bias).sum() * max(x[0, -1], 1)
                model.bias = model.bias - (now * np.clip(x[0, :-1] / (share + FEW), -1, 1)).astype(np.float32)
            else:
                rows = slice(a, a + BLOCK)
                met = model.seen[rows] * x[:, -1:] / np.maximum(whole[rows], 1)
                model.weights[rows] = np.clip(model.weights[rows] - now * np.clip(x[:, :-1] / (met + FEW), -1, 1), -LIMIT, LIMIT)
        spread.unpersist()


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<struct<word:long,n:int>>"


def scorer(spread):
    """For mapInArrow over (doc_id, held_out, text): the part of each score that needs no
    count beyond the known words', and the other words with their numbers."""

    def run(batches):
        m, table = spread.value, None
        softmax = Softmax(m)
        for batch in batches:
            table = table or m.table()
            base_log = np.log10((m.counts + 1) / 1.0)
            class_log = np.append(np.zeros(0), np.log10(m.within))
            bottom = np.log10(m.total + m.distinct + 1)
            rows = {k: [] for k in ("n", "known", "base", "score", "rest")}
            for a, b, tokens, group, start_ in parts(batch):
                number = table.find(tokens)
                y = m.classes(number, group)
                features = features_of(tokens, start_)
                said = softmax.log_of(features, y)
                own = np.where(number >= 0, base_log[np.maximum(number, 0)], 0.0) if len(base_log) else np.zeros(len(tokens))
                inside = np.where(y >= SINGLE, own - class_log[y], 0.0)
                edges = start_[:-1]
                rows["n"] += np.diff(start_).tolist()
                rows["known"] += np.add.reduceat((number >= 0).astype(np.int64), edges).tolist()
                rows["base"] += np.add.reduceat(own - bottom, edges).tolist()
                rows["score"] += np.add.reduceat(said / LOG10 + inside, edges).tolist()
                doc = np.repeat(np.arange(b - a), np.diff(start_))
                other = number < 0
                order = np.lexsort((tokens[other], doc[other]))
                w, d = tokens[other][order], doc[other][order]
                new = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (d[1:] != d[:-1]))) if len(w) else np.zeros(0, np.int64)
                w, d, n = w[new], d[new], np.diff(np.append(new, len(order)))
                cut = np.searchsorted(d, np.arange(b - a + 1))
                rows["rest"].append((w, n, cut))
            words_, ns, at, base = [], [], [np.zeros(1, np.int64)], 0
            for w, n, cut in rows["rest"]:
                words_.append(w)
                ns.append(n)
                at.append(cut[1:] + base)
                base += len(w)
            rest = pa.ListArray.from_arrays(pa.array(np.concatenate(at).astype(np.int32)), pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *words_])), pa.array(np.concatenate([np.zeros(0, np.int64), *ns]).astype(np.int32))], names=["word", "n"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(rows["n"], pa.int64()), pa.array(rows["known"], pa.int64()), pa.array(rows["base"], pa.float64()), pa.array(rows["score"], pa.float64()), rest], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rest"])

    return run


def score(docs: DataFrame, scratch: Scratch, folds: int = 7, fold: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of
    ``docs`` (doc_id, text, ...), learned from the rows outside the held-out fold.

    Scores are log10 probabilities of whole texts and their end. Null or empty text is the
    end alone. A null doc_id is not held out. Repeated rows are learned from as often as they
    stand, and scored alike. With nothing to learn from every word is unknown. Other columns
    are ignored. An empty table gives an empty table."""
    rows = texts_of(docs, folds, fold)
    model, counts = learn(rows.where(~F.col("held_out")), scratch)
    spread = rows.sparkSession.sparkContext.broadcast(model)
    scored = scratch.keep(rows.mapInArrow(scorer(spread), SCORED).withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = scored.select("row", F.explode("rest").alias("x")).select("row", F.col("x.word").alias("word"), F.col("x.n").alias("m"))
    found = rest.join(counts, "word").groupBy("row").agg(F.sum("m").alias("more"), F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("log"))
    more, log = F.coalesce("more", F.lit(0)), F.coalesce("log", F.lit(0.0))
    return scored.drop("rest").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + log).alias("base_score"), (F.col("score") + log).alias("score"),
    )
