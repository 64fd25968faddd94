"""MinHash near-duplicate groups: many universal hash minima, banding, a check of the
signatures, confirmation on the full shingle sets, and connected components.

Scale: equal shingle sets are one class before anything is compared, and a class takes
part as one node, whose number follows the order of the classes' smallest documents. Each bucket of a band first links its members to the
member with the most copies, which is linear in the bucket. What is left are buckets whose
members are not all linked yet. Of each member of those, the shingles are counted that any
other such member has: two sets with n and m shingles of which at most s and t are shared
can't reach a similarity of 0.75 unless 7 * min(s, t) >= 3 * (n + m). That rules out, without
loss, the many members of a large group that have drifted too far. Shared shingles are told
apart by whether the bucket's head has them, which was counted before: what two sets have in
common is at most the lesser of either number, less what only one has lost of the head, which
256 bits a member bound from below. Few pairs are left to be compared. All groupings are summed up before the shuffle, and all other steps are joins
that Spark can divide when a key is hot."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import words
from quillspan.llm.components import components
from quillspan.llm.scratch import Scratch, unused

SHINGLE, PERCENT, BANDS, ROWS = 5, 75, 28, 4
#: Minima that must agree for a pair to be confirmed on its full sets. With 112 minima and a true
#: similarity of 0.75 fewer than 56 agree with a chance below 1e-8.
AGREE = 0.5
LOST = ("lost0", "lost1", "lost2", "lost3")
FEATURES = "doc_id long, text_key long, n_shingles int, set_hi long, set_lo long, bands array<long>, signature binary"
SET = ["n_shingles", "set_hi", "set_lo"]


def signatures(k: int, bands: int, rows: int, seed: int):
    """A function for mapInArrow: documents' set sizes, set digests, band keys and signatures."""
    n = bands * rows
    a, b = words.odd_numbers(n, seed)[:, None], words.odd_numbers(n, seed + 1)[:, None]
    weights = words.odd_numbers(rows, seed + 2)
    own_band = words.odd_numbers(bands, seed + 3)

    def minima(x: np.ndarray) -> np.ndarray:
        low = np.full(n, np.iinfo(np.uint64).max)
        for i in range(0, len(x), 1024):
            np.minimum(low, (x[None, i : i + 1024] * a + b).min(axis=1), out=low)
        return low

    def run(batches):
        for batch in batches:
            sizes, hi, lo, keys, signs = [], [], [], [], []
            for x in words.shingle_sets(batch.column("text"), k):
                sizes.append(len(x))
                p, q = struct.unpack("<qq", hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                hi.append(p)
                lo.append(q)
                if len(x):
                    low = minima(x) >> np.uint64(32)
                    keys.append(words.mix((low.reshape(bands, rows) * weights).sum(axis=1) ^ own_band))
                    signs.append((low & np.uint64(0xFFFF)).astype("<u2").tobytes())
                else:
                    keys.append(np.zeros(0, np.uint64))
                    signs.append(b"")
            at = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.ListArray.from_arrays(at, flat), pa.array(signs, pa.binary())],
                names=["doc_id", "text_key", *SET, "bands", "signature"],
            )

    return run


def confirm(k: int, percent: int):
    """A function for mapInArrow: the number of shingles that both of a pair have, whether their full
    sets reach the similarity, and 256 bits for the shingles of u that v hasn't, by their hash."""

    def run(batches):
        kept_id, kept = None, None
        for batch in batches:
            own = list(words.shingle_sets(batch.column("text_v"), k))
            ids, texts = batch.column("u"), batch.column("text_u")
            common, yes, lost = np.zeros(len(own), np.int64), np.zeros(len(own), bool), np.zeros((len(own), 4), np.int64)
            for i, y in enumerate(own):
                if (u := ids[i].as_py()) != kept_id:
                    kept_id, kept = u, next(words.shingle_sets(texts.slice(i, 1), k))
                common[i] = n = len(np.intersect1d(kept, y, assume_unique=True))
                yes[i] = n > 0 and 100 * n >= percent * (len(kept) + len(y) - n)
                bits = np.zeros(256, bool)
                bits[np.setdiff1d(kept, y, assume_unique=True) & np.uint64(255)] = True
                lost[i] = np.packbits(bits).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, batch.column("v"), pa.array(common), pa.array(yes), *map(pa.array, np.ascontiguousarray(lost.T))], names=["u", "v", "common", "linked", *LOST])

    return run


def agreeing(bands: int, rows: int):
    """A function for mapInArrow: candidate pairs whose signatures agree in enough minima."""
    least = int(AGREE * bands * rows)

    def run(batches):
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, bands * rows) for c in ("sig_u", "sig_v"))
            mask = pa.array((left == right).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("u", "v")], names=["u", "v"])

    return run


def near_duplicates(docs: DataFrame, scratch: Scratch, k: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, seed: int = 11) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, ...).

    Two documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of
    ``k``-word shingles. component_id is the least doc_id that links lead to, itself included;
    kept says whether it is the document's own.

    Null or empty text, or text without words: an empty set, linked with nothing. A null
    doc_id: component_id null, kept true. Rows that repeat a doc_id are each
    placed by their own text.
    Other columns are ignored. An empty table gives an empty table.

    The minima find a pair of similarity 0.75 with a chance of 1 - (1 - 0.75**rows)**bands,
    0.99998 here, and nearly surely the more similar ones and those that others link."""
    out = placed(docs, scratch, k, percent, bands, rows, seed)
    out = out.select("doc_id", F.col("n_shingles").cast("long"), F.when(F.col("doc_id").isNotNull(), F.coalesce("first_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, which tells rows of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))


def placed(docs: DataFrame, scratch: Scratch, k: int, percent: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, first_id, first_key): the row that comes first, by doc_id and then
    text_key, of those that links lead to; null for empty sets and null ids."""
    found = scratch.keep(keyed(docs).mapInArrow(signatures(k, bands, rows, seed), FEATURES), "features")
    sets = found.where("n_shingles > 0 and doc_id is not null")
    firsts = sets.groupBy(*SET).agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("copies")).select("first.*", *SET, "copies")
    # Numbers of classes grow with their first rows.
    classes = scratch.keep(firsts.repartitionByRange("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key").withColumn("node", F.monotonically_increasing_id()), "classes")
    heads = classes.select("doc_id", "text_key", "node", "copies")
    reps = sets.select("doc_id", "text_key", "n_shingles", "bands", "signature").join(heads, ["doc_id", "text_key"]).dropDuplicates(["node"])
    reps = scratch.keep(reps.select(F.col("node").alias("doc_id"), "n_shingles", "copies", "bands", "signature"), "reps")
    found = scratch.keep(found.select("doc_id", "text_key", *SET), "sets")
    scratch.drop("features")
    rows_of = reps.select("doc_id", "n_shingles", "copies", F.posexplode("bands").alias("band", "key"))
    shared = rows_of.groupBy("band", "key").agg(F.max(F.struct("copies", -F.col("doc_id"))).alias("head"), F.count("*").alias("n")).where("n > 1")
    shared = shared.select("band", "key", (-F.col("head.col2")).alias("head"))
    member = scratch.keep(rows_of.join(shared, ["band", "key"]).drop("copies"), "members")

    wanted = classes.select("doc_id", "text_key", "node").join(member.select(F.col("doc_id").alias("node")).distinct(), "node", "left_semi")
    texts = keyed(docs).join(wanted.hint("merge"), ["doc_id", "text_key"]).select(F.col("node").alias("doc_id"), "text")
    texts = scratch.keep(texts, "texts", compression="zstd")

    near = scratch.keep(_links(member.where("doc_id != head").select(F.col("head").alias("u"), F.col("doc_id").alias("v")).distinct(), reps, texts, scratch, "near", k, percent, bands, rows), "near")
    tied = near.where("linked").select("u", "v")
    placed = scratch.keep(member.join(_labels(tied), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id")), "placed")
    open_ = placed.groupBy("band", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("band", "key")
    part = scratch.keep(placed.join(open_, ["band", "key"], "left_semi"), "open")
    able = part.join(_shared_counts(part, texts, scratch, k), "doc_id").where(f"{100 + percent} * s >= {percent} * n_shingles + {percent} * ceil(n_shingles * {percent / 100})")
    to_head = near.select(F.col("u").alias("head"), F.col("v").alias("doc_id"), F.col("common").alias("r"), *LOST).dropDuplicates(["head", "doc_id"])
    able = able.join(to_head, ["head", "doc_id"], "left")
    # Shared shingles that the head has (r) and hasn't (x). Where the head wasn't compared, all may be of either sort.
    own = F.col("doc_id") == F.col("head")
    able = able.withColumn("known", own | F.col("r").isNotNull()).withColumns({"r": F.when(own, F.col("n_shingles")).otherwise(F.coalesce("r", "s")), "x": F.when(own, 0).when(F.col("r").isNull(), F.col("s")).otherwise(F.col("s") - F.least("r", "s"))})
    part = scratch.keep(able.fillna(0, [*LOST]).drop("head"), "able")
    renamed = {"doc_id": "v", "c": "d", "n_shingles": "m", "s": "t", "r": "q", "x": "y", "known": "known_v"} | {c: f"{c}_v" for c in LOST}
    other = part.withColumnsRenamed(renamed)
    # The head's shingles that one has and the other has lost: one at least for each bit.
    only_u, only_v = (" + ".join(f"bit_count({c}{b} & ~{c}{a})" for c in LOST) for a, b in (("", "_v"), ("_v", "")))
    of_head = f"case when known and known_v then least(r - ({only_u}), q - ({only_v})) else least(r, q) end"
    possible = f"c < d and {100 + percent} * least(s, t, {of_head} + least(x, y)) >= {percent} * (n_shingles + m)"
    pairs = part.withColumnRenamed("doc_id", "u").join(other, ["band", "key"]).where(possible)
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    more = scratch.keep(_links(pairs, reps, texts, scratch, "rest", k, percent, bands, rows), "more").where("linked").select("u", "v")
    scratch.drop("members", "placed", "open", "able", "shingles", "texts")

    alike = components(tied.unionByName(more), scratch).select(F.col("u").alias("node"), F.col("v").alias("c"))
    scratch.drop("reps", "near", "more", "near-likely", "rest-likely")
    named = classes.select(*SET, "node").join(alike, "node", "left").select(*SET, F.coalesce("c", "node").alias("c"))
    named = named.join(classes.select(F.col("node").alias("c"), F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key")), "c").drop("c")
    known = F.col("doc_id").isNotNull()
    return found.join(named, SET, "left").select("doc_id", "text_key", "n_shingles", *(F.when(known, F.col(c)).alias(c) for c in ("first_id", "first_key")))


def _labels(tied: DataFrame) -> DataFrame:
    """(doc_id, c): of linked documents the least id within two links. Equal labels are of one
    component; documents of one component may still differ, and are then compared once more."""
    both = tied.select("u", "v").unionByName(tied.select(F.col("v").alias("u"), F.col("u").alias("v")))
    one = both.groupBy("u").agg(F.least("u", F.min("v")).alias("c"))
    return both.join(one.select(F.col("u").alias("v"), "c"), "v").groupBy(F.col("u").alias("doc_id")).agg(F.min("c").alias("c"))


def _shared_counts(part: DataFrame, texts: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """(doc_id, s): at most so many shingles of a document are in any other document of ``part``.
    Shingles go by 32 bits of their hash, which can only raise the count."""

    def explode(batches):
        for batch in batches:
            ids, first = batch.column("doc_id").to_numpy(), 0
            for texts in (batch.column("text").slice(i, 256) for i in range(0, len(batch), 256)):
                sets = list(words.shingle_sets(texts, k))
                flat = np.concatenate([np.zeros(0, np.uint64), *sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[first : first + len(sets)], [len(x) for x in sets])), pa.array((flat >> np.uint64(32)).astype(np.uint32).view(np.int32))], names=["doc_id", "g"])
                first += len(sets)

    own = _texts(texts, part.select("doc_id").distinct())
    rows = scratch.keep(own.mapInArrow(explode, "doc_id long, g int"), "shingles")
    common = rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    return rows.join(common, "g").groupBy("doc_id").agg(F.count("*").alias("s"))


def _texts(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of some documents. Both sides are always shuffled: how many ids there are
    grows with the documents, so that a plan that broadcasts them is one for small tables only."""
    return texts.join(ids.hint("merge"), "doc_id", "left_semi")


def _links(pairs: DataFrame, reps: DataFrame, texts: DataFrame, scratch: Scratch, name: str, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """Of candidate pairs (u, v), (common, linked) for those that may reach the similarity by size and signature."""
    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"sig_{c}"))
    sized = pairs.join(side("u"), "u").join(side("v"), "v").where(f"100 * least(n_u, n_v) >= {percent} * greatest(n_u, n_v)")
    likely = scratch.keep(sized.select("u", "v", "sig_u", "sig_v").mapInArrow(agreeing(bands, rows), "u long, v long"), f"{name}-likely")
    with_u = likely.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
    with_both = with_u.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")
    return with_both.mapInArrow(confirm(k, percent), f"u long, v long, common long, linked boolean, {' long, '.join(LOST)} long")


def drop_near_duplicates(docs: DataFrame, scratch: Scratch, k: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, seed: int = 11) -> DataFrame:
    """``docs`` with one row of each component, the first by doc_id and then a hash of its text; all columns stay.

    Rows are told apart by doc_id and text: of those that repeat both one stays, and rows that
    repeat a doc_id with other texts are judged each by its own. Rows with a null doc_id stay, and so do empty texts."""
    found = placed(docs, scratch, k, percent, bands, rows, seed)
    d, t = unused(docs, "_d"), unused(docs, "_t")
    gone = found.where("not (doc_id = first_id and text_key = first_key)").select(F.col("doc_id").alias(d), F.col("text_key").alias(t)).distinct()
    named = docs.where("doc_id is not null").withColumns({d: F.col("doc_id").cast("long"), t: F.xxhash64(F.col("text").cast("string"))})
    kept = named.join(gone.hint("merge"), [d, t], "left_anti").dropDuplicates([d, t])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))
