"""Token ids in patched frame-of-reference blocks.

A corpus is a folder of shards in the order of doc_id, written by Spark so that any
store it reaches will do: one row a shard, with the part that wrote it, its number and
start in the part, and ``payload``, the shard itself:

    magic "PFB1", block length, count of ids, blocks, documents     5 x u32
    for each block: byte offset (u64), minimum (u32), width (u8), exceptions (u16)
    for each document: doc_id (i64), known (u8), ids (u32)
    packed words (u64) of the blocks, each block: ids less its minimum, their low
    ``width`` bits; then for each exception its place (u8) and what was cut off (u32)

A block's width is the least that holds the given percentile of its ids; the rest are
exceptions. The offsets let a reader decode the blocks of one document alone."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm import words

MAGIC, BLOCK, PERCENTILE, SHARD_IDS, UNITS = b"PFB1", 128, 90, 1 << 20, 300_000
SHARDS = "part int, shard int, start_in_part long, n_ids long, n_docs int, payload binary"
READ = "doc_id long, part int, start_in_part long, n_tokens long, ids binary"
HEADER = struct.Struct("<4s4I")


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 numbers of ``width`` bits to rows of ``width`` 64-bit words."""
    out = np.zeros((width, len(low)), np.uint64)
    lanes = np.ascontiguousarray(low.T)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        out[word] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.T)
    out, mask = np.zeros((64, len(words)), np.uint64), np.uint64((1 << width) - 1)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        out[j] = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            out[j] |= lanes[word + 1] << np.uint64(64 - shift)
    return np.ascontiguousarray((out & mask).T)


def encode_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], percentile: int = PERCENTILE) -> bytes:
    """Ids (u32) of whole documents, one after another, as one shard."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint32)
    grid[:n] = ids
    if blocks:
        grid[n:] = ids[-1]
    grid = grid.reshape(blocks, BLOCK)
    least = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = (grid - least[:, None]).astype(np.uint64)
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    rank = min(BLOCK - 1, max(0, -(-BLOCK * percentile // 100) - 1))
    width = np.partition(bits, rank, axis=1)[:, rank] if blocks else np.zeros(0, np.uint8)
    over = bits > width[:, None]
    patches = over.sum(axis=1).astype(np.int64)
    sizes = 16 * width.astype(np.int64) + 5 * patches
    at = np.zeros(blocks, np.int64)
    np.cumsum(sizes[:-1], out=at[1:])
    body = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        if w:
            packed = _pack((rest[own] & np.uint64((1 << w) - 1)).reshape(-1, 64), w).reshape(len(own), 2 * w)
            body[at[own][:, None] + np.arange(16 * w)] = packed.view(np.uint8).reshape(len(own), 16 * w)
    block, place = np.nonzero(over)
    order = np.arange(len(block)) - np.repeat(np.cumsum(patches) - patches, patches)
    spot = at[block] + 16 * width[block].astype(np.int64)
    body[spot + order] = place
    cut = (rest[block, place] >> width[block].astype(np.uint64)).astype("<u4").view(np.uint8).reshape(-1, 4)
    body[(spot + patches[block] + 4 * order)[:, None] + np.arange(4)] = cut
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join((
        HEADER.pack(MAGIC, BLOCK, n, blocks, len(doc_ids)), at.astype("<u8").tobytes(), least.astype("<u4").tobytes(), width.tobytes(), patches.astype("<u2").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), np.array(lengths, "<u4").tobytes(), body.tobytes(),
    ))


class Shard:
    """Reads a shard's index; decodes only the blocks asked for."""

    def __init__(self, payload: bytes):
        magic, block, self.n, self.blocks, docs = HEADER.unpack_from(payload)
        if magic != MAGIC or block != BLOCK:
            raise ValueError("not a shard of this format")
        at = HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(payload, kind, n, at)
            at += x.nbytes
            return x

        self.at, self.least, self.width, self.patches = take("<u8", self.blocks).astype(np.int64), take("<u4", self.blocks), take("u1", self.blocks), take("<u2", self.blocks)
        ids, known = take("<i8", docs), take("u1", docs)
        self.doc_ids = [d if k else None for d, k in zip(ids.tolist(), known.tolist(), strict=True)]
        self.lengths = take("<u4", docs).astype(np.int64)
        self.body = np.frombuffer(payload, np.uint8, offset=at)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids number ``first`` to ``last``, without decoding other blocks."""
        last = self.n if last is None else min(last, self.n)
        if first >= last:
            return np.zeros(0, np.uint32)
        low, high = first // BLOCK, -(-last // BLOCK)
        width, at, patches = self.width[low:high], self.at[low:high], self.patches[low:high].astype(np.int64)
        out = np.zeros((high - low, BLOCK), np.uint64)
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            if w:
                raw = self.body[at[own][:, None] + np.arange(16 * w)]
                out[own] = _unpack(np.ascontiguousarray(raw).view("<u8").reshape(-1, w), w).reshape(len(own), BLOCK)
        block = np.repeat(np.arange(high - low), patches)
        order = np.arange(len(block)) - np.repeat(np.cumsum(patches) - patches, patches)
        spot = at[block] + 16 * width[block].astype(np.int64)
        place = self.body[spot + order]
        cut = self.body[(spot + patches[block] + 4 * order)[:, None] + np.arange(4)].view("<u4").reshape(-1)
        out[block, place] |= cut.astype(np.uint64) << width[block].astype(np.uint64)
        out += self.least[low:high, None]
        return out.reshape(-1)[first - low * BLOCK : last - low * BLOCK].astype(np.uint32)


#: White space of the tokenizer beyond ASCII, which may belong to a run of ASCII white space beside it.
OTHER_SPACE = re.compile("[" + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
WINDOW, PIECE = 1 << 20, 4 << 20
SPACE, LETTER, DIGIT, QUOTE, OTHER, HIGH = range(6)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[128:] = HIGH
CLASS[words.SPACE] = SPACE
CLASS[[*range(65, 91), *range(97, 123)]], CLASS[48:58], CLASS[39] = LETTER, DIGIT, QUOTE
#: Whether a new unit begins between two bytes of these classes, neither being white space. A tokenizer's
#: piece never goes on from a letter or digit to what is neither, nor from a sign to a letter unless
#: the sign is a quote; what bytes beyond ASCII are isn't looked at.
CUT = np.zeros((6, 6), bool)
CUT[LETTER, [DIGIT, QUOTE, OTHER]] = CUT[DIGIT, [LETTER, QUOTE, OTHER]] = CUT[OTHER, [LETTER, DIGIT]] = True
#: Encoders that a Python worker has made, by path and size.
_loaded: dict[tuple[str, int], CachedEncoder] = {}


def unit_starts(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where units begin: pieces of text that the tokenizer treats alike wherever they stand. A word has the
    space before it; other white space is a unit but for its last character, which is one of its own."""
    n = len(data)
    kind = CLASS[data]
    first = np.zeros(n + 1, bool)
    first[begin[begin < n]], first[n] = True, True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = OTHER, kind[:-1]
    solid = kind != SPACE
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    start = np.where(solid, np.where(before == SPACE, np.append(np.uint8(0), data[:-1]) != 0x20, CUT[before, kind]), (before != SPACE) | (after & ~first[1:]))
    return start | first[:-1]


class Units:
    """What is known of units: their bytes and their ids, found by a hash through an open-addressed table."""

    def __init__(self):
        self.n, self.slots = 0, np.full(1 << 16, -1, np.int32)
        self.keys, self.at, self.size, self.first, self.count = (np.zeros(1 << 14, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
        self.text, self.ids, self.n_text, self.n_ids = np.zeros(1 << 17, np.uint8), np.zeros(1 << 15, np.uint32), 0, 0

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * words.BASE) >> np.uint64(64 - (len(self.slots).bit_length() - 1))).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's unit, -1 where there is none."""
        spot = self._spot(keys)
        out = self.slots[spot]
        left = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(left):
            spot[left] = (spot[left] + 1) & (len(self.slots) - 1)
            out[left] = self.slots[spot[left]]
            left = left[(out[left] >= 0) & (self.keys[out[left]] != keys[left])]
        return out

    def _place(self, number: np.ndarray) -> None:
        spot = self._spot(self.keys[number])
        while len(number):
            free = self.slots[spot] < 0
            self.slots[spot[free]] = number[free]
            wait = self.slots[spot] != number
            number, spot = number[wait], (spot[wait] + 1) & (len(self.slots) - 1)

    def add(self, keys: np.ndarray, text: np.ndarray, size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Units that aren't known yet: their hashes, bytes and ids."""
        n = self.n + len(keys)
        for name, more, used in (*((c, len(keys), self.n) for c in ("keys", "at", "size", "first", "count")), ("text", len(text), self.n_text), ("ids", len(ids), self.n_ids)):
            old = getattr(self, name)
            if used + more > len(old):
                setattr(self, name, np.concatenate([old[:used], np.zeros(max(more, used), old.dtype)]))
        own = slice(self.n, n)
        self.keys[own], self.size[own], self.count[own] = keys, size, count
        self.at[own], self.first[own] = self.n_text + np.cumsum(size) - size, self.n_ids + np.cumsum(count) - count
        self.text[self.n_text : self.n_text + len(text)], self.ids[self.n_ids : self.n_ids + len(ids)] = text, ids
        first, self.n, self.n_text, self.n_ids = self.n, n, self.n_text + len(text), self.n_ids + len(ids)
        if n * 2 > len(self.slots):
            self.slots, first = np.full(1 << (4 * n - 1).bit_length(), -1, np.int32), 0
        self._place(np.arange(first, n, dtype=np.int32))


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Every place of the given stretches, one stretch after another."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class CachedEncoder:
    """Encodes texts as the tokenizer does, each distinct unit once: units are told by a hash and compared
    by their bytes, all in numpy, and only new ones go to the tokenizer. About ``most`` units, and 32 bytes of
    text for each of so many, are held; then those seen since the half was reached are kept."""

    def __init__(self, path: str, most: int = UNITS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.units = Tokenizer.from_file(path), most, Units()
        self.seen = np.zeros(0, bool)
        #: Ids of tokens that begin with a space, and of a line end.
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, keys: np.ndarray) -> None:
        """Add new units. Those that begin with a space are encoded as one text, and cut where tokens do; those without
        white space as one with line ends between; others alone."""
        raw = lambda a, n: data[a : a + n].tobytes().decode("utf-8", "replace")
        space = CLASS[data[start]] == SPACE
        alone = space & ((size == 1) | (CLASS[data[np.minimum(start + 1, len(data) - 1)]] == SPACE))
        lead = np.cumsum(np.append(0, np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3))))
        for i in np.flatnonzero(lead[start + size] > lead[start]).tolist():
            alone[i] = alone[i] or OTHER_SPACE.search(raw(start[i], size[i])) is not None
        for own, gap in ((np.flatnonzero(space & ~alone), 0), (np.flatnonzero(~space & ~alone), 1)):
            for i in range(0, len(own), 8192):
                part = own[i : i + 8192]
                a, n = start[part], size[part]
                at = spans(a, n)
                text = np.full(len(at) + gap * len(part), 10, np.uint8)
                text[np.arange(len(at)) + gap * np.repeat(np.arange(len(part)), n)] = data[at]
                ids = self._ids([text.tobytes().decode("utf-8", "replace")])[0]
                mark = ids == self.line[0] if gap else self.opens[ids]
                cut = np.append(np.flatnonzero(mark), [] if gap else len(ids)).astype(np.int64)
                count = np.diff(cut, prepend=-1) - 1 if gap else np.diff(cut)
                if len(count) != len(part) or not (gap or cut[0] == 0):
                    raise ValueError("this tokenizer doesn't begin words with a space, or has no token for a line end")
                self.units.add(keys[part], data[at], n, ids[~mark] if gap else ids, count)
        if len(own := np.flatnonzero(alone)):
            ids = self._ids([raw(a, n) for a, n in zip(start[own].tolist(), size[own].tolist(), strict=True)])
            self.units.add(keys[own], data[spans(start[own], size[own])], size[own], np.concatenate(ids), np.array([len(x) for x in ids]))

    def _forget(self) -> None:
        """Keep the units seen lately."""
        u, own = self.units, np.flatnonzero(self.seen[: self.units.n])
        self.units, self.seen = Units(), np.zeros(0, bool)
        if len(own) * 2 < self.most and u.size[own].sum() < 16 * self.most:
            self.units.add(u.keys[own], u.text[spans(u.at[own], u.size[own])], u.size[own], u.ids[spans(u.first[own], u.count[own])], u.count[own])

    def _window(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a window's units, how many each has, and which units' hash is another's (all, if their lengths differ)."""
        size = np.diff(np.append(start, len(data)))
        up, down = words.powers(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        keys = words.mix((total[start + size] - total[start]) * down[start] + size.astype(np.uint64))
        u = self.units
        number = u.find(keys)
        new = np.flatnonzero(number < 0)
        if len(new):
            own = new[np.unique(keys[new], return_index=True)[1]]
            self._learn(data, start[own], size[own], keys[own])
            number[new] = u.find(keys[new])
        if len(self.seen) < u.n:
            self.seen = np.concatenate([self.seen, np.zeros(max(u.n - len(self.seen), len(self.seen)), bool)])
        if 2 * u.n > self.most or u.n_text > 16 * self.most:
            self.seen[number] = True
        bad = u.size[number] != size
        bad[:] = bad.any()
        if not bad.any():
            bad[np.searchsorted(start, np.flatnonzero(u.text[spans(u.at[number], size)] != data), "right") - 1] = True
        count = u.count[number]
        return u.ids[spans(u.first[number], count)], count, bad

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> set[int]:
        """Documents with a special token's text, or with other white space beside ASCII white space: units
        may not be cut there as the tokenizer would, so these are encoded as a whole."""
        places = [np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))]
        near = words.SPACE[data]
        for lead in (0xC2, 0xE1, 0xE2, 0xE3):
            at = np.flatnonzero(data == lead)
            width = 2 if lead == 0xC2 else 3
            at = at[at + width <= len(data)]
            beside = near[np.maximum(at - 1, 0)] | near[np.minimum(at + width, len(data) - 1)]
            places.append(np.array([i for i in at[beside].tolist() if OTHER_SPACE.match(data[i : i + width].tobytes().decode("utf-8", "replace"))], np.int64))
        return set((np.searchsorted(offsets, np.concatenate(places), "right") - 1).tolist())

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has. What is held besides is bounded by the
        window and the longest run without white space."""
        n = len(data)
        odd, parts, counts, a = (self._odd(data, offsets) if n > 1 else set()), [], np.zeros(len(offsets) - 1, np.int64), 0
        size = WINDOW
        while a < n:
            if self.units.n > self.most or self.units.n_text > 32 * self.most:
                self._forget()
            b = min(a + size, n)
            low = max(a - 1, 0)
            start = np.flatnonzero(unit_starts(data[low : min(b + 1, n)], offsets[(offsets >= low) & (offsets <= b)] - low)) + low
            start = start[(start >= a) & (start < b)]
            if b < n:
                # The last unit may go on beyond the window.
                if len(start) < 2:
                    size *= 2
                    continue
                b, start = int(start[-1]), start[:-1]
            ids, count, bad = self._window(data[a:b], start - a)
            doc = np.searchsorted(offsets, start, "right") - 1
            counts += np.bincount(doc, count, len(counts)).astype(np.int64)
            odd.update(doc[bad].tolist())
            parts.append(ids)
            a, size = b, WINDOW
        ids = np.concatenate([np.zeros(0, np.uint32), *parts])
        if odd:
            edges = np.concatenate([[0], np.cumsum(counts)])
            out, last = [], 0
            own = sorted(odd)
            for i, x in zip(own, self._ids([data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in own]), strict=True):
                out += (ids[edges[last] : edges[i]], x)
                counts[i], last = len(x), i + 1
            ids = np.concatenate([*out, ids[edges[last] :]])
        return ids, counts

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian u32."""
        ids, counts = self.encode_all(*words.utf8(pa.array(texts, pa.string())))
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(texts) else []


def _encoder(path: str, most: int) -> CachedEncoder:
    if (path, most) not in _loaded:
        _loaded[path, most] = CachedEncoder(path, most)
    return _loaded[path, most]


def _writer(tokenizer: str, end_id: int, percentile: int, units: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, units)
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        docs, lengths, parts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, start, docs, lengths, parts, held
            ids = np.concatenate(parts)
            row = pa.RecordBatch.from_pydict(
                {"part": [part], "shard": [shard], "start_in_part": [start], "n_ids": [len(ids)], "n_docs": [len(docs)], "payload": [encode_shard(ids, docs, lengths, percentile)]},
                schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("start_in_part", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int32()), ("payload", pa.binary())]),
            )
            shard, start, docs, lengths, parts, held = shard + 1, start + len(ids), [], [], [], 0
            return row

        for batch in batches:
            data, offsets = words.utf8(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for a, b in words.chunks(offsets, PIECE):
                own = offsets[a : b + 1]
                ids, counts = encoder.encode_all(data[own[0] : own[-1]], own - own[0])
                # Each document's ids are moved on by the ends before it.
                ended = np.full(len(ids) + b - a, end_id, np.uint32)
                ended[np.arange(len(ids)) + np.repeat(np.arange(b - a), counts)] = ids
                docs += names[a:b]
                lengths += (counts + 1).tolist()
                parts.append(ended)
                held += len(ended)
                if held >= SHARD_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, percentile: int = PERCENTILE, units: int = UNITS) -> None:
    """Encode every whole text of ``docs`` (doc_id, text, ...) and write shards under ``path``.

    Documents stand in ascending order of doc_id, null first; equal doc_ids in the order of
    a hash of their text. ``end_id`` follows each document; null or empty text is that id
    alone. Other columns are ignored. Without documents no shard is written. A worker holds
    about 400 bytes for each of ``units``."""
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(_writer(tokenizer, end_id, percentile, units), SHARDS).write.option("compression", "none").parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row["payload"])
            ids = shard.ids().astype("<u4")
            begin = np.concatenate([[0], np.cumsum(shard.lengths)])
            n = len(shard.lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.doc_ids, pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array(row["start_in_part"] + begin[:-1]), pa.array(shard.lengths), pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((begin * 4).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())],
                names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a written corpus; ``start`` counts
    the ids of all documents before it, ``ids`` are little-endian u32.

    Starts need one number for each part that was written, so that table is as long as the
    writing stage had tasks, and is small enough to be broadcast."""
    shards = spark.read.schema(SHARDS).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = parts.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    docs = shards.select("part", "start_in_part", "payload").mapInArrow(_reader, READ)
    return docs.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")
