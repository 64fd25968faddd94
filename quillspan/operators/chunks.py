"""Blocks to chunks of bounded token counts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions import vectors as V
from quillspan.functions.vectors import hash_embed
from quillspan.operators.ordered import changes

CHUNKS = "doc_id {}, chunk_no int, title_path array<string>, content string, n_tokens int"
# Fixed values, as in quillspan.functions.text.
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_CJK = re.compile("([一-鿿])")
_SENTENCE = re.compile(r"(?<=[。.?!])[ \t\n\x0b\f\r]+|\n\n|\n")


def effective_min(blocks: DataFrame, least: int = 500) -> DataFrame:
    """(doc_id, n_blocks, n_chars, min_tokens): documents of fewer than 30 blocks need no more tokens than they have characters."""
    sums = blocks.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))
    return sums.withColumn("min_tokens", F.when(F.col("n_blocks") < 30, F.least(F.lit(least).cast("long"), "n_chars")).otherwise(F.lit(least).cast("long")))


def block_lists(blocks: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, ``keep``, blocks) of rows that are blocks, or as it is where a row is a document already: only the first needs a shuffle."""
    if "blocks" in blocks.columns:
        return blocks.select("doc_id", *keep, "blocks")
    return blocks.groupBy("doc_id").agg(*(F.first(c).alias(c) for c in keep), F.sort_array(F.collect_list(F.struct("block_no", "type", "level", "text"))).alias("blocks"))


def title_paths(blocks: DataFrame) -> DataFrame:
    """Text blocks with the headings above them: a title of level L (1 without one) cuts the stack to L - 1 entries and is
    put on it. Linear in the blocks of a document either way:

    Rows that are whole documents (:func:`block_lists`) stay where they are; their blocks pass by as a stream, and a task holds one
    stack of headings. Rows that are blocks are shuffled once, and windows find the stack: the i-th title of a document
    stands at depth i + min(0, least of level - number so far), as each title is at most one deeper than the last, and
    what stands at a depth is the last title that did, down to the depth of the last title at all."""
    kind = dict(blocks.dtypes)["doc_id"]
    if "blocks" in blocks.columns:
        rows = blocks.select("doc_id", "blocks", F.monotonically_increasing_id().alias("_doc")).select("doc_id", "_doc", F.inline("blocks"))
        return rows.select("doc_id", "_doc", "block_no", "type", "level", "text").mapInArrow(_with_titles, f"doc_id {kind}, block_no int, title_path array<string>, text string")
    title, level = F.coalesce(F.col("type") == "title", F.lit(False)), F.greatest(F.coalesce("level", F.lit(1)), F.lit(1))
    deepest = blocks.agg(F.max(F.when(title, level))).first()[0] or 1
    upto = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.select("doc_id", F.col("block_no").cast("int"), "text", title.alias("_title"), F.count_if(title).over(upto).alias("_i"), level.alias("_level"))
    depth = F.col("_i") + F.least(F.lit(0), F.min(F.when(F.col("_title"), F.col("_level") - F.col("_i"))).over(upto))
    rows = rows.withColumn("_depth", F.when(F.col("_title"), depth))
    stack = F.array(*(F.last(F.when(F.col("_depth") == d, F.col("text")), ignorenulls=True).over(upto) for d in range(1, deepest + 1)))
    rows = rows.select("doc_id", "block_no", "text", "_title", stack.alias("_stack"), F.last("_depth", ignorenulls=True).over(upto).alias("_now"))
    return rows.where("not _title").select("doc_id", "block_no", F.slice("_stack", F.lit(1), F.coalesce("_now", F.lit(0)).cast("int")).alias("title_path"), "text")


def _with_titles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, doc = [], None
    for batch in batches:
        if not len(batch):
            continue
        own = batch.column("_doc")
        new = changes([own])
        new[0] = doc is None or own[0].as_py() != doc[0]
        doc = (own[-1].as_py(),)
        title = pc.fill_null(pc.equal(batch.column("type"), "title"), False).to_numpy(zero_copy_only=False)
        # A stack for each place where it changes; rows between share it.
        at = np.flatnonzero(new | title)
        stacks = [path]
        for i, level, text in zip(at.tolist(), batch.column("level").take(pa.array(at)).to_pylist(), batch.column("text").take(pa.array(at)).to_pylist(), strict=True):
            path = [] if new[i] else path
            if title[i]:
                path = [*path[: max(0, (1 if level is None else level) - 1)], text]
            stacks.append(path)
        rows = pa.array(np.flatnonzero(~title))
        which = np.cumsum(new | title)[~title]
        columns = [batch.column("doc_id").take(rows), batch.column("block_no").take(rows).cast(pa.int32()), pa.array(stacks, pa.list_(pa.string())).take(pa.array(which)), batch.column("text").take(rows)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "block_no", "title_path", "text"])


def build_chunks(
    blocks: DataFrame, least: int = 500, most: int = 2000, split: bool = False, keep_tail: bool = False,
    tokens: Callable[[str], int] | V.Hook | None = None, embed: Callable[[pd.Series], np.ndarray] = hash_embed, percentile: float | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Greedy packing of each document's blocks, in order.

    A heading, a text that would go beyond ``most`` tokens, and a text of at least ``most``
    end a chunk; one below the document's minimum isn't given out but carried on, and is
    lost at the end of the document unless ``keep_tail``. Token counts of a chunk are those
    of its joined text: by the library's rule, or by ``tokens``, a tokenizer's count of one text with its special tokens, or a hook that loads one.
    ``split`` cuts chunks beyond ``most`` where neighbouring sentences are least alike by ``embed`` (see :func:`cut`).
    Rows of ``blocks`` are blocks, which are brought together once, or whole documents (:func:`block_lists`), which
    stay where they are; columns ``keep`` of a document go with its chunks. The fold is linear."""
    lists = block_lists(blocks, *keep)
    count = (lambda t: T.words(t)) if tokens is None else (lambda t: F.lit(0))
    one = lambda b: F.struct(b["type"].alias("type"), F.coalesce(b["level"], F.lit(1)).alias("level"), b["text"].alias("text"), count(b["text"]).alias("n"))
    chars = F.aggregate("blocks", F.lit(0).cast("long"), lambda s, b: s + F.coalesce(F.length(b["text"]), F.lit(0)))
    docs = lists.select("doc_id", *keep, F.transform("blocks", one).alias("b"), F.size("blocks").alias("n_blocks"), chars.alias("n_chars"))

    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, model = V.resolved(tokens), V.resolved(embed)
        for batch in batches:
            for part in _parts(batch):
                found = [
                    (i, k, *c)
                    for i, (blocks_, n, chars) in enumerate(zip(*(part.column(c).to_pylist() for c in ("b", "n_blocks", "n_chars")), strict=True))
                    if blocks_ is not None
                    for k, c in enumerate(pack(blocks_, min(least, chars) if n < 30 else least, most, split, keep_tail, counter, model, percentile))
                ]
                at, *own = zip(*found, strict=True) if found else [()] * 5
                own = [pa.array(x, t) for x, t in zip(own, (pa.int32(), pa.list_(pa.string()), pa.string(), pa.int32()), strict=True)]
                doc, *kept = (part.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", *keep))
                yield pa.RecordBatch.from_arrays([doc, *own, *kept], names=["doc_id", "chunk_no", "title_path", "content", "n_tokens", *keep])

    return docs.mapInArrow(run, CHUNKS.format(kinds["doc_id"]) + "".join(f", {c} {kinds[c]}" for c in keep))


#: So many characters of documents are Python objects at once in :func:`build_chunks`, or one document.
PART_CHARS = 1 << 21


def _parts(batch: pa.RecordBatch, most: int = PART_CHARS) -> Iterator[pa.RecordBatch]:
    """A batch of documents in parts of at most ``most`` characters beside their first document; a block counts as a hundred more."""
    size = pc.add(pc.fill_null(batch.column("n_chars"), 0), pc.multiply(pc.fill_null(batch.column("n_blocks"), 0).cast(pa.int64()), 100)).to_numpy()
    part = np.cumsum(size) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a < b:
            yield batch.slice(a, b - a)


def pack(blocks, least: int, most: int, split: bool, keep_tail: bool, tokens=None, embed=hash_embed, percentile: float | None = None) -> Iterator[tuple[list[str], str, int]]:
    """(title path, content, tokens) of one document's chunks."""
    path, content, body, current = [], [], 0, 0
    length = tokens or (lambda text: words(text) + 2)

    def flush(anyway: bool = False) -> list[tuple[list[str], str, int]]:
        nonlocal content, body, current
        if not content:
            return []
        text = "\n".join(content)
        size = tokens(text) if tokens else body + 2
        if size < least and not anyway:
            return []
        out = [(path, text, size)]
        if split and size > most:
            out = [(path, x, length(x)) for x in cut(text, least, most, embed, length, percentile)]
        content, body, current = [], 0, 0
        return out

    for b in blocks:
        if b["type"] == "title":
            yield from flush()
            path = [*path[: max(0, b["level"] - 1)], b["text"]]
            continue
        t = tokens(b["text"]) if tokens else b["n"] + 2
        if t < most and current + t > most:
            yield from flush()
        content.append(b["text"])
        body, current = body + b["n"], current + t
        if t >= most:
            yield from flush()
    yield from flush(keep_tail)


def words(text: str) -> int:
    return len(_TOKEN.findall(_CJK.sub(r" \1 ", text)))


def cut(text: str, least: int, most: int, embed=hash_embed, length=lambda text: words(text) + 2, percentile: float | None = None) -> list[str]:
    """Pieces of an oversize text: cut at the greatest distances of neighbouring sentences, so that there are about as
    many pieces as ``most`` asks for, or, with ``percentile``, wherever the distance is above that of the distances.
    Pieces below ``least`` tokens are joined to the next."""
    parts = [s for s in _SENTENCE.split(text) if s.strip()]
    if len(parts) < 2:
        return [text]
    vectors = embed(pd.Series(parts))
    far = np.round(1 - (vectors[1:] * vectors[:-1]).sum(axis=1), 9)
    n = min(len(far), int(length(text) / most)) if percentile is None else int((far > np.percentile(far, percentile)).sum())
    at = sorted(np.argsort(-far, kind="stable")[:n] + 1)
    out, held = [], []
    for a, b in zip([0, *at], [*at, len(parts)], strict=True):
        held += parts[a:b]
        if length("\n".join(held)) >= least:
            out.append("\n".join(held))
            held = []
    if held:
        out.append("\n".join([out.pop(), *held]) if out else "\n".join(held))
    return out


def split_chunks(chunks: DataFrame, least: int = 500, most: int = 2000, embed: V.Model | V.Hook = hash_embed, percentile: float | None = None) -> DataFrame:
    """``chunks`` with those beyond ``most`` tokens in pieces, as :func:`cut` makes them, and numbered anew.

    Sentences of many such chunks are embedded together, in bounded batches; distances are those to the sentence
    before, cuts the greatest of a chunk, and pieces running sums of cuts. Token counts are the library's."""
    key = ["doc_id", "chunk_no"]
    parts = F.filter(F.split("content", _SENTENCE.pattern, -1), lambda s: F.trim(s) != "")
    # A chunk of white space alone has no sentence; it stays as it is.
    big = (F.col("n_tokens") > most) & (F.size(parts) > 0)
    rows = chunks.where(big).select(*key, "title_path", "n_tokens", parts.alias("_s"))
    # Vectors stay in the task that makes them: only distances leave it.
    both = F.arrays_zip("_s", V.distances(F.col("_s"), embed).alias("_far"))
    rows = rows.select(*key, "title_path", "n_tokens", F.size("_s").alias("_m"), F.posexplode(both).alias("i", "x"))
    rows = rows.select(*key, "title_path", "n_tokens", "_m", "i", F.col("x._s").alias("s"), F.round("x._far", 9).alias("far"))
    if percentile is None:
        rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("far").desc_nulls_last(), "i"))
        new = rank <= F.least(F.col("_m") - 1, F.floor(F.col("n_tokens") / most))
    else:
        new = F.col("far") > F.percentile("far", F.lit(percentile / 100)).over(Window.partitionBy(*key))
    rows = rows.withColumn("new", F.coalesce(new & F.col("far").isNotNull(), F.lit(False)))
    piece = F.count_if(F.col("new")).over(Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    pieces = rows.withColumn("piece", piece).groupBy(*key, "piece").agg(F.first("title_path").alias("title_path"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), "\n").alias("t"))
    # Pieces below the minimum are joined to the next, and the last to the one before; a chunk has few.
    lists = pieces.groupBy(*key).agg(F.first("title_path").alias("title_path"), F.sort_array(F.collect_list(F.struct("piece", "t", T.words(F.col("t")).alias("n")))).alias("p"))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        held, n = F.concat(s["held"], F.array(x["t"])), s["n"] + x["n"]
        full = n + 2 >= least
        none = F.array().cast("array<string>")
        return F.struct(F.when(full, F.concat(s["out"], F.array(F.array_join(held, "\n")))).otherwise(s["out"]).alias("out"), F.when(full, none).otherwise(held).alias("held"), F.when(full, 0).otherwise(n).alias("n"))

    def finish(s: Column) -> Column:
        rest, last = F.array_join(s["held"], "\n"), F.size(s["out"])
        ended = F.concat(F.slice(s["out"], F.lit(1), F.greatest(last - 1, F.lit(0))), F.array(F.concat(F.get(s["out"], last - 1), F.lit("\n"), rest)))
        return F.when(F.size(s["held"]) == 0, s["out"]).when(last > 0, ended).otherwise(F.array(rest))

    cut_ = lists.select(*key, "title_path", F.posexplode(F.aggregate("p", start, step, finish)).alias("k", "content"))
    whole = chunks.where(~big).select(*key, "title_path", F.lit(0).alias("k"), "content", "n_tokens")
    all_ = whole.unionByName(cut_.withColumn("n_tokens", T.token_count(F.col("content"))))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_no", "k")) - 1
    return all_.select("doc_id", number.alias("chunk_no"), "title_path", "content", "n_tokens")


def sample_chunks(chunks: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """Up to ``k`` chunks of each collection (table_id, doc_id, chunk_no, content), drawn by a hash, joined by a blank line."""
    order = F.md5(F.concat_ws(":", F.lit(seed), "doc_id", "chunk_no"))
    ranked = chunks.withColumn("n", F.row_number().over(Window.partitionBy("table_id").orderBy(order, "doc_id", "chunk_no"))).where(F.col("n") <= k)
    return ranked.groupBy("table_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "content"))), lambda x: x["content"]), "\n\n").alias("sample"))
