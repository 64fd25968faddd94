"""Sequential merges of boxes within a page or document: each is a small fold over the boxes
of one group, which Spark brings together; a group is one page, column, class or document.

Groups pass by in the rows of a sorted partition, many in a batch (:func:`_streamed`), so that what is done in numpy is done for all
groups of a batch at once.

All take and give boxes as rows of (doc_id, page_number, box_no, x0, x1, top, bottom, text,
layout_type, layoutno) and keep the columns; where a fold merges, the first box's row is widened."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.chunks import words
from quillspan.operators.layout import BAND, CELL_PATTERNS, CONTENTS
from quillspan.operators.ordered import changes

PAGE = ["doc_id", "page_number"]


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in rows.dtypes)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the places where a group begins and the end, of batches in which the rows of a group follow each
    other. A group that goes on in the next batch waits for its rest."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        new = changes([batch.column(k) for k in keys])
        new[0] = bool(held) and changes([pa.concat_arrays([held[-1].column(k).slice(len(held[-1]) - 1), batch.column(k).slice(0, 1)]) for k in keys])[1]
        begins = np.flatnonzero(new)
        if len(begins):
            whole = pa.Table.from_batches([*held, batch.slice(0, begins[-1])]).combine_chunks()
            if len(whole):
                before = len(whole) - int(begins[-1])
                yield whole, np.unique(np.concatenate([[0], before + begins]))
            held = []
            batch = batch.slice(begins[-1])
        held.append(batch)
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield whole, np.array([0, len(whole)])


def _streamed(rows: DataFrame, keys: list[str], fold: Callable[[pa.Table, np.ndarray], pa.Table], schema: str | None = None) -> DataFrame:
    """``fold(table, edges)`` of the groups of ``keys``, many at once: group i is the rows from ``edges[i]`` to ``edges[i + 1]``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in _groups(batches, keys):
            yield from fold(t, edges).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema or _schema(rows))


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    """A column as doubles; null is NaN."""
    return pc.fill_null(t.column(name).cast(pa.float64()), float("nan")).to_numpy()


def _ordered(edges: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """Rows group by group, in a group in the order of ``by``; NaN comes last."""
    return np.lexsort([*reversed(by), np.repeat(np.arange(len(edges) - 1), np.diff(edges))])


def areas(b: pd.DataFrame) -> np.ndarray:
    return np.maximum(b["x1"] - b["x0"], 0).to_numpy() * np.maximum(b["bottom"] - b["top"], 0).to_numpy()


def overlaps(b: pd.DataFrame, i: int) -> np.ndarray:
    """Area that box ``i`` shares with each."""
    w = np.minimum(b["x1"], b["x1"].iloc[i]) - np.maximum(b["x0"], b["x0"].iloc[i])
    h = np.minimum(b["bottom"], b["bottom"].iloc[i]) - np.maximum(b["top"], b["top"].iloc[i])
    return (np.maximum(w, 0) * np.maximum(h, 0)).to_numpy()


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Areas that boxes share: columns of x0, x1, top, bottom, which broadcast. NaN where an edge is."""
    w, h = np.minimum(a[1], b[1]) - np.maximum(a[0], b[0]), np.minimum(a[3], b[3]) - np.maximum(a[2], b[2])
    return np.maximum(w, 0) * np.maximum(h, 0)


EDGES = ("x0", "x1", "top", "bottom")


def suppress(regions: DataFrame, iou: float = 0.45) -> DataFrame:
    """Greedy non-maximum suppression for each (doc_id, page_number, type): the best-scored regions
    stay, others that overlap one of those by more than ``iou`` go. Ties by region_no."""

    def fold(t: pa.Table, edges: np.ndarray) -> pa.Table:
        order = _ordered(edges, -_numbers(t, "score"), _numbers(t, "region_no"))
        box = np.array([_numbers(t, c)[order] for c in EDGES])
        area, alive = _shared(box, box), np.ones(len(order), bool)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for i in range(a, b - 1):
                if alive[i]:
                    both = _shared(box[:, i + 1 : b], box[:, i : i + 1])
                    alive[i + 1 : b] &= both / np.maximum(area[i + 1 : b] + area[i] - both, 1e-9) <= iou
        return t.take(pa.array(order[alive]))

    return _streamed(regions, [*PAGE, "type"], fold)


def clean_regions(regions: DataFrame, boxes: DataFrame | None = None, far: int = 2, share: float = 0.7) -> DataFrame:
    """Of regions of one type that follow each other within ``far`` places and cover ``share`` of either, the
    higher-scored stays (the later one on a tie). Where one has no score, the one that covers more of the page's ``boxes``
    stays, likewise; without boxes that is the later one."""
    names, own, rows = regions.columns, "_region", regions.withColumn("_region", F.lit(True))
    if boxes is not None:
        # Regions and boxes of a page come in one stream.
        types = dict(regions.dtypes)
        text = boxes.select(*(F.col(c).cast(types[c]).alias(c) for c in (*PAGE, *EDGES)), F.lit(False).alias(own))
        rows = rows.unionByName(text, allowMissingColumns=True)

    def covered(box: list[np.ndarray], i: int, text: np.ndarray) -> float:
        return sum(_shared(text, box[i][:, None]).tolist())

    def fold(t: pa.Table, edges: np.ndarray) -> pa.Table:
        is_text = ~t.column(own).to_numpy()
        order = _ordered(edges, is_text, *(_numbers(t, c) for c in ("top", "x0", "region_no")))
        grid = np.array([_numbers(t, c)[order] for c in EDGES])
        area, next_, box = _shared(grid, grid).tolist(), [], list(grid.T)
        # What a region shares with the next ones, as long as none is dropped between.
        for d in range(1, far):
            next_.append(np.append(_shared(grid[:, :-d], grid[:, d:]), np.zeros(min(d, len(order)))).tolist())
        score, kind = _numbers(t, "score")[order].tolist(), t.column("type").take(pa.array(order)).to_pylist()
        sizes, keep = np.add.reduceat(~is_text, edges[:-1], dtype=np.int64).tolist(), []
        for a, b, size in zip(edges[:-1].tolist(), edges[1:].tolist(), sizes, strict=True):
            left, i = list(range(a, a + size)), 0
            while i < len(left):
                u, gone = left[i], None
                for v in left[i + 1 : i + far]:
                    both = next_[v - u - 1][u] if v - u < far else float(_shared(box[u], box[v]))
                    if kind[u] != kind[v] or both <= 0:
                        continue
                    if both >= share * min(area[u], area[v]):
                        first, second = score[u], score[v]
                        if not (first > 0 and second > 0):
                            first, second = (covered(box, x, grid[:, a + size : b]) for x in (u, v))
                        gone = v if first > second else u
                    break
                if gone is None:
                    i += 1
                else:
                    left.remove(gone)
            keep += left
        return t.take(pa.array(order[np.array(keep, np.int64)])).select(names)

    return _streamed(rows, PAGE, fold, _schema(regions))


def _places(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number from ``low[i]`` to ``high[i]``, and its i. None where ``high`` is less."""
    n = np.maximum(high - low + 1, 0)
    own = np.repeat(np.arange(len(n)), n)
    return own, low[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)


#: Pairs of characters and boxes that are looked at at once.
PAIRS = 1_000_000


def _best_box(char: np.ndarray, char_page: np.ndarray, box: np.ndarray, box_page: np.ndarray, box_no: np.ndarray) -> np.ndarray:
    """For each character the box of its page that covers most of it, ties by the share of the box, then the first; -1 without one. Columns
    of x0, x1, top, bottom. As in :func:`quillspan.operators.layout.overlapping` a pair is looked at in one band of the page's height."""
    out = np.full(len(char_page), -1)
    some_chars, some_boxes = (np.flatnonzero(np.isfinite(x).all(axis=0)) for x in (char, box))
    if not len(some_chars) or not len(some_boxes):
        return out
    band = lambda x: np.floor(x / BAND).astype(np.int64)
    low, high = band(char[2, some_chars]), band(char[3, some_chars])
    first, last = low.min(), high.max()
    # Rows of boxes by page and band, between the bands that characters have.
    own, at = _places(np.maximum(band(box[2, some_boxes]), first), np.minimum(band(box[3, some_boxes]), last))
    boxes, code = some_boxes[own], box_page[some_boxes[own]] * (last - first + 1) + at - first
    order = np.argsort(code, kind="stable")
    boxes, code = boxes[order], code[order]
    own, at = _places(low, high)
    chars = some_chars[own]
    asked = char_page[chars] * (last - first + 1) + at - first
    begin = np.searchsorted(code, asked)
    upto = np.cumsum(np.searchsorted(code, asked, "right") - begin)
    # Bands of a character follow each other: parts end where one does.
    ends = np.append(np.flatnonzero(np.diff(chars)) + 1, len(chars)) if len(chars) else np.zeros(0, np.int64)
    a = 0
    while a < len(chars):
        done = upto[a - 1] if a else 0
        b = int(ends[max(np.searchsorted(upto[ends - 1], done + PAIRS, "right") - 1, np.searchsorted(ends, a, "right"))])
        entry, place = _places(begin[a:b], begin[a:b] + np.diff(upto[a:b], prepend=done) - 1)
        c, r = chars[a:b][entry], boxes[place]
        x, y = char[:, c], box[:, r]
        w, h = np.minimum(x[1], y[1]) - np.maximum(x[0], y[0]), np.minimum(x[3], y[3]) - np.maximum(x[2], y[2])
        here = (w > 0) & (h > 0) & (band(np.maximum(x[2], y[2])) == at[a:b][entry])
        c, r, both, x, y = c[here], r[here], (w * h)[here], x[:, here], y[:, here]
        share, back = (np.floor(both / ((z[1] - z[0]) * (z[3] - z[2])) * 1e6 + 0.5) for z in (x, y))
        c, r, share, back = (z[share > 0] for z in (c, r, share, back))
        order = np.lexsort([-box_no[r], back, share, c]) if np.any(np.diff(c) == 0) else np.arange(len(c))
        out[c[order]] = r[order]  # the last of a character stays
        a = b
    return out


#: Characters and boxes that are unpacked at once.
UNPACKED = 100_000


def _unpacked(lists: pa.ListArray) -> tuple[pa.Table, np.ndarray]:
    """The structs of all lists as a table, and the list that each is of."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.Table.from_batches([pa.RecordBatch.from_struct_array(lists.flatten())]), np.repeat(np.arange(len(n)), n)


def chars_to_boxes(chars: DataFrame, boxes: DataFrame) -> DataFrame:
    """Texts of boxes from their characters in reading order: each character is of the box that covers most of it; one at least 70 %
    higher or lower than its box is left out, but for spaces. Characters and boxes of a page are brought together once, and come to
    Python as two lists, as rows of characters are dear there."""
    types = dict(boxes.dtypes)
    names = [*PAGE, "box_no", *(c for c in boxes.columns if c not in (*PAGE, "box_no", "text"))]
    char = F.struct(*(F.col(c).cast("double").alias(c) for c in (*EDGES, "height")), "char_no", F.col("text").cast("string").alias("text"))
    rows = boxes.select(*PAGE, F.struct(*names).alias("_box")).unionByName(chars.where("char_no is not null").select(*(F.col(c).cast(types[c]).alias(c) for c in PAGE), char.alias("_char")), allowMissingColumns=True)
    pages = rows.repartition(*PAGE).groupBy(*PAGE).agg(F.collect_list("_box").alias("boxes"), F.collect_list("_char").alias("chars")).where(F.size("boxes") > 0).select("boxes", "chars")

    def fold(batch: pa.RecordBatch) -> pa.Table:
        (b, box_page), (one, char_page) = _unpacked(batch.column("boxes")), _unpacked(batch.column("chars"))
        char, box = (np.array([_numbers(x, c) for c in EDGES]) for x in (one, b))
        best = _best_box(char, char_page, box, box_page, _numbers(b, "box_no"))
        at = np.flatnonzero(best >= 0)
        height, tall = _numbers(one, "height")[at], (box[3] - box[2])[best[at]]
        text = pc.fill_null(one.column("text").combine_chunks(), "")
        at = at[(np.abs(height - tall) < 0.7 * np.maximum(height, tall)) | pc.equal(text, " ").to_numpy(zero_copy_only=False)[at]]
        at = at[np.lexsort([one.column("char_no").to_numpy()[at], char[0, at], best[at]])]
        upto = np.append(0, np.cumsum(np.bincount(best[at], minlength=len(b)))).astype(np.int32)
        return b.append_column("text", pc.binary_join(pa.ListArray.from_arrays(pa.array(upto), text.take(pa.array(at))), ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.cumsum([0, *(pc.list_value_length(batch.column("boxes")).to_numpy() + pc.list_value_length(batch.column("chars")).to_numpy())])
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(held, held[a] + UNPACKED, "right")) - 1)
                yield from fold(batch.slice(a, b - a)).to_batches()
                a = b

    return pages.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in names) + ", text string")


def _merged(rows: list[dict], joins, glue, widen) -> list[dict]:
    """Fold ``rows``: the next row is put on the last while ``joins`` says so."""
    out: list[dict] = []
    for r in rows:
        if out and joins(out[-1], r):
            last = out[-1]
            last["text"] = glue(last["text"] or "", r["text"] or "")
            widen(last, r)
        else:
            out.append(dict(r))
    return out


def _widen(last: dict, r: dict) -> None:
    last["x0"], last["x1"] = min(last["x0"], r["x0"]), max(last["x1"], r["x1"])
    last["top"], last["bottom"] = min(last["top"], r["top"]), max(last["bottom"], r["bottom"])


# Box types that lines aren't merged in; signs at the end of a text, or before its last character, and at
# the beginning of the next that go on with a paragraph; signs that end one, and those that do so in English text.
APART = ("table", "figure", "equation")
GOES_ON, GOES_ON_BEFORE_LAST, CONTINUES = ",;:'\"，、‘“；：-", ",;:'\"，‘“、；：", "。；？！?”）),，、："
ENDS, ENDS_ENGLISH = "。？！?", ".!?"


def _dicts(t: pa.Table, names: list[str], order: np.ndarray | None = None) -> list[dict]:
    """Rows of the given columns, in ``order``, with their place in ``t`` as ``_at``."""
    at = np.arange(len(t)) if order is None else order
    taken = t.select(names) if order is None else t.select(names).take(pa.array(order))
    columns = [c.to_pylist() if c.null_count or not pa.types.is_floating(c.type) else c.to_numpy().tolist() for c in taken.columns]
    return [dict(zip((*names, "_at"), r, strict=True)) for r in zip(*columns, at.tolist(), strict=True)]


def _undict(t: pa.Table, rows: list[dict], *changed: str) -> pa.Table:
    """The rows of ``t`` that ``rows`` come from, with the ``changed`` columns of theirs."""
    out = t.take(pa.array([r["_at"] for r in rows], pa.int64()))
    for c in changed:
        out = out.set_column(out.schema.get_field_index(c), out.schema.field(c), pa.array([r[c] for r in rows], out.schema.field(c).type))
    return out


def _height(rows: list[dict], given: float | None) -> float:
    """The character height of a page: the given one, or the median of its boxes."""
    return given if (given or 0.0) > 0 else float(np.median([r["bottom"] - r["top"] for r in rows]))


def _merge_page(rows: list[dict], height: float, merge) -> list[dict]:
    """``merge(rows, height)`` of each column of a page, whose rows come from the top."""
    columns: dict[int | None, list[dict]] = {}
    for r in rows:
        columns.setdefault(r["col_id"], []).append(r)
    return [r for own in columns.values() for r in merge(own, height)]


def _by_column(boxes: DataFrame, heights: DataFrame | None, merge) -> DataFrame:
    """``merge(rows, height)`` of the boxes of each column of a page, from the top. Where boxes have no ``col_id``
    yet, columns are found first. ``heights`` (doc_id, page_number, mean_height) are the pages' median
    character heights; a page without one has the median of its boxes."""
    schema = _schema(boxes) + ("" if "col_id" in boxes.columns else ", col_id int")
    names = [*boxes.columns, *([] if "col_id" in boxes.columns else ["col_id"])]
    rows, given = boxes.withColumn("_box", F.lit(True)), heights is not None
    if given:
        # A page's height comes in one stream with its boxes.
        types = dict(boxes.dtypes)
        own = heights.select(*(F.col(c).cast(types[c]).alias(c) for c in PAGE), F.col("mean_height").cast("double").alias("_height"), F.lit(False).alias("_box"))
        rows = rows.unionByName(own, allowMissingColumns=True)
    used = ["box_no", *EDGES, "text", "layout_type", "layoutno", "col_id", *(["is_english"] if "is_english" in boxes.columns else [])]

    def fold(t: pa.Table, edges: np.ndarray) -> pa.Table:
        known, page = np.full(len(edges) - 1, np.nan), np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        if given:
            box = t.column("_box").to_numpy()
            known[page[~box]] = _numbers(t, "_height")[~box]
            t, page = t.filter(pa.array(box)), page[box]
        own, edges = np.unique(page, return_index=True)
        edges = np.append(edges, len(t))
        if "col_id" not in t.column_names:
            t = t.append_column("col_id", pa.array(column_ids(_numbers(t, "x0"), _numbers(t, "x1"), edges) if len(t) else [], pa.int32()))
        all_, out = _dicts(t, used, _ordered(edges, *(_numbers(t, c) for c in ("top", "x0", "box_no")))), []
        for a, b, height in zip(edges[:-1].tolist(), edges[1:].tolist(), known[own].tolist(), strict=True):
            out += _merge_page(all_[a:b], _height(all_[a:b], height), merge)
        return _undict(t, out, *EDGES, "text").select(names)

    return _streamed(rows, PAGE, fold, schema)


def _lines(rows: list[dict], height: float) -> list[dict]:
    def widen(last: dict, r: dict) -> None:
        last["x1"], last["top"], last["bottom"] = r["x1"], (last["top"] + r["top"]) / 2, (last["bottom"] + r["bottom"]) / 2

    joins = lambda a, r: bool(a["layoutno"]) and a["layoutno"] == r["layoutno"] and a["layout_type"] not in APART and abs(a["top"] + a["bottom"] - r["top"] - r["bottom"]) / 2 < height / 3
    return _merged(rows, joins, lambda a, b: a + b, widen)


def merge_lines(boxes: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """Neighbours in a column of one layout, but tables, figures and equations, whose middles are less than a third of the
    page's character height apart become one box: texts are joined without a space, the right edge
    is the last one's, top and bottom are averaged. Boxes without a layout number stay alone."""
    return _by_column(boxes, heights, _lines)


def _paragraphs(rows: list[dict], height: float) -> list[dict]:
    def joins(a: dict, r: dict) -> bool:
        over, width = max(0, min(a["x1"], r["x1"]) - max(a["x0"], r["x0"])), max(1, min(a["x1"] - a["x0"], r["x1"] - r["x0"]))
        above, below = a["text"].strip(), r["text"].strip()
        goes_on = above[-1] in GOES_ON or above[-2:-1] != "" and above[-2] in GOES_ON_BEFORE_LAST or below[0] in CONTINUES
        ends = above[-1] in ENDS or (a.get("is_english") is True and above[-1] in ENDS_ENGLISH)
        return a["layoutno"] == r["layoutno"] and r["top"] - a["bottom"] <= 1.5 * height and over / width >= 0.3 and (goes_on or not ends)

    def widen(last: dict, r: dict) -> None:
        last["x0"], last["x1"], last["bottom"] = min(last["x0"], r["x0"]), max(last["x1"], r["x1"]), r["bottom"]

    solid = [r | {"text": r["text"].strip()} for r in rows if (r["text"] or "").strip()]
    return _merged(solid, joins, lambda a, b: f"{a} {b}", widen)


def merge_paragraphs(boxes: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """Boxes of one layout down a column become one, with a space between, where they are at most 1.5 character heights
    apart, share 0.3 of the narrower's width, and the upper doesn't end a sentence or signs say that it goes on.
    Blank boxes go. A column ``is_english``, where there is one, says whether ``.`` and ``!`` end a sentence too."""
    return _by_column(boxes, heights, _paragraphs)


#: The order of boxes in their document.
DOWN = ("page_number", "top", "x0", "box_no")


def _down(rows: list[dict]) -> list[dict]:
    """Boxes in the order of their document."""
    return sorted(rows, key=lambda r: (r["page_number"], r["top"], r["x0"], r["box_no"]))


def _documents(boxes: DataFrame, used: list[str], fold: Callable[[list[dict]], list[dict]], *changed: str) -> DataFrame:
    """``fold(rows)`` of the boxes of each document from the top: rows of the columns ``used``, of which it may change ``changed``."""

    def run(t: pa.Table, edges: np.ndarray) -> pa.Table:
        all_, out = _dicts(t, used, _ordered(edges, *(_numbers(t, c) for c in DOWN))), []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            out += fold(all_[a:b])
        return _undict(t, out, *changed)

    return _streamed(boxes, ["doc_id"], run)


def _bullets(rows: list[dict]) -> list[dict]:
    first = lambda x: x["text"].strip()[0]
    joins = lambda a, r: first(a) == first(r) and not re.match("[A-Za-z一-鿿]", first(r)) and a["page_number"] == r["page_number"] and a["top"] <= r["bottom"]
    return _merged([r for r in rows if (r["text"] or "").strip()], joins, lambda x, y: f"{x}\n{y}", _widen)


def merge_bullets(boxes: DataFrame) -> DataFrame:
    """Boxes that begin with the same sign, no letter, become one, a line each. Blank boxes go."""
    return _documents(boxes, ["page_number", *EDGES, "text"], _bullets, *EDGES, "text")


LATIN = r"[0-9a-zA-Z :'.-]{5,}"  # fixed value: what a heading in Latin letters is made of


def _is_heading(text: str) -> bool:
    return re.sub("[ \u3000]+", "", text.lower()) in CONTENTS


#: Texts that may be such a heading, as Arrow tells it of many at once.
HEADING = "(?i)^[ \u3000]*(" + "|".join("[ \u3000]*".join(c) for c in CONTENTS) + ")[ \u3000]*$"


def _contents(text: Callable[[int], str], places: Iterable[int], end: int, reach: int = 128) -> Iterator[tuple[int, int]]:
    """Where contents begin and end among the texts of a document, of which there are ``end`` and headings only at ``places``."""
    i = 0
    for p in places:
        if p < i or not _is_heading(text(p)):
            continue
        latin = re.match(LATIN, text(p).strip())
        start = next((j for j in range(p + 1, end) if text(j).strip()), end)
        if start == end:
            yield p, end
            return
        entry = text(start).strip()
        head = " ".join(entry.split()[:2]) if latin else entry[:3]
        i = next((j for j in range(start + 1, min(start + 1 + reach, end)) if text(j).startswith(head)), start + 1)
        yield p, i


def _without_contents(rows: list[dict]) -> list[dict]:
    texts, kept = [r["text"] or "" for r in rows], np.ones(len(rows), bool)
    for a, b in _contents(texts.__getitem__, range(len(texts)), len(texts)):
        kept[a:b] = False
    return [r for r, k in zip(rows, kept.tolist(), strict=True) if k]


def drop_contents(boxes: DataFrame, reach: int = 128, dotted: int | None = None) -> DataFrame:
    """Without a contents or acknowledgement heading, its first entry, and what follows up to the next of ``reach``
    boxes that begins as that entry does: with its first three characters, or its first two words
    where the heading is in Latin letters. Blank boxes before the entry go too.

    With ``dotted``, documents without such a heading lose their pages of more than so many boxes that hold dotted leaders, as by
    :func:`quillspan.operators.layout.dotted_pages` after this, but in the same pass."""

    def run(t: pa.Table, edges: np.ndarray) -> pa.Table:
        order, text = _ordered(edges, *(_numbers(t, c) for c in DOWN)), t.column("text").combine_chunks()
        flags = lambda x: pc.fill_null(x, False).to_numpy(zero_copy_only=False)[order]
        gone, headed = np.zeros(len(t), bool), np.zeros(len(edges) - 1, bool)
        # Only documents where a heading may stand meet Python, and of them only the texts from there on.
        may = np.flatnonzero(flags(pc.match_substring_regex(text, HEADING)))
        doc = np.searchsorted(edges, may, "right") - 1
        for places in np.split(may, np.flatnonzero(np.diff(doc)) + 1) if len(may) else []:
            d = int(np.searchsorted(edges, places[0], "right")) - 1
            at, n = int(edges[d]), int(edges[d + 1] - edges[d])
            for a, b in _contents(lambda i, at=at: text[int(order[at + i])].as_py() or "", (places - at).tolist(), n, reach):
                gone[at + a : at + b], headed[d] = True, True
        if dotted is not None:
            page, doc = _numbers(t, "page_number")[order], np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            begins = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(page, prepend=np.nan) != 0))
            many = np.add.reduceat((flags(pc.match_substring(text, "··")) & ~gone).astype(np.int64), begins) > dotted
            known = flags(pc.and_(pc.is_valid(t.column("doc_id")), pc.is_valid(t.column("page_number"))))
            gone |= np.repeat(many, np.diff(np.append(begins, len(t)))) & ~headed[doc] & known
        return t.take(pa.array(order[~gone]))

    return _streamed(boxes, ["doc_id"], run)


def document_blocks(boxes: DataFrame, dotted: int = 3) -> DataFrame:
    """(doc_id, blocks) of each document's boxes: columns, lines and paragraphs merged page by page, contents or else dotted pages
    dropped, bullets merged, and all in document order as blocks that :func:`quillspan.operators.chunks.build_chunks` takes as they
    are. The same as the single operators one after another, but documents are brought together once.

    Boxes of tables are blocks of their own, figures and equations are left out. A column ``mean_height``, where there is one,
    is the page's character height."""
    kind = dict(boxes.dtypes)["doc_id"]
    rows = boxes.withColumnRenamed("mean_height", "_height") if "mean_height" in boxes.columns else boxes.withColumn("_height", F.lit(None).cast("double"))
    used = ["page_number", "box_no", *EDGES, "text", "layout_type", "layoutno", *(c for c in ("_height", "col_id", "is_english") if c in rows.columns)]

    def blocks_of(all_: list[dict]) -> list[dict]:
        own, pages = [], {}
        for r in all_:
            if r["layout_type"] not in APART:
                pages.setdefault(r["page_number"], []).append(r)
        for _, page in sorted(pages.items()):
            height = _height(page, page[0]["_height"])
            lines = sorted(_merge_page(page, height, _lines), key=lambda r: (r["top"], r["x0"], r["box_no"]))
            own += _merge_page(lines, _height(lines, page[0]["_height"]), _paragraphs)
        own = _down(own)
        headed, own = any(_is_heading(r["text"] or "") for r in own), _without_contents(own)
        if not headed:
            leaders = Counter(r["page_number"] for r in own if "··" in (r["text"] or ""))
            own = [r for r in own if leaders[r["page_number"]] <= dotted]
        rows = [(r["page_number"], r["top"], r["x0"], "title" if r["layout_type"] == "title" else "paragraph", r["text"]) for r in _bullets(own)]
        rows += [(r["page_number"], r["top"], r["x0"], "table", r["text"] or "") for r in all_ if r["layout_type"] == "table"]
        return [{"block_no": i, "type": r[3], "level": 1 if r[3] == "title" else None, "text": r[4]} for i, r in enumerate(sorted(rows, key=lambda r: r[:4]))]

    def fold(t: pa.Table, edges: np.ndarray) -> pa.Table:
        # Down the pages of each document. The columns of all of them are found at once, from the boxes that are merged.
        order = _ordered(edges, *(_numbers(t, c) for c in DOWN))
        all_ = _dicts(t, used, order)
        if "col_id" not in t.column_names:
            free = ~np.isin(np.array([r["layout_type"] or "" for r in all_], object), APART)
            rows, doc = order[free], np.repeat(np.arange(len(edges) - 1), np.diff(edges))[free]
            page = _numbers(t, "page_number")[rows]
            begins = np.append(np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(page, prepend=np.nan) != 0)), len(rows))
            ids = column_ids(_numbers(t, "x0")[rows], _numbers(t, "x1")[rows], begins).tolist()
            for i, c in zip(np.flatnonzero(free).tolist(), ids, strict=True):
                all_[i]["col_id"] = c
        blocks = [blocks_of(all_[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        kinds = pa.list_(pa.struct([("block_no", pa.int32()), ("type", pa.string()), ("level", pa.int32()), ("text", pa.string())]))
        return pa.table([t.column("doc_id").take(pa.array(edges[:-1])), pa.array(blocks, kinds)], names=["doc_id", "blocks"])

    return _streamed(rows, ["doc_id"], fold, f"doc_id {kind}, blocks array<struct<block_no:int,type:string,level:int,text:string>>")


def _kmeans(x: np.ndarray, edges: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Labels of one-dimensional k-means of each group from evenly spread quantiles, numbered from left to right. ``x`` ascends in a group."""
    n, start = np.diff(edges), edges[:-1]
    group = np.repeat(np.arange(len(n)), n)
    at = (np.arange(k) + 0.5)[None, :] / k * (n[:, None] - 1)
    below = np.floor(at).astype(np.int64)
    low, high, part = x[start[:, None] + below], x[start[:, None] + np.minimum(below + 1, n[:, None] - 1)], at - below
    centre = np.where(part >= 0.5, high - (high - low) * (1 - part), low + (high - low) * part)
    label, moving = np.zeros(len(x), np.int64), np.ones(len(n), bool)
    for _ in range(rounds):
        rows = np.flatnonzero(moving[group])
        if not len(rows):
            break
        own, values = group[rows], x[rows]
        label[rows] = np.abs(values[:, None] - centre[own]).argmin(axis=1)
        code = own * k + label[rows]
        count, total = np.bincount(code, minlength=len(n) * k).reshape(-1, k), np.bincount(code, values, len(n) * k).reshape(-1, k)
        new = np.where(count > 0, total / np.maximum(count, 1), centre)
        moving &= ~np.isclose(new, centre).all(axis=1)
        centre[moving] = new[moving]
    used = np.zeros((len(n), k), bool)
    used[group, label] = True
    return (np.cumsum(used, axis=1) - 1)[group, label]


def _silhouette(x: np.ndarray, edges: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
    """The mean silhouette of each group's clusters, -1 if there is one only. Clusters of ascending numbers are stretches of them, so
    that sums of distances are those of numbers before and after: linear in the numbers."""
    n = np.diff(edges)
    group = np.repeat(np.arange(len(n)), n)
    x, code = x - x[edges[:-1]][group], group * k + label
    count, total = np.bincount(code, minlength=len(n) * k).reshape(-1, k), np.bincount(code, x, len(n) * k).reshape(-1, k)
    begins = np.flatnonzero(np.diff(code, prepend=-1))
    first = np.repeat(begins, np.diff(np.append(begins, len(x))))
    upto = np.append(0.0, np.cumsum(x))
    size, place, before = count[group, label], np.arange(len(x)) - first, upto[:-1] - upto[first]
    own = np.maximum(x * (2 * place - size) + total[group, label] - 2 * before, 0) / np.maximum(size - 1, 1)
    other = np.where(count[group] > 0, np.abs(count[group] * x[:, None] - total[group]) / np.maximum(count[group], 1), np.inf)
    other[np.arange(len(x)), label] = np.inf
    best = other.min(axis=1)
    most = np.maximum(np.maximum(best, own), 1e-9)
    value = np.where((size > 1) & np.isfinite(best), (best - own) / np.where(np.isfinite(most), most, 1), 0)
    return np.where((count > 0).sum(axis=1) > 1, np.bincount(group, value, len(n)) / n, -1.0)


def column_ids(x0: np.ndarray, x1: np.ndarray, edges: np.ndarray, most: int = 4) -> np.ndarray:
    """The column of each box in its page, from left to right: the boxes of page i are those from ``edges[i]`` to ``edges[i + 1]``."""
    out = np.zeros(len(x0), np.int32)
    if not len(x0):
        return out
    n = np.diff(edges)
    page, low = np.repeat(np.arange(len(n)), n), np.minimum.reduceat(x0, edges[:-1])
    width = np.maximum.reduceat(x1, edges[:-1]) - low
    width[width == 0] = 1.0
    snapped = np.where(x0 - low[page] < 0.12 * width[page], low[page], x0)
    snapped = snapped[np.lexsort([snapped, page])]
    new = np.diff(snapped, prepend=0) != 0
    new[edges[:-1]] = True
    distinct = np.add.reduceat(new, edges[:-1], dtype=np.int64)
    fits = np.full((len(n), most + 1), -np.inf)
    for k in range(2, most + 1):
        some = distinct >= k
        if some.any():
            x, own = snapped[some[page]], np.append(0, np.cumsum(n[some]))
            fits[some, k] = _silhouette(x, own, _kmeans(x, own, k), k)
    # Sums of a batch aren't exact: where the same clusters come of two numbers the smaller one stays.
    best, most_fit = np.ones(len(n), np.int64), np.zeros(len(n))
    for k in range(2, most + 1):
        better = fits[:, k] > most_fit + 1e-9
        best[better], most_fit[better] = k, fits[better, k]
    order = np.lexsort([x0, page])
    for k in np.unique(best[best > 1]).tolist():
        rows = order[(best == k)[page]]
        out[rows] = _kmeans(x0[rows], np.append(0, np.cumsum(n[best == k])), k)
    return out


def assign_columns(boxes: DataFrame, most: int = 4) -> DataFrame:
    """``col_id`` of each box in its page, from left to right: left edges within 12 % of the page's width
    count as its least; as many columns as part those edges best."""
    fold = lambda t, edges: t.append_column("col_id", pa.array(column_ids(_numbers(t, "x0"), _numbers(t, "x1"), edges, most)))
    return _streamed(boxes, PAGE, fold, _schema(boxes) + ", col_id int")


def _kind(text: str | None) -> str:
    """:func:`quillspan.operators.layout.cell_type` of one text."""
    text = (text or "").strip()
    for pattern, kind in CELL_PATTERNS:
        if re.search(pattern, text):
            return kind
    solid, n = re.sub(r"\s+", "", text), words(text)
    if solid and len(re.findall("[0-9.,+-]", solid)) >= 0.8 * len(solid):
        return "Nr"
    return "Lx" if n >= 12 else "Tx" if n > 3 else "Ot"


def _bands(low: np.ndarray, high: np.ndarray, slack: float) -> np.ndarray:
    """Numbers of bands: one ends where the next begins beyond the running average of its high edges, less ``slack``."""
    order, bands, edge, band = np.argsort(low, kind="stable"), [], None, -1
    for a, b in zip(low[order].tolist(), high[order].tolist(), strict=True):
        if edge is None or a >= edge - slack:
            band, edge = band + 1, b
        else:
            edge = (edge + b) / 2
        bands.append(band)
    out = np.zeros(len(low), int)
    out[order] = bands
    return out


def _place_lone(line: np.ndarray, across: np.ndarray, low: np.ndarray, high: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Cells alone in their ``line`` go to the nearer neighbouring line that has no text across from them, if there is one;
    their line is gone then, and the later ones move up."""
    i = 0
    while i <= line.max():
        own = np.flatnonzero(line == i)
        if len(own) == 1:
            gaps = {}
            for step in (-1, 1):
                near = np.flatnonzero(line == i + step)
                if len(near) and not filled[near[across[near] == across[own[0]]]].any():
                    gaps[step] = (low[own[0]] - high[near]).min() if step < 0 else (low[near] - high[own[0]]).min()
            if gaps:
                step = -1 if gaps.get(-1, np.inf) < gaps.get(1, np.inf) else 1
                line = line.copy()
                line[own] += step
                line[line > i] -= 1
                continue
        i += 1
    return line


def table_grid(cells: DataFrame) -> DataFrame:
    """(doc_id, table_no, box_no, row_no, col_no, is_header, text): rows and columns by running averages of bottom and right edges.

    A cell alone in its column, of a table of four rows or more, goes to the nearer neighbouring column without text beside it;
    then likewise one alone in its row, if there are four columns or more. A row is a header if more than half of its cells
    are flagged or, in a table that is mostly numbers, aren't numbers."""

    def places(x0, x1, top, bottom, flags, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, col = _bands(top, bottom, 3.0), _bands(x0, x1, 0.0)
        filled = np.array([bool(x) for x in texts])
        if row.max() >= 3:
            col = _place_lone(col, row, x0, x1, filled)
        if col.max() >= 3:
            row = _place_lone(row, col, top, bottom, filled)
        kinds = [_kind(x) for x in texts]
        numbers = Counter(kinds).most_common(1)[0][0] == "Nu"
        # Of each row its cells' columns, and those that speak for a header.
        cells_: dict[tuple[int, int], bool] = {}
        for r, c, flag, kind in zip(row.tolist(), col.tolist(), flags, kinds, strict=True):
            cells_[r, c] = cells_.setdefault((r, c), kind != "Nu") if numbers else cells_.get((r, c), False) or bool(flag)
        n, heads = Counter(r for r, _ in cells_), Counter(r for (r, _), said in cells_.items() if said)
        head = np.array([heads[r] > 0.5 * n[r] for r in range(row.max() + 1)])
        return row, col, head[row]

    def fold(t: pa.Table, edges: np.ndarray) -> pa.Table:
        t = t.take(pa.array(_ordered(edges, *(_numbers(t, c) for c in ("top", "x0", "box_no")))))
        box, flags, texts = [_numbers(t, c) for c in EDGES], t.column("is_header").to_pylist(), t.column("text").to_pylist()
        found = [places(*(x[a:b] for x in box), flags[a:b], texts[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        row, col, head = (np.concatenate(x) for x in zip(*found, strict=True))
        keys = [t.column(c) for c in ("doc_id", "table_no", "box_no")]
        return pa.table([*keys, pa.array(row.astype("int32")), pa.array(col.astype("int32")), pa.array(head), t.column("text")], names=["doc_id", "table_no", "box_no", "row_no", "col_no", "is_header", "text"])

    rows = cells.select("doc_id", "table_no", "box_no", *(F.col(c).cast("double") for c in ("x0", "x1", "top", "bottom")), "is_header", "text")
    return _streamed(rows, ["doc_id", "table_no"], fold, "doc_id long, table_no int, box_no long, row_no int, col_no int, is_header boolean, text string")
