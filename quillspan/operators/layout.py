"""Characters, boxes and regions of pages: reading order, tags, tables, document order.

All keys begin with (doc_id, page_number), which bounds every join and window to a page;
regions and pages are small, documents many. Box columns: doc_id, page_number, box_no, x0, x1,
top, bottom, text, layout_type, layoutno."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T

PAGE = ("doc_id", "page_number")
#: Earlier types win.
PRIORITY = ("footer", "header", "reference", "figure caption", "table caption", "title", "table", "text", "figure", "equation")  # fixed values
FURNITURE = ("footer", "header", "reference")  # fixed values
ENGLISH = r"""[a-zA-Z0-9,/¸;:'\[\]()!@#$%^&*\"?<>._-]"""  # fixed value
# Patterns of a cell's text and their codes, in order: dates, numbers, codes, English, names with numbers, single characters.
CELL_PATTERNS = (
    ("^(20|19)[0-9]{2}[年/-][0-9]{1,2}[月/-][0-9]{1,2}日*$", "Dt"),
    ("^(20|19)[0-9]{2}年$", "Dt"),
    ("^(20|19)[0-9]{2}[年-][0-9]{1,2}月*$", "Dt"),
    ("^[0-9]{1,2}[月-][0-9]{1,2}日*$", "Dt"),
    ("^第*[一二三四1-4]季度$", "Dt"),
    ("^(20|19)[0-9]{2}年*[一二三四1-4]季度$", "Dt"),
    ("^(20|19)[0-9]{2}[ABCDE]$", "Dt"),
    ("^[0-9.,+%/ -]+$", "Nu"),
    (r"^[0-9A-Z/\._~-]+$", "Ca"),
    ("^[A-Z]*[a-z' -]+$", "En"),
    ("^[0-9.,+-]+[0-9A-Za-z/$￥%<>（）()' -]+$", "NE"),
    ("^.{1}$", "Sg"),
)


def visible_chars(chars: DataFrame) -> DataFrame:
    """Without grey characters of white stroke and fill whose text looks like markup."""
    first = lambda c: F.get(c, 0)
    hidden = (F.col("ncs") == "DeviceGray") & (first("stroking_color") == 1) & (first("non_stroking_color") == 1) & F.col("text").rlike(r"^[a-zT_\[\]()-]+")
    return chars.where(~F.coalesce(hidden, F.lit(False)))


def space_chars(chars: DataFrame) -> DataFrame:
    """A space after a character if the next, of like kind, begins at least half the smaller width later."""
    w = Window.partitionBy(*PAGE).orderBy("char_no")
    gap = F.lead("x0").over(w) - F.col("x1") >= F.least("width", F.lead("width").over(w)) / 2
    like = F.concat("text", F.lead("text").over(w)).rlike(r"^[0-9a-zA-Z,.:;!%]+$")
    return chars.withColumn("text", F.when(gap & like, F.concat("text", F.lit(" "))).otherwise(F.col("text")))


def page_stats(chars: DataFrame, pages: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Median character height and width (8 without any), and the height of all pages before. A page without
    characters has the median height of its ``boxes`` that hold text, else 0."""
    med = chars.groupBy(*PAGE).agg(F.percentile(F.when(F.col("height") > 0, F.col("height")), F.lit(0.5)).alias("h"), F.percentile(F.when(F.col("width") > 0, F.col("width")), F.lit(0.5)).alias("w"))
    before = F.sum("page_height").over(Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1))
    rows = pages.select(*PAGE, "page_height", F.coalesce(before, F.lit(0.0)).alias("cum")).join(med, [*PAGE], "left")
    own = F.lit(None).cast("double")
    if boxes is not None:
        tall = F.when((F.trim("text") != "") & (F.col("bottom") > F.col("top")), F.col("bottom") - F.col("top"))
        rows, own = rows.join(boxes.groupBy(*PAGE).agg(F.percentile(tall, F.lit(0.5)).alias("b")), [*PAGE], "left"), F.col("b")
    return rows.select(*PAGE, F.coalesce("h", own, F.lit(0.0)).alias("mean_height"), F.coalesce("w", F.lit(8.0)).alias("mean_width"), "cum")


def to_document_y(boxes: DataFrame, stats: DataFrame) -> DataFrame:
    cum = stats.select(*PAGE, "cum")
    return boxes.join(cum, [*PAGE]).withColumns({"top": F.col("top") + F.col("cum"), "bottom": F.col("bottom") + F.col("cum")}).drop("cum")


def english_docs(pages: DataFrame, run: int = 30) -> DataFrame:
    """(doc_id, is_english) from (doc_id, page_number, text): over half the pages hold ``run`` characters of ENGLISH in a row."""
    flag = F.col("text").rlike(f"{ENGLISH}{{{run},}}")
    return pages.groupBy("doc_id").agg((F.avg(flag.cast("int")) > 0.5).alias("is_english"))


def reading_order(boxes: DataFrame, threshold: float = 6.0) -> DataFrame:
    """``line_no`` and ``order_no`` in a page: tops closer than the threshold to the one before are one line."""
    by_top = Window.partitionBy(*PAGE).orderBy("top", "x0", "box_no")
    new = F.coalesce((F.col("top") - F.lag("top").over(by_top) >= threshold).cast("int"), F.lit(0))
    rows = boxes.withColumn("_new", new).withColumn("line_no", F.sum("_new").over(by_top).cast("int")).drop("_new")
    return rows.withColumn("order_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("line_no", "x0", "box_no")))


def _share(a: str, b: str) -> Column:
    """Share of a's area that lies in b."""
    w = F.least(f"{a}.x1", f"{b}.x1") - F.greatest(f"{a}.x0", f"{b}.x0")
    h = F.least(f"{a}.bottom", f"{b}.bottom") - F.greatest(f"{a}.top", f"{b}.top")
    area = (F.col(f"{a}.x1") - F.col(f"{a}.x0")) * (F.col(f"{a}.bottom") - F.col(f"{a}.top"))
    return F.when((w > 0) & (h > 0) & (area > 0), w * h / area).otherwise(0.0)


#: Height of the bands of a page in which boxes meet, in its units.
BAND = 48.0


def overlapping(a: DataFrame, b: DataFrame, band: float = BAND) -> DataFrame:
    """Pairs ``a``, ``b`` of boxes of a page that overlap. Boxes meet in bands of the page's height, each pair in the one where what they
    share begins: a page of very many characters is spread over tasks, and rows met are near those that overlap."""
    bands = F.explode(F.sequence(F.floor(F.col("top") / band), F.floor(F.greatest("top", "bottom") / band))).alias("_band")
    a, b = a.select("*", bands).alias("a"), b.select("*", bands).alias("b")
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_number") == F.col("b.page_number")) & (F.col("a._band") == F.col("b._band"))
    meet = (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.top") < F.col("b.bottom")) & (F.col("b.top") < F.col("a.bottom"))
    return a.join(b, same & meet & (F.floor(F.greatest("a.top", "b.top") / band) == F.col("a._band")))


def best_overlap(a: DataFrame, b: DataFrame, threshold: float | None = None) -> DataFrame:
    """(doc_id, page_number, box_no, region_no, share): for each box the region that covers most
    of it; ties by the share of the region, then the last region if there is a threshold (above 0), else
    the first. Boxes without overlap (or below the threshold) have none."""
    rows = overlapping(a, b).select("a.doc_id", "a.page_number", "a.box_no", "b.region_no", F.round(_share("a", "b"), 6).alias("share"), F.round(_share("b", "a"), 6).alias("back"))
    rows = rows.where(F.col("share") >= threshold) if threshold is not None else rows.where("share > 0")
    # The best of each box is found while rows are summed up, before the shuffle.
    best = F.max(F.struct("share", "back", (F.col("region_no") if threshold is not None else -F.col("region_no")).alias("r"), "region_no")).alias("x")
    return rows.groupBy(*PAGE, "box_no").agg(best).select(*PAGE, "box_no", "x.region_no", "x.share")


def tag_layout(boxes: DataFrame, regions: DataFrame, threshold: float = 0.4) -> DataFrame:
    """``layout_type`` and ``layoutno`` of the region of the first type in PRIORITY that covers enough of a
    box; equations count as figures. Furniture that scores below 0.4 isn't looked at."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("b.type"))
    use = regions.where(~(F.col("type").isin(*FURNITURE) & (F.col("score") < 0.4)))
    rows = overlapping(boxes.select(*PAGE, "box_no", "x0", "x1", "top", "bottom"), use).select("a.doc_id", "a.page_number", "a.box_no", "b.region_no", "b.type", rank.alias("rank"), F.round(_share("a", "b"), 6).alias("share")).where((F.col("share") >= threshold) & (F.col("rank") > 0))
    first = F.min(F.struct("rank", (-F.col("share")).alias("s"), (-F.col("region_no")).alias("r"), "type", "region_no")).alias("x")
    rows = rows.groupBy(*PAGE, "box_no").agg(first).select(*PAGE, "box_no", "x.type", "x.region_no")
    kind = F.when(F.col("type") == "equation", "figure").otherwise(F.col("type"))
    best = rows.select(*PAGE, "box_no", kind.alias("layout_type"), F.concat("type", F.lit("-"), F.col("region_no").cast("string")).alias("layoutno"))
    return boxes.drop("layout_type", "layoutno").join(best, [*PAGE, "box_no"], "left").fillna({"layout_type": "", "layoutno": ""})


def drop_furniture(boxes: DataFrame, page_height: float) -> DataFrame:
    """Without running headers, footers and references, nor any box of the document whose text was dropped twice under one type."""
    kind = F.col("layout_type")
    gone = (kind == "reference") | ((kind == "footer") & ~(F.col("bottom") < 0.9 * page_height)) | ((kind == "header") & ~(F.col("top") > 0.1 * page_height))
    flagged = boxes.withColumn("_gone", F.coalesce(gone, F.lit(False)))
    often = flagged.where("_gone").groupBy("doc_id", "layout_type", F.xxhash64("text").alias("_t")).agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "_t").distinct()
    return flagged.where("not _gone").withColumn("_t", F.xxhash64("text")).join(often, ["doc_id", "_t"], "left_anti").select(*boxes.columns)


def figure_boxes(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """Figure regions that no box was tagged with, as empty boxes."""
    tagged = boxes.select(*PAGE, "layoutno").distinct()
    figures = regions.where("type in ('figure', 'equation')").withColumn("layoutno", F.concat("type", F.lit("-"), F.col("region_no").cast("string")))
    return figures.join(tagged, [*PAGE, "layoutno"], "left_anti").select(*PAGE, "layoutno", "x0", "x1", "top", "bottom", F.lit("").alias("text"), F.lit("figure").alias("layout_type"))


# Headings of contents and acknowledgements, without their spaces.
CONTENTS = ("contents", "目录", "目次", "致谢", "acknowledge")


def with_contents(boxes: DataFrame) -> DataFrame:
    """(doc_id) of the documents that have a heading of contents or acknowledgements."""
    return boxes.where(F.regexp_replace(F.lower("text"), "[ \u3000]+", "").isin(*CONTENTS)).select("doc_id").distinct()


def dotted_pages(boxes: DataFrame, most: int = 3, before: DataFrame | None = None) -> DataFrame:
    """Boxes of pages with at most ``most`` boxes that hold dotted leaders. Documents that had a contents heading keep theirs, as
    its entries are gone already; ``before`` are the boxes as they were when it stood there (``boxes``, by default)."""
    dotted = boxes.groupBy(*PAGE).agg(F.count_if(F.col("text").contains("··")).alias("n")).where(F.col("n") > most)
    dotted = dotted.join(with_contents(boxes if before is None else before), "doc_id", "left_anti")
    return boxes.join(dotted, [*PAGE], "left_anti")


PARTING = ("table caption", "title", "figure caption", "reference")  # fixed values


def stitch_tables(boxes: DataFrame, stats: DataFrame, most: float = 23.0) -> DataFrame:
    """(doc_id, page_number, layoutno, table_id): tables that go on from the page before share an
    id: where the middles of the last box of one and the first of the next are at most ``most`` character heights apart, down
    the whole document, and no caption, title or reference came after the first before any other table or
    figure. Boxes that only name a source are left out."""
    source = F.trim("text").rlike("^(数据|资料|图表)*来源[:： ]")
    key = F.concat(F.col("page_number").cast("string"), F.lit("-"), "layoutno")
    rows = to_document_y(boxes.where("coalesce(layoutno, '') <> ''"), stats).withColumns({"_key": key, "_mid": (F.col("top") + F.col("bottom")) / 2})
    shown = F.col("layout_type").isin("table", "figure") & ~F.coalesce(source, F.lit(False))
    before = Window.partitionBy("doc_id").orderBy("page_number", "top", "x0", "box_no").rowsBetween(Window.unboundedPreceding, -1)
    parting = is_caption(F.col("text"), F.col("layout_type")) | F.col("layout_type").isin(*PARTING)
    closed = rows.withColumn("_key", F.last(F.when(shown, F.col("_key")), ignorenulls=True).over(before)).where(parting).select("doc_id", "_key", F.lit(True).alias("_closed")).distinct()
    place = F.struct("top", "x0", "box_no")
    tables = rows.where(shown & (F.col("layout_type") == "table")).groupBy(*PAGE, "layoutno", "_key").agg(F.min(place).alias("first"), F.min_by("_mid", place).alias("begin"), F.max_by("_mid", place).alias("end"))
    tables = tables.join(closed, ["doc_id", "_key"], "left").join(stats.select(*PAGE, "mean_height"), [*PAGE])
    w = Window.partitionBy("doc_id").orderBy("first.top", "first.x0", "layoutno")
    near = (F.col("page_number") == F.lag("page_number").over(w) + 1) & F.lag("_closed").over(w).isNull() & (F.col("begin") - F.lag("end").over(w) <= most * F.col("mean_height"))
    starts = tables.withColumn("_start", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1))
    return starts.withColumn("table_id", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).select(*PAGE, "layoutno", "table_id")


def is_caption(text: Column, layout: Column) -> Column:
    return F.coalesce(F.trim(text).rlike("^[图表]+[ 0-9:：]{2,}"), F.lit(False)) | F.coalesce(layout.contains("caption"), F.lit(False))


#: How far up and down a document boxes are looked at for a caption, before all of them are.
REACH = (500.0, 8000.0)


def attach_captions(captions: DataFrame, boxes: DataFrame, stats: DataFrame | None = None, reach: tuple[float, ...] = REACH) -> DataFrame:
    """(doc_id, page_number, cap_no, kind, box_page, box_no): the nearest table or figure box of the document for each caption by
    squared distance, a table only if strictly nearer; captions among ``boxes`` don't count. Where the widths overlap only
    heights count. With ``stats`` tops are in their pages, and are moved down the document first; without, they are already.

    Captions meet the boxes of the three bands of a document around them. What lies beyond is farther than a band is high, so that a
    box found within that is the nearest; captions without one go on with higher bands, and the few left meet all boxes."""
    captions, boxes = (df if stats is None else to_document_y(df, stats) for df in (captions, boxes))
    middle = F.col("top") + F.col("bottom")
    boxes = boxes.where("not layout_type like '%caption%'").select("doc_id", F.col("page_number").alias("box_page"), "box_no", "layout_type", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), middle.alias("_by"))
    left = captions.select("doc_id", "page_number", F.col("box_no").alias("cap_no"), "x0", "x1", middle.alias("_cy"))
    apart = (F.col("bx1") < F.col("x0")) | (F.col("bx0") > F.col("x1"))
    dx = F.when(apart, (F.col("bx0") + F.col("bx1") - F.col("x0") - F.col("x1")) / 2).otherwise(0.0)
    dy = (F.col("_by") - F.col("_cy")) / 2
    # The least of each caption is found while rows are summed up, before the shuffle.
    best = F.min(F.struct(F.round(dx * dx + dy * dy, 4).alias("d"), F.when(F.col("layout_type") == "figure", 0).otherwise(1).alias("o"), "box_page", "box_no", F.col("layout_type").alias("kind"))).alias("x")
    keys, out = ["doc_id", "page_number", "cap_no"], None
    for far in (*reach, None):
        if far is None:
            met = left.join(boxes, "doc_id")
        else:
            band = lambda c: F.floor(F.col(c) / 2 / far)  # noqa: B023, E731
            met = left.withColumn("_band", F.explode(F.sequence(band("_cy") - 1, band("_cy") + 1))).join(boxes.withColumn("_band", band("_by")), ["doc_id", "_band"])
        found = met.groupBy(*keys).agg(best)
        if far is not None:
            found = found.where(F.col("x.d") < far * far)
            left = left.join(found.select(*keys), keys, "left_anti")
        out = found if out is None else out.unionByName(found)
    return out.select(*keys, "x.kind", "x.box_page", "x.box_no")


def _trimmed(text: Column) -> Column:
    text, space = F.coalesce(text, F.lit("")), r"[\s\p{Z}]"
    # Most texts have no white space at their ends, and need no look at the rest.
    ends = F.substring(text, 1, 1).rlike(space) | F.substring(text, -1, 1).rlike(space)
    return F.when(ends, F.regexp_replace(text, rf"^{space}+|{space}+$", "")).otherwise(text)


#: What a text that fits the patterns of a code begins with: most texts need no look at most patterns.
_BEGINS = {"Dt": "1234一二三四第056789", "Nu": "0123456789.,+%/ -", "Ca": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ/._~-", "En": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz' -", "NE": "0123456789.,+-"}
_NUMERIC = "0123456789.,+-"
KINDS = (*dict.fromkeys(k for _, k in CELL_PATTERNS), "Nr", "Lx", "Tx", "Ot")


def _pattern_of(t: Column) -> Column:
    """The code of the first pattern that a trimmed text fits, else null. Patterns of one code that follow each other are tried at once."""
    out = F.lit(None).cast("string")
    for kind, own in reversed([(k, [p for p, _ in g]) for k, g in groupby(CELL_PATTERNS, key=lambda x: x[1])]):
        fits = t.rlike("|".join(own))
        if kind in _BEGINS:
            fits = F.substring(t, 1, 1).isin(*_BEGINS[kind]) & fits
        out = F.when(fits, kind).otherwise(out)
    return out


def _solid(t: Column) -> Column:
    """How many characters of a text aren't white space."""
    return F.length(F.regexp_replace(t, r"[\s\p{Z}]+", ""))


def _rest_of(t: Column, solid: Column, n: Column) -> Column:
    """The code of a trimmed text that fits no pattern, of ``solid`` characters and ``n`` tokens."""
    number = (solid > 0) & (F.length(t) - F.length(F.translate(t, _NUMERIC, "")) >= 0.8 * solid)
    return F.when(number, "Nr").when(n >= 12, "Lx").when(n > 3, "Tx").otherwise("Ot")


def cell_type(text: Column) -> Column:
    """The code of the first pattern that the trimmed text fits; Nr if 80 % of it, but for white space, are
    digits, points, commas and signs; Tx for more than three tokens, Lx for twelve or more; else Ot. Null is as an empty text.
    For whole columns :func:`with_cell_type` is faster."""
    # The text is trimmed once, not anew for each pattern.
    return F.element_at(F.transform(F.array(_trimmed(text)), lambda t: F.coalesce(_pattern_of(t), _rest_of(t, _solid(t), T.words(t)))), 1)


def with_cell_type(cells: DataFrame, name: str = "kind", text: str = "text") -> DataFrame:
    """``cells`` with :func:`cell_type` of ``text`` as ``name``. The trimmed text is a column of its own, so that the patterns are tried on
    it in generated code; only texts without one are counted, each once."""
    rows = cells.withColumn("_trimmed", _trimmed(F.col(text))).withColumn("_pattern", _pattern_of(F.col("_trimmed")))
    rest = F.col("_pattern").isNull()
    rows = rows.withColumns({"_solid": F.when(rest, _solid(F.col("_trimmed"))), "_n": F.when(rest, T.words(F.col("_trimmed")))})
    kind = F.when(rest, _rest_of(F.col("_trimmed"), F.col("_solid"), F.col("_n"))).otherwise(F.col("_pattern"))
    return rows.withColumn(name, kind).drop("_trimmed", "_pattern", "_solid", "_n")


def majority_type(cells: DataFrame, key: str) -> DataFrame:
    """The most common cell type of each table, ties by type. A table's counts are one row, so that they are shuffled once and not sorted."""
    kinds = sorted(KINDS)
    counts = with_cell_type(cells.select(key, "text")).groupBy(key).agg(*(F.count_if(F.col("kind") == k).alias(f"_{k}") for k in kinds))
    best = F.greatest(*(F.struct(F.col(f"_{k}").alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("kind")) for i, k in enumerate(kinds)))
    return counts.select(key, best.alias("x")).select(key, "x.kind", "x.n")


def align_edges(parts: DataFrame) -> DataFrame:
    """Rows of a table widened to a common left and right, columns to a common top and bottom.

    Of more than four rows the mean is common, else the extreme; of columns the median."""
    key = ("doc_id", "page_number", "table_no")
    w = Window.partitionBy(*key, "label")
    many = F.count("*").over(w) > 4
    mid = lambda c: F.percentile(c, F.lit(0.5)).over(w)
    left, right = F.when(many, F.avg("x0").over(w)).otherwise(F.min("x0").over(w)), F.when(many, F.avg("x1").over(w)).otherwise(F.max("x1").over(w))
    top, bottom = F.when(many, mid("top")).otherwise(F.min("top").over(w)), F.when(many, mid("bottom")).otherwise(F.max("bottom").over(w))
    row, col = F.col("label") == "row", F.col("label") == "column"
    return parts.select(*key, "part_no", "label", *(F.when(which, f(c, v)).otherwise(F.col(c)).alias(c) for c, which, f, v in (("x0", row, F.least, left), ("x1", row, F.greatest, right), ("top", col, F.least, top), ("bottom", col, F.greatest, bottom))))


def grid_html(cells: DataFrame, captions: DataFrame) -> DataFrame:
    """(table_no, html) of (table_no, row_no, col_no, text, is_header): cells of a place are joined,
    missing ones empty, a header row that repeats is left out."""
    tables = _rows(cells).groupBy("table_no").agg(F.max("last").alias("last"), F.collect_list(F.struct("row_no", "is_header", "m")).alias("rows"))
    tag = lambda x, h: F.when(h, F.concat(F.lit("<th>"), x, F.lit("</th>"))).otherwise(F.concat(F.lit("<td>"), x, F.lit("</td>")))
    line = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(_full(r["m"], F.col("last")), lambda x: tag(x, r["is_header"])), ""), F.lit("</tr>"))
    lines = F.transform("rows", lambda r: F.struct(r["is_header"].alias("h"), F.array_join(_full(r["m"], F.col("last")), "\u0001").alias("line"), r["row_no"].alias("row_no"), line(r).alias("t")))
    body = F.filter("lines", lambda r: F.coalesce(~r["h"], F.lit(False)))
    heads = F.sort_array(F.filter("lines", lambda r: F.coalesce(r["h"], F.lit(True))))
    # Header rows that repeat stand together when they are sorted, the first of them first.
    first = lambda own: F.filter(own, lambda x, i: (i == 0) | ~(F.get(own, i - 1)["h"].eqNullSafe(x["h"]) & (F.get(own, i - 1)["line"] == x["line"])))
    shown = F.concat("body", F.element_at(F.transform(F.array("heads"), first), 1))
    text = F.array_join(F.transform(F.sort_array(F.transform(shown, lambda x: F.struct(x["row_no"], x["t"]))), lambda x: x["t"]), "\n")
    done = tables.select("table_no", lines.alias("lines")).select("table_no", body.alias("body"), heads.alias("heads")).select("table_no", text.alias("body"))
    cap = F.when(F.coalesce("caption", F.lit("")) != "", F.concat(F.lit("<caption>"), "caption", F.lit("</caption>"))).otherwise("")
    return done.join(captions.hint("shuffle_hash"), "table_no", "left").select("table_no", F.concat(F.lit("<table>"), cap, F.lit("\n"), "body", F.lit("\n</table>")).alias("html"))


def _rows(cells: DataFrame) -> DataFrame:
    """(table_no, row_no, is_header, m, last): each row's columns and texts in order, and its last column."""
    return cells.groupBy("table_no", "row_no").agg(F.max("is_header").alias("is_header"), F.max("col_no").alias("last"), F.sort_array(F.collect_list(F.struct("col_no", "text"))).alias("m"))


def _full(m: Column, last: Column) -> Column:
    """Texts of the columns up to ``last``; those of one place are joined, the missing are empty."""
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.array_join(F.transform(F.filter(m, lambda x: x["col_no"] == c), lambda x: x["text"]), " "))


def grid_sentences(cells: DataFrame, captions: DataFrame) -> DataFrame:
    """(table_no, row_no, sentence): each body row as ``header：value`` parts under the last header row above, with the caption."""
    down = Window.partitionBy("table_no").orderBy("row_no")
    rows = _rows(cells).withColumn("head", F.last(F.when(F.col("is_header"), F.col("m")), ignorenulls=True).over(down))
    rows = rows.withColumn("last", F.max("last").over(Window.partitionBy("table_no"))).where("not is_header")
    rows = rows.select("table_no", "row_no", _full(F.col("m"), F.col("last")).alias("cells"), F.when(F.col("head").isNotNull(), _full(F.col("head"), F.col("last"))).alias("head"))
    body = rows.join(captions.hint("shuffle_hash"), "table_no", "left")
    part = lambda h, v: F.when(F.coalesce(h, F.lit("")) != "", F.concat(h, F.lit("："), v)).otherwise(v)
    parts = F.filter(F.transform("cells", lambda v, i: F.when(v != "", part(F.get("head", i), v))), lambda x: x.isNotNull())
    tail = F.when(F.coalesce("caption", F.lit("")) != "", F.concat(F.lit("\t——"), "caption")).otherwise("")
    return body.select("table_no", "row_no", F.concat(F.array_join(parts, "; "), tail).alias("sentence"))


def assemble_blocks(text: DataFrame, tables: DataFrame) -> DataFrame:
    """Texts and tables (doc_id, page_number, top, x0, type, text) in document order as ``block_no``."""
    order = Window.partitionBy("doc_id").orderBy("page_number", "top", "x0", "type")
    return text.unionByName(tables).withColumn("block_no", F.row_number().over(order) - 1)
