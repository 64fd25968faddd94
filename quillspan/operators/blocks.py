"""Files, paragraphs, tables, sheets and pages to blocks (doc_id, block_no, type, level, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as T

PARSERS = {"pdf": ("pdf",), "word": ("docx", "doc"), "excel": ("xlsx", "xls"), "text": ("txt", "md", "html", "py", "log")}  # fixed values


def route_files(files: DataFrame) -> DataFrame:
    """``parser`` by the extension of ``file_name``, and whether there is one (``ok``)."""
    ext = T.extension(F.col("file_name"))
    parser = F.lit(None).cast("string")
    for name, exts in PARSERS.items():
        parser = F.when(ext.isin(*exts), name).otherwise(parser)
    return files.withColumn("parser", parser).withColumn("ok", parser.isNotNull())


def line_block_lists(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, ``keep``, blocks): the non-empty lines of ``text`` in order, the first and every seventh as titles. A document stays one row."""

    def block(text: Column, i: Column) -> Column:
        title = i % 7 == 0
        level = F.when(i == 0, 1).when(title, 1 + F.floor(i / 7).cast("int") % 3)
        return F.struct(i.alias("block_no"), F.when(title, "title").otherwise("paragraph").alias("type"), level.cast("int").alias("level"), text.alias("text"))

    return docs.select("doc_id", *keep, F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), block).alias("blocks"))


def line_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block_no, type, level, text) of :func:`line_block_lists`. No shuffle."""
    return line_block_lists(docs).select("doc_id", F.inline("blocks"))


def blocks_from_paragraphs(rows: DataFrame) -> DataFrame:
    """(doc_id, para_no, style, text): trimmed, empty ones dropped; ``Heading N`` is a title of level N (1 without N)."""
    heading = F.col("style").startswith("Heading")
    level = F.coalesce(F.regexp_extract("style", r"^Heading\s*(\d+)", 1).try_cast("int"), F.lit(1))
    kept = rows.withColumn("text", F.trim("text")).where("text <> ''")
    return kept.select("doc_id", F.col("para_no").alias("block_no"), F.when(heading, "title").otherwise("paragraph").alias("type"), F.when(heading, level).alias("level"), "text")


def cells_to_markdown(cells: DataFrame, *keys: str) -> DataFrame:
    """Tables of (keys, row_no, col_no, text) as Markdown: rows are padded to the widest, the first is the header."""
    cell = F.replace(F.replace(F.trim(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    # A table's cells are brought together once, sorted, and cut where a row begins: in linear time.
    tables = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row_no", "col_no", cell.alias("t")))).alias("s"))
    begins = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | ~F.get("s", i)["row_no"].eqNullSafe(F.get("s", i - 1)["row_no"]))
    tables = tables.select(*keys, F.col("s.t").alias("t"), begins.alias("begins"))
    rows = F.transform("begins", lambda a, i: F.slice("t", a + 1, F.coalesce(F.get("begins", i + 1), F.size("t")) - a))
    tables = tables.select(*keys, rows.alias("rows")).select(*keys, "rows", F.array_max(F.transform("rows", F.size)).alias("n"))
    bar = lambda x: F.concat(F.lit("| "), F.array_join(x, " | "), F.lit(" |"))
    lines = F.transform("rows", lambda r: bar(F.concat(r, F.array_repeat(F.lit(""), F.col("n") - F.size(r)))))
    rule = F.array(bar(F.array_repeat(F.lit("---"), F.col("n"))))
    tables = tables.select(*keys, lines.alias("lines"), rule.alias("rule"))
    return tables.select(*keys, F.array_join(F.concat(F.slice("lines", 1, 1), "rule", F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))), "\n").alias("markdown"))


def sheets_to_blocks(cells: DataFrame) -> DataFrame:
    """Workbook cells (doc_id, sheet_no, sheet, row_no, col_no, text): for each sheet a title and a table."""
    tables = cells_to_markdown(cells, "doc_id", "sheet_no", "sheet")
    two = F.array(F.struct(F.lit("title").alias("type"), F.col("sheet").alias("text")), F.struct(F.lit("table").alias("type"), F.col("markdown").alias("text")))
    return tables.select("doc_id", "sheet_no", F.posexplode(two).alias("k", "x")).select("doc_id", (2 * F.col("sheet_no") + F.col("k")).cast("int").alias("block_no"), "x.type", F.when(F.col("k") == 0, 1).alias("level"), "x.text")


def html_blocks(pages: DataFrame) -> DataFrame:
    """Headings and paragraphs of (page_id, html) in order, empty ones dropped. Pages are scanned for tags once; each
    match gives its tag and its text."""
    found = F.regexp_extract_all(T.marked(F.col("html")), F.lit(T.PART), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("block_no", "x"))
    tag = F.lower(F.regexp_extract("x", "^<(?i)(h[1-6]|p)", 1))
    rows = rows.select("page_id", "block_no", tag.alias("tag"), T.plain(F.regexp_replace("x", "^<[^>]*>", "")).alias("text")).where("text <> ''")
    return rows.select("page_id", "block_no", F.when(F.col("tag") == "p", "paragraph").otherwise("title").alias("type"), F.when(F.col("tag") != "p", F.substring("tag", 2, 1).cast("int")).alias("level"), "text")
