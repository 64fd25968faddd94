"""Boxes, regions and characters derived from the lines of documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.operators import chunks as C
from quillspan.operators import folds as D
from quillspan.operators import layout as L
from quillspan.queries.core import query, table, with_
from quillspan.queries.ingest import CELLS, cells

BOXES = """lines AS (SELECT doc_id, len(l) AS n, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)),
boxes AS (SELECT doc_id, (i // 40 + 1)::INTEGER AS page_number, i AS box_no, (50 + 250 * (i % 2))::DOUBLE AS x0, (50 + 250 * (i % 2) + 40 * len(string_split(text, ' ')))::DOUBLE AS x1, ((i % 40) * 15)::DOUBLE AS top, ((i % 40) * 15 + 12)::DOUBLE AS bottom, text,
  CASE WHEN i % 40 = 0 THEN 'header' WHEN i % 40 = 39 OR i = n - 1 THEN 'footer' WHEN i % 11 = 0 THEN 'title' WHEN i % 13 = 0 THEN 'table' ELSE 'text' END AS layout_type FROM lines)"""
REGIONS = """regions AS (SELECT *, 0.5 + (region_no % 5) / 10.0::DOUBLE AS score FROM (SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY layout_type) AS region_no, layout_type AS type, min(x0) - 2 AS x0, max(x1) + 2 AS x1, min(top) - 2 AS top, max(bottom) + 2 AS bottom FROM boxes GROUP BY doc_id, page_number, layout_type))"""
CHARS = """wordlists AS (SELECT *, string_split(text, ' ') AS w FROM boxes),
chars AS (SELECT doc_id, page_number, char_no, text, x0, x0 + 36 AS x1, top, bottom, 36.0::DOUBLE AS width, 12.0::DOUBLE AS height, j FROM (SELECT doc_id, page_number, box_no * 100000 + generate_subscripts(w, 1) - 1 AS char_no, generate_subscripts(w, 1) - 1 AS j, unnest(w) AS text, x0 + 40 * (generate_subscripts(w, 1) - 1) AS x0, top, bottom FROM wordlists))"""


def boxes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("l"))
    rows = rows.select("doc_id", F.size("l").alias("n"), F.posexplode("l").alias("i", "text"))
    i = F.col("i")
    kind = F.when(i % 40 == 0, "header").when((i % 40 == 39) | (i == F.col("n") - 1), "footer").when(i % 11 == 0, "title").when(i % 13 == 0, "table").otherwise("text")
    x0 = (50 + 250 * (i % 2)).cast("double")
    return rows.select("doc_id", (F.floor(i / 40) + 1).cast("int").alias("page_number"), i.cast("long").alias("box_no"), x0.alias("x0"), (x0 + 40 * F.size(F.split("text", " "))).alias("x1"), ((i % 40) * 15).cast("double").alias("top"), ((i % 40) * 15 + 12).cast("double").alias("bottom"), "text", kind.alias("layout_type"), F.concat(kind, F.lit("-0")).alias("layoutno"))


def regions(spark, sf_dir):
    own = boxes(spark, sf_dir).groupBy("doc_id", "page_number", F.col("layout_type").alias("type")).agg((F.min("x0") - 2).alias("x0"), (F.max("x1") + 2).alias("x1"), (F.min("top") - 2).alias("top"), (F.max("bottom") + 2).alias("bottom"))
    rows = own.withColumn("region_no", F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("type")).cast("long"))
    return rows.withColumn("score", 0.5 + (F.col("region_no") % 5) / 10)


def chars(spark, sf_dir):
    """A character row for each word of a box."""
    rows = boxes(spark, sf_dir).select("doc_id", "page_number", "box_no", "x0", "top", "bottom", F.posexplode(F.split("text", " ")).alias("j", "t"))
    x0 = F.col("x0") + 40 * F.col("j")
    color = lambda k: F.array(F.when(F.col("j") % k == 0, 1.0).otherwise(0.0))
    return rows.select("doc_id", "page_number", (F.col("box_no") * 100000 + F.col("j")).alias("char_no"), F.col("t").alias("text"), x0.alias("x0"), (x0 + 36).alias("x1"), "top", "bottom", F.lit(36.0).alias("width"), F.lit(12.0).alias("height"), F.when(F.col("j") % 3 == 0, "DeviceGray").otherwise("DeviceRGB").alias("ncs"), color(2).alias("stroking_color"), color(1).alias("non_stroking_color"), "j")


@query(with_(BOXES, CHARS) + r" SELECT doc_id, page_number, char_no, text FROM chars WHERE NOT (j % 6 = 0 AND regexp_matches(text, '^[a-zT_\[\]()-]+'))")
def visible_chars(spark, sf_dir):
    return L.visible_chars(chars(spark, sf_dir)).select("doc_id", "page_number", "char_no", "text")


@query(with_(BOXES, CHARS) + r""", n AS (SELECT *, lead(text) OVER w AS nt, lead(x0) OVER w AS nx, lead(width) OVER w AS nw FROM chars WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY char_no))
SELECT doc_id, page_number, char_no, CASE WHEN nx - x1 >= least(width, nw) / 2 AND regexp_matches(text || nt, '^[0-9a-zA-Z,.:;!%]+$') THEN text || ' ' ELSE text END AS text FROM n""")
def space_chars(spark, sf_dir):
    return L.space_chars(chars(spark, sf_dir)).select("doc_id", "page_number", "char_no", "text")


STATS = "pages_ AS (SELECT DISTINCT doc_id, page_number, 600.0::DOUBLE AS page_height FROM boxes), med AS (SELECT doc_id, page_number, median(height) AS mean_height, median(width) AS mean_width FROM chars GROUP BY ALL), stats AS (SELECT doc_id, page_number, coalesce(mean_height, 0) AS mean_height, coalesce(mean_width, 8) AS mean_width, coalesce(sum(page_height) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM pages_ LEFT JOIN med USING (doc_id, page_number))"


def stats(spark, sf_dir):
    return L.page_stats(chars(spark, sf_dir), boxes(spark, sf_dir).select("doc_id", "page_number", F.lit(600.0).alias("page_height")).distinct())


@query(with_(BOXES, CHARS, STATS) + " SELECT * FROM stats")
def page_stats(spark, sf_dir):
    return stats(spark, sf_dir)


@query(with_(BOXES) + " SELECT doc_id, page_number, box_no, top + 600 * (page_number - 1) AS top, bottom + 600 * (page_number - 1) AS bottom FROM boxes")
def document_y(spark, sf_dir):
    return L.to_document_y(boxes(spark, sf_dir), stats(spark, sf_dir)).select("doc_id", "page_number", "box_no", "top", "bottom")


@query(with_(BOXES) + r""", t AS (SELECT doc_id, page_number, string_agg(CASE WHEN doc_id % 2 = 0 THEN replace(text, ' ', '') ELSE text END, chr(10) ORDER BY box_no) AS text FROM boxes GROUP BY ALL)
SELECT doc_id, avg(regexp_matches(text, '[a-zA-Z0-9,/¸;:''\[\]()!@#$%^&*"?<>._-]{30,}')::INTEGER) > 0.5 AS is_english FROM t GROUP BY doc_id""")
def english_docs(spark, sf_dir):
    rows = boxes(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(" "), F.lit(""))).otherwise(F.col("text")))
    pages = rows.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("box_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return L.english_docs(pages)


@query(with_(BOXES) + """, s AS (SELECT *, CASE WHEN top - lag(top) OVER (PARTITION BY doc_id, page_number ORDER BY top, x0, box_no) >= 20 THEN 1 ELSE 0 END AS new FROM boxes),
l AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_number ORDER BY top, x0, box_no ROWS UNBOUNDED PRECEDING)::INTEGER AS line_no FROM s)
SELECT doc_id, page_number, box_no, line_no, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no, x0, box_no)::INTEGER AS order_no FROM l""")
def reading_order(spark, sf_dir):
    return L.reading_order(boxes(spark, sf_dir), 20.0).select("doc_id", "page_number", "box_no", "line_no", "order_no")


def sql_share(a: str, b: str) -> str:
    return f"greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0) * greatest(least({a}.bottom, {b}.bottom) - greatest({a}.top, {b}.top), 0) / nullif(({a}.x1 - {a}.x0) * ({a}.bottom - {a}.top), 0)"


@query(with_(BOXES, REGIONS) + f""", m AS (SELECT a.doc_id, a.page_number, a.box_no, b.region_no, round({sql_share('a', 'b')}, 6) AS share, round({sql_share('b', 'a')}, 6) AS back FROM boxes a JOIN regions b ON a.doc_id = b.doc_id AND a.page_number = b.page_number)
SELECT doc_id, page_number, box_no, region_no, share FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, box_no ORDER BY share DESC, back DESC, region_no DESC) AS n FROM m WHERE share >= 0.4) WHERE n = 1""")
def best_overlap(spark, sf_dir):
    return L.best_overlap(boxes(spark, sf_dir), regions(spark, sf_dir), 0.4)


@query(with_(BOXES) + " SELECT doc_id, page_number, box_no, replace(text, ' ', '') AS text FROM boxes")
def chars_to_boxes(spark, sf_dir):
    return D.chars_to_boxes(chars(spark, sf_dir), boxes(spark, sf_dir)).select("doc_id", "page_number", "box_no", "text")


@query(with_(BOXES, REGIONS) + f""", m AS (SELECT a.doc_id, a.page_number, a.box_no, b.region_no, b.type, list_position(['footer', 'header', 'reference', 'figure caption', 'table caption', 'title', 'table', 'text', 'figure', 'equation'], b.type) AS rank, round({sql_share('a', 'b')}, 6) AS share FROM boxes a JOIN regions b ON a.doc_id = b.doc_id AND a.page_number = b.page_number),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, box_no ORDER BY rank, share DESC, region_no DESC) AS n FROM m WHERE share >= 0.4)
SELECT b.doc_id, b.page_number, b.box_no, coalesce(m.type, '') AS layout_type, coalesce(m.type || '-' || m.region_no, '') AS layoutno FROM boxes b LEFT JOIN best m ON m.doc_id = b.doc_id AND m.page_number = b.page_number AND m.box_no = b.box_no AND m.n = 1""")
def tag_layout(spark, sf_dir):
    return L.tag_layout(boxes(spark, sf_dir), regions(spark, sf_dir)).select("doc_id", "page_number", "box_no", "layout_type", "layoutno")


@query(with_(BOXES) + """, g AS (SELECT *, (layout_type = 'footer' AND NOT bottom < 540) OR (layout_type = 'header' AND NOT top > 60) AS gone FROM boxes),
often AS (SELECT DISTINCT doc_id, text FROM (SELECT doc_id, layout_type, text FROM g WHERE gone GROUP BY ALL HAVING count(*) > 1))
SELECT doc_id, page_number, box_no FROM g WHERE NOT gone AND NOT EXISTS (SELECT 1 FROM often o WHERE o.doc_id = g.doc_id AND o.text = g.text)""")
def drop_furniture(spark, sf_dir):
    return L.drop_furniture(boxes(spark, sf_dir), 600.0).select("doc_id", "page_number", "box_no")


@query(with_(BOXES, REGIONS) + " SELECT doc_id, page_number, 'figure-' || region_no AS layoutno, x0, x1, top, bottom, '' AS text, 'figure' AS layout_type FROM regions WHERE type = 'table'")
def figure_boxes(spark, sf_dir):
    r = regions(spark, sf_dir).withColumn("type", F.when(F.col("type") == "table", "figure").otherwise(F.col("type")))
    return L.figure_boxes(boxes(spark, sf_dir), r)


# Where a contents heading stands first: it, its first entry, and what follows up to the next of 128 boxes that begins with the entry's first two words.
HEADED = """, h AS (SELECT * REPLACE (CASE WHEN box_no = 0 AND {0} THEN 'Contents' WHEN box_no % 9 = 0 THEN text || '····' ELSE text END AS text) FROM boxes),
entry AS (SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1:2], ' ') AS head FROM h WHERE box_no = 1 AND {0}),
upto AS (SELECT doc_id, coalesce(min(box_no) FILTER (WHERE box_no BETWEEN 2 AND 129 AND starts_with(text, head)), 2) AS n FROM h LEFT JOIN entry USING (doc_id) WHERE {0} GROUP BY doc_id),
kept AS (SELECT h.* FROM h LEFT JOIN upto USING (doc_id) WHERE n IS NULL OR box_no >= n)"""


#: What is needed of boxes to find contents and dotted pages.
PLACED = ("doc_id", "page_number", "box_no", "x0", "top", "text")


def headed(spark, sf_dir, every):
    """Boxes of which every ninth holds dotted leaders, and of every ``every``-th document the first is a contents heading."""
    n, text = F.col("box_no"), F.col("text")
    return boxes(spark, sf_dir).withColumn("text", F.when((n == 0) & (F.col("doc_id") % every == 0), "Contents").when(n % 9 == 0, F.concat("text", F.lit("····"))).otherwise(text))


@query(with_(BOXES) + HEADED.format("doc_id % 2 = 0") + ", d AS (SELECT doc_id, page_number FROM kept WHERE doc_id % 2 <> 0 GROUP BY ALL HAVING count(*) FILTER (WHERE contains(text, '··')) > 3) SELECT doc_id, page_number, box_no FROM kept b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = b.doc_id AND d.page_number = b.page_number)")
def dotted_pages(spark, sf_dir):
    """Every other document has contents, which go first; its dotted pages stay."""
    return D.drop_contents(headed(spark, sf_dir, 2).select(*PLACED), dotted=3).select("doc_id", "page_number", "box_no")


@query(with_(BOXES) + """, b AS (SELECT *, page_number || '-table-' || (box_no % 2) AS k, (top + bottom) / 2 + 600 * (page_number - 1) AS mid FROM boxes),
l AS (SELECT *, last_value(CASE WHEN layout_type = 'table' THEN k END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number, top, x0, box_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b),
closed AS (SELECT DISTINCT doc_id, before FROM l WHERE layout_type = 'title' AND doc_id % 2 = 0),
t AS (SELECT doc_id, page_number, 'table-' || (box_no % 2) AS layoutno, k, min(mid) AS first, max(mid) AS last FROM b WHERE layout_type = 'table' GROUP BY ALL),
s AS (SELECT t.*, CASE WHEN page_number = lag(page_number) OVER w + 1 AND first - lag(last) OVER w <= 40 * 12 AND lag(c.before) OVER w IS NULL THEN 0 ELSE 1 END AS start FROM t LEFT JOIN closed c ON c.doc_id = t.doc_id AND c.before = t.k WINDOW w AS (PARTITION BY t.doc_id ORDER BY first))
SELECT doc_id, page_number, layoutno, sum(start) OVER (PARTITION BY doc_id ORDER BY first ROWS UNBOUNDED PRECEDING)::INTEGER AS table_id FROM s""")
def stitch_tables(spark, sf_dir):
    """Titles part the tables of every other document only."""
    b = boxes(spark, sf_dir).withColumn("layoutno", F.concat(F.lit("table-"), (F.col("box_no") % 2).cast("string")))
    b = b.withColumn("layout_type", F.when((F.col("layout_type") == "title") & (F.col("doc_id") % 2 != 0), "text").otherwise(F.col("layout_type")))
    return L.stitch_tables(b, stats(spark, sf_dir), 40.0)


@query(with_(BOXES) + """, y AS (SELECT *, top + 600 * (page_number - 1) AS t, bottom + 600 * (page_number - 1) AS u FROM boxes),
m AS (SELECT c.doc_id, c.page_number, c.box_no AS cap_no, CASE WHEN b.layout_type = 'title' THEN 'figure' ELSE 'table' END AS kind, b.page_number AS box_page, b.box_no, round(CASE WHEN b.x1 < c.x0 OR b.x0 > c.x1 THEN ((b.x0 + b.x1 - c.x0 - c.x1) / 2) ** 2 ELSE 0 END + ((b.t + b.u - c.t - c.u) / 2) ** 2, 4) AS d
 FROM y c JOIN y b ON b.doc_id = c.doc_id AND b.layout_type IN ('title', 'table') AND c.layout_type IN ('header', 'footer'))
SELECT doc_id, page_number, cap_no, kind, box_page, box_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cap_no ORDER BY d, CASE kind WHEN 'figure' THEN 0 ELSE 1 END, box_page, box_no) AS n FROM m) WHERE n = 1""")
def attach_captions(spark, sf_dir):
    b = boxes(spark, sf_dir)
    own = b.where("layout_type in ('title', 'table')").withColumn("layout_type", F.when(F.col("layout_type") == "title", "figure").otherwise("table"))
    return L.attach_captions(b.where("layout_type in ('header', 'footer')"), own, stats(spark, sf_dir))


# The rules of cell types once more, as a twin must state them by itself.
KIND = r"""CASE WHEN regexp_matches(t, '^(19|20)\d\d[年/-]\d\d?[月/-]\d\d?日*$') OR regexp_matches(t, '^(19|20)\d\d(年|[年-]\d\d?月*|年*[一二三四1-4]季度|[A-E])$') OR regexp_matches(t, '^\d\d?[月-]\d\d?日*$') OR regexp_matches(t, '^第*[一二三四1-4]季度$') THEN 'Dt'
  WHEN regexp_matches(t, '^[0-9.,+%/ -]+$') THEN 'Nu' WHEN regexp_matches(t, '^[0-9A-Z/._~-]+$') THEN 'Ca' WHEN regexp_matches(t, '^[A-Z]*[a-z'' -]+$') THEN 'En'
  WHEN regexp_matches(t, '^[0-9.,+-]+[0-9A-Za-z/$￥%<>（）()'' -]+$') THEN 'NE' WHEN length(t) = 1 THEN 'Sg'
  WHEN length(replace(t, ' ', '')) > 0 AND len(regexp_extract_all(t, '[0-9.,+-]')) >= 0.8 * length(replace(t, ' ', '')) THEN 'Nr' WHEN n >= 12 THEN 'Lx' WHEN n > 3 THEN 'Tx' ELSE 'Ot' END"""
CELLTEXTS = r"""texts AS (SELECT l_orderkey AS k, c, trim(text) AS t, len(regexp_extract_all(regexp_replace(text, '([\x{4e00}-\x{9fff}])', ' \1 ', 'g'), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) AS n FROM (SELECT l_orderkey, unnest(range(7)) AS c, unnest([
  l_shipdate::DATE::VARCHAR, l_linenumber::VARCHAR, l_returnflag || ' ' || l_linestatus || l_linenumber, ' ' || year(l_shipdate) || CASE l_linenumber % 4 WHEN 0 THEN '年' WHEN 1 THEN '' WHEN 2 THEN '年' || (l_linenumber % 5) || '季度' ELSE 'ABCDEFG'[l_linenumber] END || ' ',
  l_linenumber || CASE WHEN l_linenumber % 2 = 0 THEN '/' ELSE '-' END || (l_orderkey % 12 + 1), '$' || (l_orderkey % 900 + 100) || '.' || (l_linenumber + 10), CASE WHEN l_linenumber % 2 = 0 THEN 'Part ' || l_partkey || ' of ' || l_suppkey || '!' ELSE 'Part ' || l_partkey || ', supplier ' || l_suppkey || ': ship by ' || l_shipdate::DATE || ', return ' || l_returnflag END]) AS text FROM lineitem))"""


def cell_texts(spark, sf_dir):
    """Seven cells of each line: dates, quarters, codes, amounts and sentences, some with white space around."""
    li, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    number, year, letter = n.cast("string"), F.year("l_shipdate").cast("string"), F.substring(F.lit("ABCDEFG"), n.cast("int"), F.lit(1))
    ending = F.when(n % 4 == 0, "年").when(n % 4 == 1, "").when(n % 4 == 2, F.concat(F.lit("年"), (n % 5).cast("string"), F.lit("季度"))).otherwise(letter)
    order = F.col("l_orderkey")
    texts = (
        F.col("l_shipdate").cast("date").cast("string"), number, F.concat("l_returnflag", F.lit(" "), "l_linestatus", number), F.concat(F.lit(" "), year, ending, F.lit(" ")),
        F.concat(number, F.when(n % 2 == 0, "/").otherwise("-"), (order % 12 + 1).cast("string")), F.concat(F.lit("$"), (order % 900 + 100).cast("string"), F.lit("."), (n + 10).cast("string")),
        F.when(n % 2 == 0, F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(" of "), F.col("l_suppkey").cast("string"), F.lit("!"))).otherwise(F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(", supplier "), F.col("l_suppkey").cast("string"), F.lit(": ship by "), F.col("l_shipdate").cast("date").cast("string"), F.lit(", return "), "l_returnflag")),
    )
    return li.select(order.alias("k"), F.posexplode(F.array(*texts)).alias("c", "text"))


@query(with_(CELLTEXTS) + f" SELECT c, kind, count(*) AS n FROM (SELECT c, {KIND} AS kind FROM texts) GROUP BY ALL")
def cell_types(spark, sf_dir):
    return L.with_cell_type(cell_texts(spark, sf_dir)).groupBy("c", "kind").agg(F.count("*").alias("n"))


@query(with_(CELLTEXTS) + f" SELECT k, kind, n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, kind) AS r FROM (SELECT k, {KIND} AS kind, count(*) AS n FROM texts GROUP BY ALL)) WHERE r = 1")
def table_major_type(spark, sf_dir):
    return L.majority_type(cell_texts(spark, sf_dir), "k")


@query(with_(BOXES) + """, p AS (SELECT doc_id, page_number, 0 AS table_no, box_no AS part_no, CASE WHEN box_no % 2 = 0 THEN 'row' ELSE 'column' END AS label, x0 + box_no % 3 AS x0, x1 + box_no % 5 AS x1, top, bottom FROM boxes),
a AS (SELECT *, count(*) OVER w > 4 AS many, avg(x0) OVER w AS ax0, min(x0) OVER w AS nx0, avg(x1) OVER w AS ax1, max(x1) OVER w AS mx1, median(top) OVER w AS mt, min(top) OVER w AS nt, median(bottom) OVER w AS mb, max(bottom) OVER w AS xb FROM p WINDOW w AS (PARTITION BY doc_id, page_number, label))
SELECT doc_id, page_number, table_no, part_no, label, round(CASE label WHEN 'row' THEN least(x0, CASE WHEN many THEN ax0 ELSE nx0 END) ELSE x0 END, 4) AS x0, round(CASE label WHEN 'row' THEN greatest(x1, CASE WHEN many THEN ax1 ELSE mx1 END) ELSE x1 END, 4) AS x1,
 round(CASE label WHEN 'column' THEN least(top, CASE WHEN many THEN mt ELSE nt END) ELSE top END, 4) AS top, round(CASE label WHEN 'column' THEN greatest(bottom, CASE WHEN many THEN mb ELSE xb END) ELSE bottom END, 4) AS bottom FROM a""")
def align_edges(spark, sf_dir):
    n = F.col("box_no")
    parts = boxes(spark, sf_dir).select("doc_id", "page_number", F.lit(0).alias("table_no"), n.alias("part_no"), F.when(n % 2 == 0, "row").otherwise("column").alias("label"), (F.col("x0") + n % 3).alias("x0"), (F.col("x1") + n % 5).alias("x1"), "top", "bottom")
    out = L.align_edges(parts)
    return out.withColumns({c: F.round(c, 4) for c in ("x0", "x1", "top", "bottom")})


GRID = CELLS + """, grid AS (SELECT table_no, row_no, col_no, text, row_no % 4 = 0 AS is_header FROM cells), caps AS (SELECT DISTINCT table_no, CASE WHEN table_no % 2 = 0 THEN 'order ' || table_no END AS caption FROM cells),
wide2 AS (SELECT table_no, max(col_no) AS last FROM grid GROUP BY table_no),
full2 AS (SELECT r.table_no, r.row_no, r.is_header, list(coalesce(g.text, '') ORDER BY c.col_no) AS cells FROM (SELECT DISTINCT table_no, row_no, is_header FROM grid) r JOIN wide2 USING (table_no) JOIN (SELECT unnest([0, 1, 2]) AS col_no) c ON c.col_no <= last LEFT JOIN grid g ON g.table_no = r.table_no AND g.row_no = r.row_no AND g.col_no = c.col_no GROUP BY ALL)"""


def grid(spark, sf_dir):
    own = cells(spark, sf_dir).select("table_no", "row_no", "col_no", "text", (F.col("row_no") % 4 == 0).alias("is_header"))
    # Every order has cells.
    caps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_no")).distinct().withColumn("caption", F.when(F.col("table_no") % 2 == 0, F.concat(F.lit("order "), F.col("table_no").cast("string"))))
    return own, caps


@query(with_(GRID) + """, l AS (SELECT table_no, row_no, '<tr>' || array_to_string(list_transform(cells, lambda x: CASE WHEN is_header THEN '<th>' || x || '</th>' ELSE '<td>' || x || '</td>' END), '') || '</tr>' AS line FROM (SELECT *, row_number() OVER (PARTITION BY table_no, is_header, cells ORDER BY row_no) AS k FROM full2) WHERE NOT is_header OR k = 1)
SELECT l.table_no, '<table>' || coalesce('<caption>' || nullif(max(caption), '') || '</caption>', '') || chr(10) || string_agg(line, chr(10) ORDER BY row_no) || chr(10) || '</table>' AS html FROM l LEFT JOIN caps USING (table_no) GROUP BY l.table_no""")
def grid_html(spark, sf_dir):
    return L.grid_html(*grid(spark, sf_dir))


@query(with_(GRID) + """, h AS (SELECT *, last_value(CASE WHEN is_header THEN cells END IGNORE NULLS) OVER (PARTITION BY table_no ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head FROM full2)
SELECT h.table_no, row_no, array_to_string(list_filter(list_transform(cells, lambda v, i: CASE WHEN v <> '' THEN CASE WHEN coalesce(head[i], '') <> '' THEN head[i] || '：' || v ELSE v END END), lambda x: x IS NOT NULL), '; ') || CASE WHEN coalesce(caption, '') <> '' THEN chr(9) || '——' || caption ELSE '' END AS sentence FROM h LEFT JOIN caps USING (table_no) WHERE NOT is_header""")
def grid_sentences(spark, sf_dir):
    return L.grid_sentences(*grid(spark, sf_dir))


@query(with_(BOXES) + " SELECT doc_id, page_number, type, text, (row_number() OVER (PARTITION BY doc_id ORDER BY page_number, top, x0, type) - 1)::INTEGER AS block_no FROM (SELECT doc_id, page_number, top, x0, CASE layout_type WHEN 'table' THEN 'table' WHEN 'title' THEN 'title' ELSE 'paragraph' END AS type, text FROM boxes)")
def assemble_blocks(spark, sf_dir):
    b = boxes(spark, sf_dir)
    kind = F.when(F.col("layout_type") == "title", "title").otherwise("paragraph")
    cols = ("doc_id", "page_number", "top", "x0", "type", "text")
    out = L.assemble_blocks(b.where("layout_type <> 'table'").withColumn("type", kind).select(*cols), b.where("layout_type = 'table'").withColumn("type", F.lit("table")).select(*cols))
    return out.drop("top", "x0")


@query(with_(BOXES, REGIONS).replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY top, x0, region_no) AS n FROM regions),
f AS (SELECT doc_id, page_number, n, n AS cur, x0, x1, top, bottom, score, NULL::BIGINT AS gone FROM o WHERE n = 1
 UNION ALL SELECT doc_id, page_number, n, CASE WHEN stays THEN cur ELSE n END, CASE WHEN stays THEN f_x0 ELSE x0 END, CASE WHEN stays THEN f_x1 ELSE x1 END, CASE WHEN stays THEN f_top ELSE top END, CASE WHEN stays THEN f_bottom ELSE bottom END, CASE WHEN stays THEN f_score ELSE score END, CASE WHEN stays THEN n WHEN meets THEN cur END
 FROM (SELECT *, meets AND f_score > score AS stays FROM (SELECT o.*, f.cur, f.x0 AS f_x0, f.x1 AS f_x1, f.top AS f_top, f.bottom AS f_bottom, f.score AS f_score,
   greatest(least(f.x1, o.x1) - greatest(f.x0, o.x0), 0) * greatest(least(f.bottom, o.bottom) - greatest(f.top, o.top), 0) AS shared,
   shared > 0 AND shared >= 0.7 * least((f.x1 - f.x0) * (f.bottom - f.top), (o.x1 - o.x0) * (o.bottom - o.top)) AS meets
   FROM f JOIN o ON o.doc_id = f.doc_id AND o.page_number = f.page_number AND o.n = f.n + 1)))
SELECT o.doc_id, o.page_number, o.region_no FROM o WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = o.doc_id AND f.page_number = o.page_number AND f.gone = o.n)""")
def clean_regions(spark, sf_dir):
    """Regions taken as of one type, so that those that cover each other meet."""
    return D.clean_regions(regions(spark, sf_dir).withColumn("type", F.lit("all")), boxes(spark, sf_dir)).select("doc_id", "page_number", "region_no")


@query(with_(BOXES, REGIONS).replace("WITH ", "WITH RECURSIVE ", 1) + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY score DESC, region_no) AS n FROM regions),
f AS (SELECT doc_id, page_number, 1::BIGINT AS n, [{'x0': x0, 'x1': x1, 'top': top, 'bottom': bottom}] AS kept, true AS ok FROM ranked WHERE n = 1
 UNION ALL SELECT doc_id, page_number, n, CASE WHEN ok THEN list_append(kept, {'x0': x0, 'x1': x1, 'top': top, 'bottom': bottom}) ELSE kept END, ok
 FROM (SELECT f.kept, r.*, len(list_filter(f.kept, lambda k: greatest(least(k.x1, r.x1) - greatest(k.x0, r.x0), 0) * greatest(least(k.bottom, r.bottom) - greatest(k.top, r.top), 0)
   > 0.2 * ((k.x1 - k.x0) * (k.bottom - k.top) + (r.x1 - r.x0) * (r.bottom - r.top) - greatest(least(k.x1, r.x1) - greatest(k.x0, r.x0), 0) * greatest(least(k.bottom, r.bottom) - greatest(k.top, r.top), 0)))) = 0 AS ok
  FROM f JOIN ranked r ON r.doc_id = f.doc_id AND r.page_number = f.page_number AND r.n = f.n + 1))
SELECT r.doc_id, r.page_number, r.region_no, r.score FROM ranked r JOIN f ON f.doc_id = r.doc_id AND f.page_number = r.page_number AND f.n = r.n WHERE f.ok""")
def suppress_boxes(spark, sf_dir):
    return D.suppress(regions(spark, sf_dir).withColumn("type", F.lit("all")), 0.2).select("doc_id", "page_number", "region_no", "score")


def columns(spark, sf_dir, blanks=True):
    """Boxes on pages of two columns: each line is cut in two boxes side by side in its column, and with ``blanks`` every
    twentieth line's second one is blank."""
    b, half = boxes(spark, sf_dir).drop("x0", "x1"), F.floor(F.length("text") / 2).cast("int")
    rest = F.substring("text", half + 1, F.length("text"))
    two = F.array(F.substring("text", F.lit(1), half), F.when(F.col("box_no") % 20 == 19, " ").otherwise(rest) if blanks else rest)
    rows = b.select("doc_id", "page_number", "box_no", "top", "bottom", "layout_type", "layoutno", F.posexplode(two).alias("k", "text"))
    x0 = 50.0 + 300 * (F.col("box_no") % 2) + 60 * F.col("k")
    return rows.select("doc_id", "page_number", (2 * F.col("box_no") + F.col("k")).alias("box_no"), x0.alias("x0"), (x0 + 100).alias("x1"), "top", "bottom", "text", "layout_type", F.when(F.col("layoutno") == "text-0", "text-0").otherwise(F.col("layoutno")).alias("layoutno"))


def column_heights(spark, sf_dir):
    return boxes(spark, sf_dir).select("doc_id", "page_number").distinct().withColumn("mean_height", F.lit(12.0))


COLUMNS = """cols AS (SELECT doc_id, page_number, 2 * box_no + k AS box_no, box_no % 2 AS col_id, 50 + 300 * (box_no % 2) + 60 * k::DOUBLE AS x0, 150 + 300 * (box_no % 2) + 60 * k::DOUBLE AS x1, top, bottom, layout_type, layout_type || '-0' AS layoutno,
  CASE k WHEN 0 THEN substr(text, 1, length(text) // 2) WHEN 1 THEN CASE WHEN box_no % 20 = 19 THEN ' ' ELSE substr(text, length(text) // 2 + 1) END END AS text FROM boxes, (SELECT unnest([0, 1]) AS k))"""
# The same without blanks, so that no text is left out.
WHOLE = COLUMNS.replace("CASE WHEN box_no % 20 = 19 THEN ' ' ELSE substr(text, length(text) // 2 + 1) END", "substr(text, length(text) // 2 + 1)")


@query(with_(BOXES, COLUMNS) + """ SELECT doc_id, page_number, min(box_no) AS box_no, min(x0) AS x0, CASE WHEN layout_type = 'table' THEN max(x1) ELSE max_by(x1, box_no) END AS x1, min(top) AS top, max(bottom) AS bottom, string_agg(text, '' ORDER BY box_no) AS text, layout_type, layoutno, col_id::INTEGER AS col_id
 FROM (SELECT *, CASE WHEN layout_type = 'table' THEN box_no ELSE box_no // 2 END AS line FROM cols) GROUP BY doc_id, page_number, col_id, layout_type, layoutno, line""")
def merge_lines(spark, sf_dir):
    c = columns(spark, sf_dir)
    return D.merge_lines(c.withColumn("col_id", (F.floor(F.col("box_no") / 2) % 2).cast("int")), column_heights(spark, sf_dir))


@query(with_(BOXES) + """, p AS (SELECT *, count(*) OVER w > 2 AND min(x0) OVER w < max(x0) OVER w AND 250 >= 0.12 * (max(x1) OVER w - min(x0) OVER w) AS two FROM boxes WINDOW w AS (PARTITION BY doc_id, page_number))
SELECT doc_id, page_number, box_no, (two AND x0 = 300)::INTEGER AS col_id FROM p""")
def assign_columns(spark, sf_dir):
    """Left edges are 50 or 300, and one column where 12 % of the page's width is more than they are apart."""
    return D.assign_columns(boxes(spark, sf_dir)).select("doc_id", "page_number", "box_no", "col_id")


@query("WITH RECURSIVE " + ",\n".join((BOXES, WHOLE)) + r""", s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, col_id ORDER BY top, x0, box_no) AS n FROM cols WHERE trim(text) <> ''),
m AS (SELECT doc_id, page_number, col_id, n, box_no, x0, x1, top, bottom, trim(text) AS text, layout_type, layoutno, 1 AS grp FROM s WHERE n = 1
 UNION ALL SELECT doc_id, page_number, col_id, n, CASE WHEN j THEN box_no ELSE b_no END, CASE WHEN j THEN least(x0, b_x0) ELSE b_x0 END, CASE WHEN j THEN greatest(x1, b_x1) ELSE b_x1 END, CASE WHEN j THEN top ELSE b_top END, b_bottom, CASE WHEN j THEN text || ' ' || b_text ELSE b_text END, b_type, b_layout, CASE WHEN j THEN grp ELSE grp + 1 END
 FROM (SELECT m.* EXCLUDE n, s.n, s.box_no AS b_no, s.x0 AS b_x0, s.x1 AS b_x1, s.top AS b_top, s.bottom AS b_bottom, trim(s.text) AS b_text, s.layout_type AS b_type, s.layoutno AS b_layout,
   m.layoutno = s.layoutno AND s.top - m.bottom <= 18 AND greatest(0, least(m.x1, s.x1) - greatest(m.x0, s.x0)) / greatest(1, least(m.x1 - m.x0, s.x1 - s.x0)) >= 0.3
   AND (NOT regexp_matches(m.text, '[。？！?]$') OR regexp_matches(m.text, '[,;:''"，、‘“；：-]$') OR regexp_matches(m.text, '[,;:''"，‘“、；：].$') OR regexp_matches(s.text, '^\s*[。；？！?”）),，、：]')) AS j
   FROM m JOIN s ON s.doc_id = m.doc_id AND s.page_number = m.page_number AND s.col_id = m.col_id AND s.n = m.n + 1))
SELECT doc_id, page_number, col_id::INTEGER AS col_id, box_no, x0, x1, top, bottom, text, layout_type, layoutno FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, col_id, grp ORDER BY n DESC) AS last FROM m) WHERE last = 1""")
def merge_paragraphs(spark, sf_dir):
    c = columns(spark, sf_dir, blanks=False)
    return D.merge_paragraphs(c.withColumn("col_id", (F.floor(F.col("box_no") / 2) % 2).cast("int")), column_heights(spark, sf_dir))


@query(with_(BOXES) + HEADED.format("true") + " SELECT doc_id, page_number, box_no, text FROM kept")
def drop_contents(spark, sf_dir):
    return D.drop_contents(headed(spark, sf_dir, 1).select(*PLACED)).select("doc_id", "page_number", "box_no", "text")


@query(with_(BOXES) + r""", t AS (SELECT * REPLACE (CASE WHEN box_no % 3 <> 0 THEN '• ' || text ELSE text END AS text) FROM boxes),
l AS (SELECT *, left(trim(text), 1) AS c, lag(left(trim(text), 1)) OVER w AS before FROM t WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY box_no)),
g AS (SELECT *, count(*) FILTER (WHERE before IS NULL OR c <> before OR regexp_matches(c, '[A-Za-z\x{4e00}-\x{9fff}]')) OVER (PARTITION BY doc_id, page_number ORDER BY box_no) AS part FROM l)
SELECT doc_id, page_number, min(box_no) AS box_no, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom, string_agg(text, chr(10) ORDER BY box_no) AS text FROM g GROUP BY doc_id, page_number, part""")
def merge_bullets(spark, sf_dir):
    return D.merge_bullets(boxes(spark, sf_dir).withColumn("text", F.when(F.col("box_no") % 3 != 0, F.concat(F.lit("• "), "text")).otherwise(F.col("text")))).drop("layout_type", "layoutno")


@query()
def table_grid(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return D.table_grid(b.select("doc_id", F.col("page_number").alias("table_no"), "box_no", "x0", "x1", "top", "bottom", (F.col("layout_type") == "header").alias("is_header"), "text"))


@query()
def layout_chunks(spark, sf_dir):
    """Boxes on pages of two columns to chunks, with one shuffle."""
    return C.build_chunks(D.document_blocks(columns(spark, sf_dir)), least=60, most=200)
