"""Sources, blocks and chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions import vectors as V
from quillspan.operators import blocks as B
from quillspan.operators import chunks as C
from quillspan.queries.core import BLOCKS, EPOCH, query, sql_marked, sql_plain, sql_words, table, with_
from quillspan.sources import stores

EXTS = ["txt", "md", "docx", "xlsx", "pdf", "zip"]


def chunks_sql(least: int, most: int, select: str) -> str:
    return "WITH RECURSIVE " + BLOCKS + f""", b AS (SELECT *, {sql_words('text')} AS n FROM blocks),
m AS (SELECT doc_id, count(*) AS k, CASE WHEN count(*) < 30 THEN least({least}, sum(length(text))) ELSE {least} END AS mn FROM blocks GROUP BY doc_id),
s AS (
 SELECT doc_id, 0 AS i, []::VARCHAR[] AS path, []::VARCHAR[] AS content, 0::BIGINT AS body, 0::BIGINT AS cur, NULL::VARCHAR[] AS out_path, NULL::VARCHAR AS out_text, 0::BIGINT AS out_n, 0 AS chunks FROM m
 UNION ALL
 SELECT doc_id, i + 1, CASE WHEN type = 'title' THEN list_concat(path[1:level - 1], [text]) ELSE path END,
  CASE WHEN fa THEN []::VARCHAR[] WHEN ends THEN CASE WHEN fb THEN []::VARCHAR[] ELSE content END WHEN fb THEN [text] ELSE list_append(content, text) END,
  CASE WHEN fa THEN 0 WHEN ends THEN CASE WHEN fb THEN 0 ELSE body END WHEN fb THEN n ELSE body + n END,
  CASE WHEN fa THEN 0 WHEN ends THEN CASE WHEN fb THEN 0 ELSE cur END WHEN fb THEN n + 2 ELSE cur + n + 2 END,
  CASE WHEN fb OR fa THEN path END, CASE WHEN fb THEN array_to_string(content, chr(10)) WHEN fa THEN array_to_string(list_append(content, text), chr(10)) END,
  CASE WHEN fb THEN body + 2 WHEN fa THEN body + n + 2 END, chunks + (fb OR fa)::INTEGER
 FROM (SELECT s.*, b.type, b.level, b.text, b.n, coalesce(b.type, 'title') = 'title' AS ends,
   (coalesce(b.type, 'title') = 'title' OR (b.n + 2 < {most} AND s.cur + b.n + 2 > {most})) AND len(s.content) > 0 AND s.body + 2 >= m.mn AS fb,
   coalesce(b.type <> 'title' AND b.n + 2 >= {most} AND s.body + b.n + 2 >= m.mn, false) AS fa
   FROM s JOIN m ON m.doc_id = s.doc_id AND s.i <= m.k LEFT JOIN b ON b.doc_id = s.doc_id AND b.block_no = s.i))
{select}"""


@query(r"""SELECT doc_id, file_name, CASE ext WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' WHEN 'docx' THEN 'word' WHEN 'xlsx' THEN 'excel' WHEN 'pdf' THEN 'pdf' END AS parser, ext <> 'zip' AS ok
FROM (SELECT doc_id, ext, 'doc_' || doc_id || '.' || ext AS file_name FROM (SELECT doc_id, ['txt', 'md', 'docx', 'xlsx', 'pdf', 'zip'][doc_id % 6 + 1] AS ext FROM documents))""")
def route_files(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, EXTS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return B.route_files(table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("file_name")))


@query("SELECT page_id, url, length(html)::BIGINT AS n_chars FROM pages")
def pages_scan(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


@query(r"""SELECT doc_id, 0 AS block_no, 'paragraph' AS type, CASE WHEN doc_id % 3 = 0 THEN '中文' || regexp_replace(text, '[^\x00-\x7F]', '', 'g') ELSE text END AS text FROM documents""")
def text_blocks(spark, sf_dir):
    """Every third file is in GBK: two characters of it before what of the text is ASCII."""
    gbk = F.concat(F.unhex(F.lit("D6D0CEC4")), F.encode(F.regexp_replace("text", r"[^\x00-\x7F]", ""), "UTF-8"))
    content = F.when(F.col("doc_id") % 3 == 0, gbk).otherwise(F.encode("text", "UTF-8"))
    return stores.text_blocks(table(spark, sf_dir, "documents").select("doc_id", content.alias("content")))


@query(chunks_sql(500, 2000, "SELECT source AS table_id, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, sum(out_n)::BIGINT AS n_tokens FROM s JOIN documents USING (doc_id) WHERE out_text IS NOT NULL GROUP BY source"))
def chunk_store(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = stores.fresh(spark, "chunks")
    lists = B.line_block_lists(docs, "source")
    chunks = C.build_chunks(lists, keep=("source",)).withColumnRenamed("source", "table_id")
    stores.write_chunks(chunks.withColumn("create_time", F.timestamp_seconds(F.lit(EPOCH))), path)
    return spark.read.parquet(path).groupBy("table_id").agg(F.count("*").alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


@query("SELECT len(embedding)::INTEGER AS dim, count(*) AS n FROM embeddings GROUP BY ALL")
def vectors_by_dim(spark, sf_dir):
    path = stores.fresh(spark, "vectors")
    stores.write_vectors(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")), path)
    return spark.read.parquet(path).groupBy(F.col("dim").cast("int").alias("dim")).agg(F.count("*").alias("n"))


@query(with_(BLOCKS) + r""", p AS (SELECT doc_id, block_no, trim(text) AS text, CASE WHEN block_no % 5 = 0 THEN 'Heading ' || (block_no % 3 + 1) WHEN block_no % 11 = 0 THEN 'Heading' ELSE 'Normal' END AS style FROM blocks)
SELECT doc_id, block_no, CASE WHEN style LIKE 'Heading%' THEN 'title' ELSE 'paragraph' END AS type, CASE WHEN style LIKE 'Heading%' THEN coalesce(try_cast(regexp_extract(style, '^Heading\s*(\d+)', 1) AS INTEGER), 1) END AS level, text FROM p WHERE text <> ''""")
def paragraph_blocks(spark, sf_dir):
    n = F.col("block_no")
    style = F.when(n % 5 == 0, F.concat(F.lit("Heading "), (n % 3 + 1).cast("string"))).when(n % 11 == 0, "Heading").otherwise("Normal")
    return B.blocks_from_paragraphs(B.line_blocks(table(spark, sf_dir, "documents")).select("doc_id", n.alias("para_no"), style.alias("style"), "text"))


CELLS = """cells AS (SELECT l_orderkey AS table_no, row_no, col_no, CASE col_no WHEN 0 THEN l_returnflag WHEN 1 THEN l_linestatus || chr(10) || l_partkey || ' ' ELSE l_suppkey || '|x' END AS text FROM
  (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) - 1 AS row_no FROM lineitem) t, (SELECT unnest([0, 1, 2]) AS col_no) c WHERE NOT (l_partkey % 5 = 0 AND col_no = 2)),
clean AS (SELECT table_no, row_no, list(replace(replace(trim(text), chr(10), ' '), '|', '\\|') ORDER BY col_no) AS c FROM cells GROUP BY ALL),
wide AS (SELECT table_no, max(len(c)) AS n FROM clean GROUP BY table_no),
bars AS (SELECT table_no, row_no, n, '| ' || array_to_string(list_resize(c, n, ''), ' | ') || ' |' AS bar FROM clean JOIN wide USING (table_no)),
md AS (SELECT table_no, string_agg(CASE WHEN row_no = 0 THEN bar || chr(10) || '| ' || array_to_string(list_resize([]::VARCHAR[], n, '---'), ' | ') || ' |' ELSE bar END, chr(10) ORDER BY row_no) AS markdown FROM bars GROUP BY table_no)"""


def cells(spark, sf_dir):
    """A table for each order, a row for each of its lines; some rows lack the last cell."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    rows = table(spark, sf_dir, "lineitem").withColumn("row_no", F.row_number().over(w) - 1)
    three = F.array("l_returnflag", F.concat("l_linestatus", F.lit("\n"), F.col("l_partkey").cast("string"), F.lit(" ")), F.concat(F.col("l_suppkey").cast("string"), F.lit("|x")))
    return rows.select(F.col("l_orderkey").alias("table_no"), "l_partkey", "row_no", F.posexplode(three).alias("col_no", "text")).where(~((F.col("l_partkey") % 5 == 0) & (F.col("col_no") == 2)))


@query(with_(CELLS) + " SELECT table_no, markdown FROM md")
def table_markdown(spark, sf_dir):
    return B.cells_to_markdown(cells(spark, sf_dir), "table_no")


@query(with_(CELLS) + """ SELECT table_no // 10 AS doc_id, (2 * (table_no % 10) + k)::INTEGER AS block_no, CASE k WHEN 0 THEN 'title' ELSE 'table' END AS type, CASE k WHEN 0 THEN 1 END AS level, CASE k WHEN 0 THEN 'sheet ' || table_no ELSE markdown END AS text
FROM md, (SELECT unnest([0, 1]) AS k)""")
def sheet_blocks(spark, sf_dir):
    n = F.col("table_no")
    return B.sheets_to_blocks(cells(spark, sf_dir).select(F.floor(n / 10).alias("doc_id"), (n % 10).alias("sheet_no"), F.concat(F.lit("sheet "), n.cast("string")).alias("sheet"), "row_no", "col_no", "text"))


@query(rf"""WITH h AS (SELECT page_id, {sql_marked("html")} AS h FROM pages),
x AS (SELECT page_id, regexp_extract_all(h, '(?i)<(h[1-6]|p)\b[^>]*>([^\x01]*)', 1) AS tags, regexp_extract_all(h, '(?i)<(h[1-6]|p)\b[^>]*>([^\x01]*)', 2) AS parts FROM h),
e AS (SELECT page_id, lower(unnest(tags)) AS tag, unnest(parts) AS part, generate_subscripts(tags, 1) - 1 AS block_no FROM x)
SELECT * FROM (SELECT page_id, block_no::INTEGER AS block_no, CASE tag WHEN 'p' THEN 'paragraph' ELSE 'title' END AS type, CASE WHEN tag <> 'p' THEN substr(tag, 2, 1)::INTEGER END AS level, {sql_plain("part")} AS text FROM e) WHERE text <> ''""")
def html_blocks(spark, sf_dir):
    return B.html_blocks(table(spark, sf_dir, "pages"))


@query(rf"SELECT doc_id, ({sql_words('text')} + 2)::INTEGER AS n_tokens FROM documents")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


@query(with_(BLOCKS) + " SELECT doc_id, count(*) AS n_blocks, sum(length(text))::BIGINT AS n_chars, CASE WHEN count(*) < 30 THEN least(500, sum(length(text)))::BIGINT ELSE 500 END AS min_tokens FROM blocks GROUP BY doc_id")
def effective_min(spark, sf_dir):
    return C.effective_min(B.line_blocks(table(spark, sf_dir, "documents")))


@query("WITH RECURSIVE " + BLOCKS + """, f AS (
 SELECT doc_id, block_no, type, level, text, CASE type WHEN 'title' THEN [text] ELSE []::VARCHAR[] END AS path FROM blocks WHERE block_no = 0
 UNION ALL SELECT b.doc_id, b.block_no, b.type, b.level, b.text, CASE b.type WHEN 'title' THEN list_concat(f.path[1:b.level - 1], [b.text]) ELSE f.path END FROM f JOIN blocks b ON b.doc_id = f.doc_id AND b.block_no = f.block_no + 1)
SELECT doc_id, block_no, path AS title_path, text FROM f WHERE type <> 'title'""")
def title_paths(spark, sf_dir):
    return C.title_paths(B.line_block_lists(table(spark, sf_dir, "documents")))


@query(chunks_sql(60, 200, """SELECT doc_id, (chunks - 1)::INTEGER AS chunk_no, out_path AS title_path, out_text AS content, out_n::INTEGER AS n_tokens FROM s WHERE out_text IS NOT NULL"""))
def build_chunks(spark, sf_dir):
    return C.build_chunks(B.line_block_lists(table(spark, sf_dir, "documents")), least=60, most=200)


@query(r"""SELECT doc_id, len(string_split_regex(regexp_replace(text, '([。.?!])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), '\x01|\n\n|\n'))::INTEGER AS n_sentences, md5(array_to_string(string_split_regex(regexp_replace(text, '([。.?!])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), '\x01|\n\n|\n'), chr(2))) AS digest FROM documents""")
def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "\u0002")).alias("digest"))


@query(chunks_sql(60, 200, rf""", c AS (SELECT doc_id, chunks - 1 AS chunk_no, out_path AS title_path, out_text AS content, out_n AS n_tokens FROM s WHERE out_text IS NOT NULL),
parts AS (SELECT doc_id, chunk_no, title_path, n_tokens, list_filter(string_split_regex(regexp_replace(content, '([。.?!])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), '\x01|\n\n|\n'), lambda x: trim(x) <> '') AS l FROM c WHERE n_tokens > 200),
sent AS (SELECT doc_id, chunk_no, title_path, n_tokens, len(l) AS m, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS i FROM parts),
w AS (SELECT doc_id, chunk_no, i, (('0x' || substr(md5(w), 1, 8))::BIGINT % 256) AS bucket, count(*)::DOUBLE AS n FROM (SELECT doc_id, chunk_no, i, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+')) AS w FROM sent) GROUP BY ALL),
size AS (SELECT doc_id, chunk_no, i, sqrt(sum(n * n)) AS z FROM w GROUP BY ALL),
dots AS (SELECT b.doc_id, b.chunk_no, b.i, sum(a.n * b.n) AS x FROM w b JOIN w a ON a.doc_id = b.doc_id AND a.chunk_no = b.chunk_no AND a.i = b.i - 1 AND a.bucket = b.bucket GROUP BY ALL),
far AS (SELECT s.doc_id, s.chunk_no, title_path, n_tokens, m, t, s.i, CASE WHEN s.i > 0 THEN round(1 - coalesce(x / (z.z * y.z), 0), 9) END AS far FROM sent s LEFT JOIN dots USING (doc_id, chunk_no, i) LEFT JOIN size z USING (doc_id, chunk_no, i) LEFT JOIN size y ON y.doc_id = s.doc_id AND y.chunk_no = s.chunk_no AND y.i = s.i - 1),
cuts AS (SELECT *, far IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, chunk_no ORDER BY far DESC NULLS LAST, i) <= least(m - 1, n_tokens // 200) AS new FROM far),
pieces AS (SELECT doc_id, chunk_no, title_path, piece, string_agg(t, chr(10) ORDER BY i) AS t, {sql_words("string_agg(t, chr(10) ORDER BY i)")} AS n FROM (SELECT *, count(*) FILTER (WHERE new) OVER (PARTITION BY doc_id, chunk_no ORDER BY i) AS piece FROM cuts) GROUP BY ALL),
held AS (SELECT doc_id, chunk_no, 0::BIGINT AS piece, 0 AS g, n FROM pieces WHERE piece = 0
 UNION ALL SELECT p.doc_id, p.chunk_no, p.piece, CASE WHEN h.n + 2 >= 60 THEN g + 1 ELSE g END, CASE WHEN h.n + 2 >= 60 THEN p.n ELSE h.n + p.n END FROM held h JOIN pieces p ON p.doc_id = h.doc_id AND p.chunk_no = h.chunk_no AND p.piece = h.piece + 1),
last AS (SELECT doc_id, chunk_no, max(g) AS g, max_by(n, piece) + 2 < 60 AS short FROM held GROUP BY ALL),
done AS (SELECT p.doc_id, p.chunk_no, any_value(title_path) AS title_path, k, string_agg(t, chr(10) ORDER BY p.piece) AS content FROM (SELECT h.*, CASE WHEN h.g = l.g AND short AND h.g > 0 THEN h.g - 1 ELSE h.g END AS k FROM held h JOIN last l USING (doc_id, chunk_no)) h JOIN pieces p USING (doc_id, chunk_no, piece) GROUP BY ALL),
all_ AS (SELECT doc_id, chunk_no, 0 AS k, title_path, content, n_tokens FROM c WHERE n_tokens <= 200 UNION ALL SELECT doc_id, chunk_no, k, title_path, content, {sql_words("content")} + 2 FROM done)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no, k) - 1)::INTEGER AS chunk_no, title_path, content, n_tokens::INTEGER AS n_tokens FROM all_"""))
def split_oversize(spark, sf_dir):
    # Written once: oversize chunks are looked at apart from the others.
    path, chunks = stores.fresh(spark, "chunks"), C.build_chunks(B.line_block_lists(table(spark, sf_dir, "documents")), least=60, most=200)
    chunks.write.parquet(path)
    return C.split_chunks(spark.read.schema(chunks.schema).parquet(path), least=60, most=200)


@query("""WITH r AS (SELECT source AS table_id, text, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id || ':0'), doc_id) AS n FROM documents)
SELECT table_id, string_agg(text, chr(10) || chr(10) ORDER BY n) AS sample FROM r WHERE n <= 3 GROUP BY table_id""")
def sample_chunks(spark, sf_dir):
    return C.sample_chunks(table(spark, sf_dir, "documents").select(F.col("source").alias("table_id"), "doc_id", F.lit(0).alias("chunk_no"), F.col("text").alias("content")))


WEIGHTS = r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents),
b AS (SELECT doc_id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 256)::INTEGER AS bucket, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM b"""


@query(WEIGHTS)
def embed_chunks(spark, sf_dir):
    return V.word_weights(table(spark, sf_dir, "documents"), "text", "doc_id").withColumn("weight", F.round("weight", 6))


@query(WEIGHTS)
def embed_by_hook(spark, sf_dir):
    """The same weights by a model that each worker loads once and that takes 256 texts at a time."""
    hook = V.Hook("hash-256", lambda: V.hash_embed)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(V.embed(F.col("text"), hook)).alias("bucket", "weight"))
    return rows.where("weight <> 0").withColumn("weight", F.round("weight", 6))


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, ((length(text) - 1) // 80 + 1)::BIGINT)) AS frame_no FROM documents WHERE length(text) > 0)
SELECT doc_id, frame_no::INTEGER AS frame_no, substr(text, (frame_no * 80 + 1)::BIGINT, 80) AS frame FROM s""")
def text_frames(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", F.posexplode(T.frames(F.col("text"))).alias("frame_no", "frame"))


