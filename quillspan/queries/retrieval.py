"""Vectors, search, routing, grading, and the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import vectors as V
from quillspan.operators import registry as G
from quillspan.operators import retrieval as R
from quillspan.queries.core import HITS, REGISTRY, RUNS, VECTORS, hits, query, registry, runs, table, vectors, with_
from quillspan.queries.ingest import chunks_sql

COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"


@query(with_(VECTORS) + """, n AS (SELECT id, unnest(vector) / (sqrt(list_dot_product(vector, vector)) + 1e-8) AS x, generate_subscripts(vector, 1) - 1 AS place FROM vectors)
SELECT id, place::INTEGER AS place, round(x, 6) AS value FROM n""")
def normalize_vectors(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("id", V.l2_normalize(F.col("vector")).alias("v"))
    return rows.select("id", F.posexplode("v").alias("place", "value")).withColumn("value", F.round("value", 6))


def first_vector(spark, sf_dir):
    """The query: the vector with the smallest id."""
    return list(vectors(spark, sf_dir).orderBy("id").limit(1).first().vector)


Q0 = "q AS (SELECT vector AS q FROM vectors ORDER BY id LIMIT 1)"


@query(with_(VECTORS, Q0) + f" SELECT id, table_id, round(s, 6) AS score FROM (SELECT id, table_id, round({COS.format('vector', 'q')}, 12) AS s FROM vectors, q ORDER BY s DESC, id LIMIT 10)")
def cosine_top_k(spark, sf_dir):
    return R.top_k(vectors(spark, sf_dir), first_vector(spark, sf_dir), 10)


@query(with_(VECTORS, Q0) + " SELECT id, table_id, round(s, 6) AS score FROM (SELECT id, table_id, round(list_sum(list_transform(list_zip(vector, q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 12) AS s FROM vectors, q ORDER BY s, id LIMIT 5)")
def l2_top_k(spark, sf_dir):
    return R.top_k(vectors(spark, sf_dir), first_vector(spark, sf_dir), 5, "l2")


KNN = f"""s AS (SELECT a.id AS query_id, a.table_id AS own, b.id, b.table_id, round({COS.format('a.vector', 'b.vector')}, 12) AS score FROM vectors a JOIN vectors b ON a.id % 20 = 0)"""


@query(with_(VECTORS, KNN) + " SELECT query_id, id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5")
def knn_join(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return R.knn_join(v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), v, 5)


@query()
def knn_approximate(spark, sf_dir):
    """How many rows the approximate search finds for each query, and the share of the exact one's among them."""
    v = vectors(spark, sf_dir)
    asked = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    near, exact = R.knn_approximate(asked, v, 5), R.knn_join(asked, v, 5)
    both = exact.select("query_id", "id", F.lit(1).alias("true")).join(near.select("query_id", "id", F.lit(1).alias("found")), ["query_id", "id"], "full_outer")
    return both.groupBy("query_id").agg(F.count("found").alias("n"), F.round(F.count_if(F.col("true").isNotNull() & F.col("found").isNotNull()) / F.count("true"), 6).alias("recall"))


COLLECTIONS = "coll AS (SELECT table_id, arg_min(vector, id) AS vector FROM vectors GROUP BY table_id)"
ROUTED = f"""sims AS (SELECT v.id AS query_id, c.table_id, round({COS.format('v.vector', 'c.vector')}, 12) AS sim FROM vectors v, coll c WHERE v.id % 20 = 0),
best AS (SELECT query_id, table_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, table_id) AS n FROM sims WHERE round(sim, 6) >= 0.1) WHERE n = 1),
routed AS (SELECT v.id AS query_id, b.table_id, b.sim FROM vectors v LEFT JOIN best b ON b.query_id = v.id WHERE v.id % 20 = 0)"""


def routed(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return R.route_query(v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), v.groupBy("table_id").agg(F.min_by("vector", "id").alias("vector")), 0.1)


@query(with_(VECTORS, COLLECTIONS, ROUTED) + " SELECT * FROM routed")
def route_query(spark, sf_dir):
    return routed(spark, sf_dir)


@query(with_(VECTORS, COLLECTIONS, ROUTED) + f""", s AS (SELECT r.query_id, v.id, round({COS.format('q.vector', 'v.vector')}, 12) AS score FROM routed r JOIN vectors q ON q.id = r.query_id JOIN vectors v ON v.table_id = r.table_id)
SELECT query_id, id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def search_collections(spark, sf_dir):
    v = vectors(spark, sf_dir)
    asked = routed(spark, sf_dir).where("table_id is not null").join(v.select(F.col("id").alias("query_id"), "vector"), "query_id")
    return R.knn_join(asked.select("query_id", "vector", "table_id"), v, 5, by="table_id")


WEIGHED = r"(SELECT {0}, (('0x' || substr(md5(w), 1, 8))::BIGINT % 256) AS bucket, count(*)::DOUBLE AS n FROM (SELECT {0}, unnest(regexp_extract_all(lower({1}), '[\p{{L}}\p{{N}}]+')) AS w FROM {2}) GROUP BY ALL)"


@query(chunks_sql(60, 200, f""", c AS (SELECT doc_id, (chunks - 1)::INTEGER AS chunk_no, out_text AS content FROM s JOIN documents USING (doc_id) WHERE out_text IS NOT NULL AND length(replace(documents.text, '----', '')) > 6000),
q AS (SELECT bucket, sum(n) AS n FROM {WEIGHED.format('item_id', 'text', '(SELECT * FROM benchmark ORDER BY item_id LIMIT 1)')} GROUP BY bucket), v AS {WEIGHED.format('doc_id, chunk_no', 'content', 'c')},
near AS (SELECT doc_id, chunk_no, round(coalesce(sum(v.n * q.n), 0) / (sqrt(sum(v.n * v.n)) * (SELECT sqrt(sum(n * n)) FROM q)), 12) AS score FROM v LEFT JOIN q USING (bucket) GROUP BY ALL)
SELECT doc_id, 0 AS chunk_no, replace(text, '----', '') AS content FROM documents WHERE length(replace(text, '----', '')) <= 6000
UNION ALL SELECT doc_id, chunk_no, content FROM (SELECT c.*, row_number() OVER (PARTITION BY c.doc_id ORDER BY coalesce(score, 0) DESC, c.chunk_no) AS n FROM c LEFT JOIN near USING (doc_id, chunk_no)) WHERE n <= 3""").replace("string_split(text, chr(10))", "string_split(replace(text, '----', ''), chr(10))"))
def length_gate(spark, sf_dir):
    """Documents of at most 6000 characters whole; of longer ones the three chunks nearest to the first benchmark item."""
    first = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1).first()
    return R.gate_long_text(table(spark, sf_dir, "documents"), first.text if first else "")


@query(with_(HITS) + """ SELECT query_id, string_agg(CASE WHEN file_name <> '' THEN '以下内容来自文档《' || file_name || '》：' || chr(10) || chr(10) ELSE '' END || CASE WHEN len(title_path) > 0 THEN '章节路径：' || array_to_string(title_path, ' > ') || chr(10) || chr(10) ELSE '' END || '正文内容：' || content, chr(10) || '----' || chr(10) ORDER BY rank) AS context FROM hits GROUP BY query_id""")
def format_hits(spark, sf_dir):
    return R.format_hits(hits(spark, sf_dir))


CONTEXT = "ctx AS (SELECT q.query_id, coalesce(string_agg(h.content, chr(10) || '----' || chr(10) ORDER BY rank), '') AS context FROM (SELECT DISTINCT query_id FROM hits) q LEFT JOIN hits h ON h.query_id = q.query_id AND grade = 'yes' GROUP BY q.query_id)"


@query(with_(HITS, CONTEXT) + " SELECT * FROM ctx")
def graded_context(spark, sf_dir):
    h = hits(spark, sf_dir)
    return R.graded_context(h.select("query_id").distinct(), h)


@query(with_(HITS, CONTEXT) + ", p AS (SELECT query_id, string_split(context, '----') AS l FROM ctx) SELECT query_id, (generate_subscripts(l, 1) - 1)::INTEGER AS part_no, unnest(l) AS part FROM p")
def split_context(spark, sf_dir):
    h = hits(spark, sf_dir)
    return R.split_context(R.graded_context(h.select("query_id").distinct(), h))


@query(with_(RUNS) + " SELECT run_id, CASE WHEN rewrite_num >= 2 OR content <> '' THEN 'generate' ELSE 'rewrite' END AS next FROM runs")
def next_after_grade(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", R.next_after_grade(F.col("rewrite_num"), F.col("content")).alias("next"))


@query(with_(RUNS) + " SELECT run_id, CASE WHEN regenerate_num >= 2 THEN 'sorry, no answer' WHEN rewrite_num < 2 THEN content ELSE 'no context' END AS context FROM runs")
def answer_context(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", R.answer_context(F.col("rewrite_num"), F.col("regenerate_num"), F.col("content")).alias("context"))


OUTCOME = "CASE WHEN regenerate_num >= 2 THEN 'useful' WHEN rewrite_num < 2 AND support_grade <> 'yes' THEN 'not_supported' WHEN answer_grade = 'yes' THEN 'useful' ELSE 'not_useful' END"


@query(with_(RUNS) + f" SELECT run_id, {OUTCOME} AS outcome FROM runs")
def next_after_answer(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", R.next_after_answer(F.col("rewrite_num"), F.col("regenerate_num"), F.col("support_grade"), F.col("answer_grade")).alias("outcome"))


@query(with_(RUNS) + " SELECT run_id, CASE WHEN support_grade = 'yes' OR rewrite_num > 2 THEN 'agent' ELSE 'rewrite' END AS next FROM runs")
def next_after_rewrite(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", R.next_after_rewrite(F.col("rewrite_num"), F.col("support_grade")).alias("next"))


@query(with_(RUNS) + f" SELECT rewrite_num, outcome, count(*) AS n FROM (SELECT rewrite_num, {OUTCOME} AS outcome FROM runs) GROUP BY ROLLUP (rewrite_num, outcome)")
def run_outcomes(spark, sf_dir):
    return R.run_outcomes(runs(spark, sf_dir))


@query(with_(REGISTRY) + ", b AS (SELECT table_id || '-new' AS table_id, description, dim, registered_at + INTERVAL 1 DAY AS registered_at FROM registry WHERE length(table_id) % 2 = 0), u AS (SELECT * FROM registry UNION ALL SELECT * FROM b) SELECT table_id, description, dim, registered_at FROM (SELECT *, row_number() OVER (PARTITION BY description, dim ORDER BY registered_at DESC, table_id DESC) AS n FROM u) WHERE n = 1")
def registry_register(spark, sf_dir):
    r = registry(spark, sf_dir)
    new = r.where(F.length("table_id") % 2 == 0).select(F.concat("table_id", F.lit("-new")).alias("table_id"), "description", "dim", (F.col("registered_at") + F.expr("interval 1 day")).alias("registered_at"))
    return G.register(r, new)


@query(with_(REGISTRY) + " SELECT table_id, description FROM registry")
def registry_list(spark, sf_dir):
    return registry(spark, sf_dir).select("table_id", "description")


ASKED = "asked AS (SELECT CASE WHEN length(table_id) % 2 = 0 THEN table_id ELSE table_id || '?' END AS table_id FROM registry)"


def asked(spark, sf_dir):
    """Requests for collections, some of which don't exist."""
    return registry(spark, sf_dir).select(F.when(F.length("table_id") % 2 == 0, F.col("table_id")).otherwise(F.concat("table_id", F.lit("?"))).alias("table_id"))


@query(with_(REGISTRY, ASKED) + " SELECT 'row' AS kind, table_id, CASE WHEN table_id IN (SELECT table_id FROM asked) THEN 'new ' || table_id ELSE description END AS value FROM registry UNION ALL SELECT 'status', a.table_id, CASE WHEN r.table_id IS NULL THEN 'no such id' ELSE 'success' END FROM asked a LEFT JOIN registry r ON r.table_id = a.table_id")
def registry_update(spark, sf_dir):
    new, status = G.update(registry(spark, sf_dir), asked(spark, sf_dir).withColumn("description", F.concat(F.lit("new "), "table_id")))
    return new.select(F.lit("row").alias("kind"), "table_id", F.col("description").alias("value")).unionByName(status.select(F.lit("status").alias("kind"), "table_id", F.col("status").alias("value")))


@query(with_(REGISTRY, ASKED) + " SELECT 'row' AS kind, table_id, 1::BIGINT AS n FROM registry WHERE table_id NOT IN (SELECT table_id FROM asked) UNION ALL SELECT 'chunks', source, count(*) FROM documents WHERE source NOT IN (SELECT table_id FROM asked) GROUP BY source UNION ALL SELECT CASE WHEN r.table_id IS NULL THEN 'no such id' ELSE 'success' END, a.table_id, 1 FROM asked a LEFT JOIN registry r ON r.table_id = a.table_id")
def registry_delete(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("table_id"), "doc_id")
    left, chunks, status = G.delete(registry(spark, sf_dir), docs, asked(spark, sf_dir))
    one = F.lit(1).cast("long").alias("n")
    return left.select(F.lit("row").alias("kind"), "table_id", one).unionByName(chunks.groupBy("table_id").agg(F.count("*").alias("n")).select(F.lit("chunks").alias("kind"), "table_id", "n")).unionByName(status.select(F.col("status").alias("kind"), "table_id", one))


@query(with_(REGISTRY) + " SELECT 'search_knowledge_' || (row_number() OVER (ORDER BY registered_at, table_id) - 1) AS name, description, table_id FROM registry")
def registry_tools(spark, sf_dir):
    return G.tools(registry(spark, sf_dir))


@query(with_(REGISTRY) + " SELECT coalesce(string_agg('【' || description || '】', ' | ' ORDER BY registered_at, table_id), 'no collections') AS overview FROM registry")
def registry_overview(spark, sf_dir):
    return G.overview(registry(spark, sf_dir))


