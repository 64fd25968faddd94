"""How queries are registered, and the derived tables that several of them read, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EPOCH = 1_704_067_200  # 2024-01-01 in seconds


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL twin."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


BLOCKS = """lines AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS block_no FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)),
blocks AS (SELECT doc_id, block_no::INTEGER AS block_no, CASE WHEN block_no % 7 = 0 THEN 'title' ELSE 'paragraph' END AS type, (CASE WHEN block_no = 0 THEN 1 WHEN block_no % 7 = 0 THEN 1 + (block_no // 7) % 3 END)::INTEGER AS level, text FROM lines)"""


def sql_words(x: str) -> str:
    return rf"len(regexp_extract_all(regexp_replace({x}, '([\x{{4e00}}-\x{{9fff}}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]'))"


def sql_code(x: str) -> str:
    return rf"regexp_replace({x}, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g')"


def sql_marked(x: str) -> str:
    return rf"regexp_replace({sql_code(x)}, '(?i)(<h[1-6]\b|<p\b|</h[1-6]>|</p>|</article>|</body>)', chr(1) || '\1', 'g')"


def sql_plain(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return rf"trim(regexp_replace({x}, '[ \t\r\n]+', ' ', 'g'))"


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection for each source, described by the start of its first document."""
    docs = table(spark, sf_dir, "documents").where("source is not null")
    first = docs.groupBy(F.col("source").alias("table_id")).agg(F.min_by(F.substring("text", 1, 80), "doc_id").alias("description"), F.min("doc_id").alias("d"))
    return first.select("table_id", "description", F.lit(256).alias("dim"), F.timestamp_seconds(F.col("d") + EPOCH).alias("registered_at"))


REGISTRY = f"""registry AS (SELECT source AS table_id, arg_min(substr(text, 1, 80), doc_id) AS description, 256 AS dim, make_timestamp((min(doc_id) + {EPOCH}) * 1000000) AS registered_at FROM documents WHERE source IS NOT NULL GROUP BY source)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, pair_no, ts, user, system): a user turn and the assistant's next."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "system": F.lead("text").over(w)})
    own = turns.where("role = 'user' and next_role = 'assistant'").withColumn("pair_no", F.row_number().over(w) - 1)
    return own.select(F.col("conv_id").alias("session_id"), F.col("pair_no").cast("long").alias("pair_no"), F.timestamp_seconds(F.col("conv_id") * 3600 + F.col("turn") * 60 + EPOCH).alias("ts"), F.col("text").alias("user"), "system")


PAIRS = f"""turns AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS system FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pair_no, make_timestamp((conv_id * 3600 + turn * 60 + {EPOCH}) * 1000000) AS ts, text AS user_text, system FROM turns WHERE role = 'user' AND next_role = 'assistant')"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, seq, ts, role, content) from events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_id") % 2 == 0, "user").otherwise("system").alias("role"), F.col("event_type").alias("content"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, create_time, brief): checkpoints among the users' events."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("session_id")).agg(F.coalesce(F.max(F.when(F.col("event_id") % 7 == 0, F.col("ts"))), F.min("ts")).alias("create_time"), F.min_by("event_type", "event_id").alias("brief"))


MESSAGES = """messages AS (SELECT user_id AS session_id, event_id AS seq, ts, CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'system' END AS role, event_type AS content FROM events),
sessions AS (SELECT user_id AS session_id, coalesce(max(CASE WHEN event_id % 7 = 0 THEN ts END), min(ts)) AS create_time, arg_min(event_type, event_id) AS brief FROM events GROUP BY user_id)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector, table_id) from embeddings; labels are collections."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("table_id"))


VECTORS = "vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label::VARCHAR AS table_id FROM embeddings)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with counters and grades, from orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("long").alias("run_id"), (F.col("o_orderkey") % 4 - 1).cast("int").alias("rewrite_num"), (F.col("o_custkey") % 4 - 1).cast("int").alias("regenerate_num"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("content"), F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise("no").alias("support_grade"), F.when(F.col("o_custkey") % 2 == 0, "yes").otherwise("no").alias("answer_grade"))


RUNS = """runs AS (SELECT o_orderkey::BIGINT AS run_id, (o_orderkey % 4 - 1)::INTEGER AS rewrite_num, (o_custkey % 4 - 1)::INTEGER AS regenerate_num, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS content, CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS support_grade, CASE WHEN o_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS answer_grade FROM orders)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, file_name, title_path, content, grade): documents as hits of queries, twenty of each at most, graded by labels."""
    d, g = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = d.join(g, "doc_id", "left")
    return rows.select(F.floor(F.col("doc_id") / 20).alias("query_id"), F.col("doc_id").alias("rank"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("source", "lang")).alias("title_path"), F.col("text").alias("content"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("grade"))


HITS = """hits AS (SELECT d.doc_id // 20 AS query_id, d.doc_id AS rank, 'doc_' || d.doc_id || '.txt' AS file_name, CASE WHEN d.doc_id % 3 = 0 THEN []::VARCHAR[] ELSE [source, lang] END AS title_path, text AS content, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS grade FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
