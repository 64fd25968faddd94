"""Chat sessions and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import vectors as V
from quillspan.operators import memory as M
from quillspan.queries.core import EPOCH, MESSAGES, PAIRS, VECTORS, messages, pairs, query, sessions, table, vectors, with_


@query(with_(PAIRS) + """ SELECT session_id * 100 + pair_no AS pair, CASE WHEN (session_id + pair_no) % 5 <> 0 THEN session_id::VARCHAR END AS session_id, CASE WHEN (session_id + pair_no) % 3 = 0 THEN 'chat' ELSE 'datasource' END AS chat_type,
 CASE WHEN (session_id + pair_no) % 7 <> 0 THEN user_text END AS user, system, (session_id + pair_no) % 5 <> 0 AND (session_id + pair_no) % 7 <> 0 AS ok FROM pairs""")
def valid_payloads(spark, sf_dir):
    k = F.col("session_id") + F.col("pair_no")
    message = F.struct(F.when(k % 7 != 0, F.col("user")).alias("user"), "system")
    value = F.to_json(F.struct(F.when(k % 5 != 0, F.col("session_id").cast("string")).alias("session_id"), F.when(k % 3 != 0, "datasource").alias("chat_type"), message.alias("message")))
    return M.parse_payloads(pairs(spark, sf_dir).select((F.col("session_id") * 100 + F.col("pair_no")).alias("pair"), value.alias("value"))).drop("value")


ROWS = "rows AS (SELECT session_id, 2 * pair_no + k AS seq, ts, CASE k WHEN 0 THEN 'user' ELSE 'system' END AS role, CASE k WHEN 0 THEN user_text ELSE system END AS content FROM pairs, (SELECT unnest([0, 1]) AS k))"


@query(with_(PAIRS, ROWS) + " SELECT session_id, seq, ts, role, content FROM rows")
def message_rows(spark, sf_dir):
    return M.explode_pairs(pairs(spark, sf_dir))


@query(with_(PAIRS, ROWS) + r""", w AS (SELECT session_id, seq, role, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) AS w FROM rows),
b AS (SELECT session_id, seq, role, (('0x' || substr(md5(w), 1, 8))::BIGINT % 256)::INTEGER AS bucket, count(*) AS n FROM w GROUP BY ALL)
SELECT session_id, seq, role, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY session_id, seq)), 6) AS weight FROM b""")
def vector_rows(spark, sf_dir):
    return V.word_weights(M.explode_pairs(pairs(spark, sf_dir)), "content", "session_id", "seq", "role").withColumn("weight", F.round("weight", 6))


BATCH = "batch AS (SELECT event_id AS seq, CASE WHEN event_id % 11 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 13 <> 0 THEN (user_id % 10)::VARCHAR END AS id FROM events)"


def batch(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("seq"), F.when(e % 11 != 0, F.col("event_type")).alias("kind"), F.when(e % 13 != 0, (F.col("user_id") % 10).cast("string")).alias("id"))


@query(with_(BATCH) + " SELECT seq, kind, id FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY seq) AS n FROM batch WHERE kind IS NOT NULL) WHERE n = 1 OR id IS NULL")
def dedupe_batch(spark, sf_dir):
    return M.dedupe_batch(batch(spark, sf_dir))


@query(with_(BATCH) + f""" SELECT seq, kind, coalesce(id, sha256(concat_ws(chr(1), kind, seq::VARCHAR, '0', md5('{{' || CASE WHEN seq % 2 = 0 THEN '"create_by":"a",' ELSE '' END || coalesce('"kind":"' || kind || '",', '') || '"seq":' || seq || '}}')))) AS id, make_timestamp({EPOCH}::BIGINT * 1000000) AS create_time, CASE WHEN seq % 2 = 0 THEN 'a' ELSE 'system' END AS create_by FROM batch""")
def fill_defaults(spark, sf_dir):
    rows = batch(spark, sf_dir).withColumns({"create_time": F.lit(None).cast("timestamp"), "create_by": F.when(F.col("seq") % 2 == 0, "a")})
    return M.fill_defaults(rows, F.timestamp_seconds(F.lit(EPOCH)))


@query(with_(MESSAGES) + " SELECT session_id AS id, CASE WHEN session_id % 2 = 0 THEN create_time + INTERVAL 1 DAY ELSE create_time END AS create_time, CASE WHEN session_id % 2 = 0 THEN NULL ELSE brief END AS brief FROM sessions WHERE session_id % 3 <> 0 OR session_id % 2 = 0")
def upsert_sessions(spark, sf_dir):
    s = sessions(spark, sf_dir).withColumnRenamed("session_id", "id")
    new = s.where("id % 2 = 0").select("id", (F.col("create_time") + F.expr("interval 1 day")).alias("create_time"), F.lit(None).cast("string").alias("brief"))
    return M.upsert(s.where("id % 3 <> 0"), new)


@query(with_(MESSAGES) + " SELECT seq AS id, session_id, CASE WHEN seq % 2 = 0 THEN upper(content) ELSE content END AS content FROM messages WHERE seq % 5 <> 0 OR seq % 2 = 0")
def upsert_messages(spark, sf_dir):
    m = messages(spark, sf_dir).select(F.col("seq").alias("id"), "session_id", "content")
    return M.upsert(m.where("id % 5 <> 0"), m.where("id % 2 = 0").withColumn("content", F.upper("content")))


AFTER = "after AS (SELECT m.*, row_number() OVER (PARTITION BY m.session_id ORDER BY m.ts, m.seq) AS n FROM messages m JOIN sessions s ON s.session_id = m.session_id AND m.ts > s.create_time)"
RECENT = "recent AS (SELECT s.session_id, count(a.seq) AS n, coalesce(list(a.role || ': ' || a.content ORDER BY a.ts, a.seq) FILTER (WHERE a.seq IS NOT NULL), []::VARCHAR[]) AS messages FROM sessions s LEFT JOIN after a ON a.session_id = s.session_id AND a.n <= 10 GROUP BY s.session_id)"


@query(with_(MESSAGES, AFTER, RECENT) + " SELECT session_id, n, messages FROM recent")
def recent_messages(spark, sf_dir):
    return M.recent_messages(sessions(spark, sf_dir), messages(spark, sf_dir))


INFO = "info AS (SELECT s.session_id, s.brief, count(a.seq) AS n_after, max(a.ts) AS last_ts FROM sessions s LEFT JOIN after a ON a.session_id = s.session_id GROUP BY ALL)"


@query(with_(MESSAGES, AFTER, INFO) + " SELECT * FROM info")
def session_info(spark, sf_dir):
    return M.session_info(sessions(spark, sf_dir), messages(spark, sf_dir))


@query(with_(MESSAGES, AFTER, INFO) + " SELECT session_id, n_after FROM info WHERE n_after >= 8")
def summary_due(spark, sf_dir):
    return M.summary_due(sessions(spark, sf_dir), messages(spark, sf_dir))


CHECKPOINTS = "cps AS (SELECT session_id, n AS pair_no, ts FROM (SELECT session_id, ts, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) - 1 AS n FROM messages) WHERE n % 5 = 0)"


def checkpoints(spark, sf_dir):
    return M.replay_checkpoints(messages(spark, sf_dir).select("session_id", F.col("seq").alias("pair_no"), "ts"))


@query(with_(MESSAGES, CHECKPOINTS) + " SELECT * FROM cps")
def replay_checkpoints(spark, sf_dir):
    return checkpoints(spark, sf_dir)


@query(with_(MESSAGES, CHECKPOINTS) + " SELECT m.session_id, m.seq, m.ts, (SELECT max(c.ts) FROM cps c WHERE c.session_id = m.session_id AND c.ts < m.ts) AS checkpoint FROM messages m")
def asof_checkpoint(spark, sf_dir):
    return M.asof_checkpoint(messages(spark, sf_dir), checkpoints(spark, sf_dir).distinct())


@query(with_(MESSAGES) + " SELECT s.session_id, count(*) FILTER (WHERE m.ts <= s.create_time) AS n_late FROM messages m JOIN sessions s USING (session_id) GROUP BY s.session_id")
def late_messages(spark, sf_dir):
    return M.late_messages(messages(spark, sf_dir), sessions(spark, sf_dir))


@query(with_(PAIRS) + " SELECT session_id, coalesce(CASE WHEN session_id % 4 = 0 THEN 'given' END, substr(user_text, 1, 64)) AS brief FROM pairs WHERE pair_no = 0")
def session_brief(spark, sf_dir):
    return pairs(spark, sf_dir).where("pair_no = 0").select("session_id", M.session_brief(F.when(F.col("session_id") % 4 == 0, "given"), F.col("user")).alias("brief"))


COS = "round(list_dot_product(a.vector, b.vector) / (sqrt(list_dot_product(a.vector, a.vector)) * sqrt(list_dot_product(b.vector, b.vector))), 12)"
SIMILAR = f"""sim AS (SELECT query_id, id, role, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT a.id AS query_id, b.id, CASE WHEN b.id % 2 = 0 THEN 'user' ELSE 'system' END AS role, {COS} AS score FROM vectors a JOIN vectors b ON len(a.vector) = len(b.vector) AND a.id % 20 = 0)) WHERE rank <= 5)"""


def remembered(spark, sf_dir):
    """Message vectors: the rows of ``embeddings``, and their ids as texts."""
    return vectors(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, "user").otherwise("system").alias("role"), F.col("id").cast("string").alias("content"), "vector")


@query(with_(VECTORS, SIMILAR) + " SELECT query_id, id, role, round(score, 6) AS score, rank::INTEGER AS rank FROM sim")
def similar_messages(spark, sf_dir):
    v = remembered(spark, sf_dir)
    return M.similar_messages(v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), v)


LOADED = "loaded AS (SELECT r.session_id, r.messages AS recent, coalesce(s.l, []::VARCHAR[]) AS related, CASE WHEN r.session_id % 3 = 0 THEN '' ELSE 'a' || chr(10) || r.session_id END AS summary FROM recent r LEFT JOIN (SELECT query_id, list(role || ': ' || id ORDER BY rank) AS l FROM sim GROUP BY query_id) s ON s.query_id = r.session_id)"


def loaded(spark, sf_dir):
    """One request for each session; every twentieth has a vector."""
    v, own = remembered(spark, sf_dir), sessions(spark, sf_dir)
    own = own.withColumn("summary", F.when(F.col("session_id") % 3 != 0, F.concat(F.lit("a\n"), F.col("session_id").cast("string"))))
    asked = own.select("session_id").join(v.where("id % 20 = 0").select(F.col("id").alias("session_id"), "vector"), "session_id", "left")
    return M.load_memory(asked.withColumn("query_id", F.col("session_id")), own, messages(spark, sf_dir), v).drop("query_id")


@query(with_(MESSAGES, AFTER, RECENT, VECTORS, SIMILAR, LOADED) + " SELECT * FROM loaded")
def load_memory(spark, sf_dir):
    return loaded(spark, sf_dir)


@query(with_(MESSAGES, AFTER, RECENT, VECTORS, SIMILAR, LOADED) + " SELECT session_id, CASE WHEN summary <> '' THEN '【' || replace(summary, chr(10), ' ') || '】' ELSE '' END || array_to_string(related, ', ') || '【' || array_to_string(recent, ', ') || '】' AS prompt FROM loaded")
def render_history(spark, sf_dir):
    return loaded(spark, sf_dir).select("session_id", M.render_history(F.col("summary"), F.col("related"), F.col("recent")).alias("prompt"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'user' ELSE 'system' END AS role, trim(text) AS text FROM conversations WHERE turn % 4 < 2""")
def normalize_history(spark, sf_dir):
    k = F.col("turn") % 4
    item = F.when(k == 0, F.concat(F.lit("user: "), "text")).when(k == 1, F.concat(F.lit("system: "), "text")).when(k == 2, F.concat(F.lit("x "), "text"))
    return M.normalize_history(table(spark, sf_dir, "conversations").select("conv_id", "turn", item.alias("item"))).drop("item")
