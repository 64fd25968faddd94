"""Chat memory: payloads of a stream to saved messages and sessions, and back to the prompts of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import vectors as V
from quillspan.operators import memory as M
from quillspan.sources import changes as C

MESSAGES = "kind string, id string, session_id string, seq long, role string, content string, vector array<double>, create_time timestamp, create_by string"
SESSIONS = "kind string, id string, seq long, brief string, summary string, create_time timestamp, create_by string"


def save_payloads(path: str, embed: V.Model | V.Hook = V.hash_embed, compact_after: int = 16) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over (value, ts, seq): payloads {session_id, chat_type, message: {user, system}}. Those that are whole are saved as two
    messages each, with vectors, and as their session, whose brief is the beginning of its first question. What isn't whole is passed
    over. A batch that is tried again, or replayed, counts once."""

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        good = M.parse_payloads(batch.select("value", "ts", "seq")).where("ok")
        rows = M.explode_pairs(good.select("session_id", F.col("seq").alias("pair_no"), "ts", "user", "system"))
        rows = rows.select(F.lit("message").alias("kind"), F.sha2(F.concat_ws("\u0001", "session_id", F.col("seq").cast("string")), 256).alias("id"), "session_id", "seq", "role", "content", V.embed(F.col("content"), embed).alias("vector"), F.col("ts").alias("create_time"), F.col("role").alias("create_by"))
        C.append(f"{path}/messages", M.dedupe_batch(rows), batch_id)
        # A session that is saved already keeps its time and brief.
        first = good.groupBy("session_id").agg(F.min(F.struct("ts", "seq", "user")).alias("x"))
        known = C.saved(spark, f"{path}/sessions", SESSIONS).select(F.col("id").alias("session_id"))
        new = first.join(known, "session_id", "left_anti").select(F.lit("session").alias("kind"), F.col("session_id").alias("id"), "x.seq", M.session_brief(F.lit(None).cast("string"), F.col("x.user")).alias("brief"), F.lit(None).cast("string").alias("summary"), F.col("x.ts").alias("create_time"), F.lit("system").alias("create_by"))
        C.append(f"{path}/sessions", new, batch_id)
        if (batch_id + 1) % compact_after == 0:
            C.compact(spark, f"{path}/messages", MESSAGES)
            C.compact(spark, f"{path}/sessions", SESSIONS)

    return save


def prompts(requests: DataFrame, path: str, limit: int = 10, k: int = 5, embed: V.Model | V.Hook = V.hash_embed) -> DataFrame:
    """(query_id, session_id, prompt) for each request (query_id, session_id, text): the session's summary, the messages like the
    text in all sessions, and those since the session's checkpoint, as one text."""
    spark: SparkSession = requests.sparkSession
    rows, own = C.saved(spark, f"{path}/messages", MESSAGES), C.saved(spark, f"{path}/sessions", SESSIONS)
    asked = requests.select("query_id", "session_id", V.embed(F.col("text"), embed).alias("vector"))
    sessions = own.select(F.col("id").alias("session_id"), "create_time", "brief", "summary")
    messages = rows.select("session_id", "seq", F.col("create_time").alias("ts"), "role", "content")
    found = M.load_memory(asked, sessions, messages, rows.select("id", "role", "content", "vector"), limit, k)
    return found.select("query_id", "session_id", M.render_history(F.col("summary"), F.col("related"), F.col("recent")).alias("prompt"))
