"""Chat sessions and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators import ordered as O
from quillspan.operators import retrieval as R

PAYLOAD = "session_id string, chat_type string, message struct<user:string,system:string>"


def parse_payloads(rows: DataFrame) -> DataFrame:
    """``value`` read with a fixed schema, and ``ok``: there is a session, and a user and a system text."""
    p = F.from_json("value", PAYLOAD)
    out = rows.withColumn("p", p).select(*rows.columns, "p.session_id", F.coalesce("p.chat_type", F.lit("chat")).alias("chat_type"), F.col("p.message.user").alias("user"), F.col("p.message.system").alias("system"))
    return out.withColumn("ok", F.col("session_id").isNotNull() & F.col("user").isNotNull() & F.col("system").isNotNull())


def explode_pairs(pairs: DataFrame) -> DataFrame:
    """A question and an answer row, of one time, for each (session_id, pair_no, ts, user, system)."""
    two = F.array(F.struct(F.lit("user").alias("role"), F.col("user").alias("content")), F.struct(F.lit("system").alias("role"), F.col("system").alias("content")))
    return pairs.select("session_id", "pair_no", "ts", F.posexplode(two).alias("k", "x")).select("session_id", (2 * F.col("pair_no") + F.col("k")).cast("long").alias("seq"), "ts", "x.role", "x.content")


def dedupe_batch(rows: DataFrame) -> DataFrame:
    """The first row of each (kind, id) by ``seq``; rows without an id all stay, rows without a kind go. Copies of a key meet where
    they are read, before a shuffle, and rows without an id take no part in it."""
    known = rows.where("kind is not null and id is not null")
    first = known.groupBy("kind", "id").agg(F.min_by(F.struct(*rows.columns), F.struct("seq")).alias("r")).select("r.*")
    return first.unionByName(rows.where("kind is not null and id is null"))


def fill_defaults(rows: DataFrame, now: Column, batch: int = 0) -> DataFrame:
    """Missing times, authors and ids; a made id is a hash of the batch's number and all that the row says, so that reruns agree,
    rows of other batches have other ids, and only rows alike in every column share one."""
    said = F.md5(F.to_json(F.struct(*sorted(c for c in rows.columns if c != "id"))))
    made = F.sha2(F.concat_ws("\u0001", "kind", F.col("seq").cast("string"), F.lit(str(batch)), said), 256)
    return rows.withColumns({"id": F.coalesce("id", made), "create_time": F.coalesce("create_time", now), "create_by": F.coalesce("create_by", F.lit("system"))})


def upsert(target: DataFrame, batch: DataFrame, *key: str) -> DataFrame:
    """``target`` with the rows of ``batch`` added, or put in the place of those with the same key (``id`` by default)."""
    key = key or ("id",)
    columns = [c for c in target.columns if c not in key]
    both = target.alias("t").join(batch.withColumn("_new", F.lit(True)).alias("b"), list(key), "full_outer")
    return both.select(*key, *(F.when(F.col("_new"), F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in columns))


def since_checkpoint(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages strictly after their session's checkpoint."""
    cps = sessions.select("session_id", F.col("create_time").alias("checkpoint"))
    return messages.join(cps, "session_id").where(F.col("ts") > F.col("checkpoint"))


def recent_messages(sessions: DataFrame, messages: DataFrame, limit: int = 10, latest: bool = False) -> DataFrame:
    """(session_id, n, messages): the oldest (or latest) ``limit`` messages after the checkpoint, in order, as ``role: content``."""
    order = [F.desc("ts"), F.desc("seq")] if latest else ["ts", "seq"]
    picked = since_checkpoint(sessions, messages).withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy(*order))).where(F.col("n") <= limit)
    line = F.concat("role", F.lit(": "), "content").alias("line")
    lists = picked.groupBy("session_id").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("ts", "seq", line))), lambda x: x["line"]).alias("messages"))
    return sessions.select("session_id").join(lists, "session_id", "left").select("session_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("messages", F.array().cast("array<string>")).alias("messages"))


def similar_messages(requests: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, role, score, rank): for each request (query_id, vector) the ``k`` nearest message vectors (id,
    role, vector, ...) of all sessions, among those of the same dimension. None where there are none."""
    found = R.knn_join(requests, vectors, k)
    return found.join(vectors.select("id", "role"), "id").select("query_id", "id", "role", "score", "rank")


def load_memory(requests: DataFrame, sessions: DataFrame, messages: DataFrame, vectors: DataFrame, limit: int = 10, k: int = 5) -> DataFrame:
    """(query_id, session_id, recent, related, summary) for each request (query_id, session_id, vector): the first ``limit``
    messages after the session's checkpoint, the ``k`` similar ones of (id, role, content, vector) and the
    session's summary; empty for an unknown session, a null vector or where nothing is near."""
    near = R.knn_join(requests, vectors, k).join(vectors.select("id", "role", "content"), "id")
    line = F.concat("role", F.lit(": "), "content").alias("line")
    related = near.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", line))), lambda x: x["line"]).alias("related"))
    asked = sessions.join(requests.select("session_id").distinct(), "session_id", "left_semi")
    recent = recent_messages(asked, messages, limit).select("session_id", F.col("messages").alias("recent"))
    out = requests.select("query_id", "session_id").join(recent, "session_id", "left").join(asked.select("session_id", "summary"), "session_id", "left").join(related, "query_id", "left")
    none = F.array().cast("array<string>")
    return out.select("query_id", "session_id", F.coalesce("recent", none).alias("recent"), F.coalesce("related", none).alias("related"), F.coalesce("summary", F.lit("")).alias("summary"))


def session_info(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, brief, n_after, last_ts): the title and what came after the checkpoint."""
    counts = since_checkpoint(sessions, messages).groupBy("session_id").agg(F.count("*").alias("n_after"), F.max("ts").alias("last_ts"))
    return sessions.select("session_id", "brief").join(counts, "session_id", "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)).cast("long"))


def summary_due(sessions: DataFrame, messages: DataFrame, least: int = 8) -> DataFrame:
    return session_info(sessions, messages).where(F.col("n_after") >= least).select("session_id", "n_after")


def replay_checkpoints(pairs: DataFrame, threshold: int = 8) -> DataFrame:
    """(session_id, pair_no, ts) of the pairs that are checkpoints: the first, and each that
    finds ``threshold`` messages since the last. In closed form, as each pair has two rows."""
    every = -(-threshold // 2) + 1
    pairs = O.numbered(pairs.select("session_id", "pair_no", "ts"), ["session_id"], ["ts", "pair_no"], "n").withColumn("n", F.col("n") - 1)
    return pairs.where(F.col("n") % every == 0).select("session_id", F.col("n").cast("long").alias("pair_no"), "ts")


def asof_checkpoint(messages: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Messages with the last checkpoint strictly before them: both in one order, no range join, and a long session in many tasks."""
    m = messages.select("session_id", "seq", "ts", F.lit(None).cast("timestamp").alias("cp"), F.lit(0).alias("kind"))
    c = checkpoints.select("session_id", F.lit(None).cast("long").alias("seq"), "ts", F.col("ts").alias("cp"), F.lit(1).alias("kind"))
    both = O.last_before(m.unionByName(c), ["session_id"], ["ts", "kind", "seq"], "cp", "checkpoint")
    return both.where("kind = 0").select("session_id", "seq", "ts", "checkpoint")


def late_messages(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, n_late): messages at or before the checkpoint, which are never read again."""
    cps = sessions.select("session_id", F.col("create_time").alias("checkpoint"))
    return messages.join(cps, "session_id").groupBy("session_id").agg(F.count_if(F.col("ts") <= F.col("checkpoint")).alias("n_late"))


def session_brief(brief: Column, user: Column) -> Column:
    return F.coalesce(brief, F.substring(user, 1, 64))


def normalize_history(rows: DataFrame) -> DataFrame:
    """(..., role, text) of history items: strings with a ``system:`` or ``user:`` prefix in ``item``, or structs or maps
    {system}, {user} where ``item`` is one. A struct with both gives its system text. Others are dropped."""
    item = F.col("item")
    kind = rows.schema["item"].dataType
    if kind.typeName() == "string":
        role = F.when(item.startswith("system:"), "system").when(item.startswith("user:"), "user")
        return rows.withColumn("role", role).where("role is not null").withColumn("text", F.trim(F.substring(item, F.length("role") + 2, F.length(item))))
    names = [f.name for f in kind] if kind.typeName() == "struct" else ("system", "user")
    text = {r: item[r].cast("string") if r in names else F.lit(None).cast("string") for r in ("system", "user")}
    role = F.when(text["system"].isNotNull(), "system").when(text["user"].isNotNull(), "user")
    return rows.withColumn("role", role).where("role is not null").withColumn("text", F.trim(F.coalesce(text["system"], text["user"])))


def render_history(summary: Column, similar: Column, recent: Column) -> Column:
    """One prompt text: the summary on one line in brackets, or nothing without one; similar
    messages; recent ones in brackets. Null lists are empty."""
    line = F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("【"), F.regexp_replace(summary, "\n", " "), F.lit("】"))).otherwise("")
    listed = lambda x: F.coalesce(F.array_join(x, ", "), F.lit(""))
    return F.concat(line, listed(similar), F.lit("【"), listed(recent), F.lit("】"))
