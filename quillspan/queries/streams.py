"""Streaming jobs, run over what is there and then stopped."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.queries.core import MESSAGES, query, table, with_
from quillspan.queries.memory import CHECKPOINTS
from quillspan.sources import changes, stores
from quillspan.streaming import sessions


PARTS = 3


def arrivals(spark, sf_dir, name, columns, save):
    """Events as files that arrive in ``PARTS`` lots, in order of their ids. A stream is started after each lot, reads it in a batch of
    its own, and is stopped: all that it knows of the lots before is what its checkpoint and its store hold."""
    path = stores.fresh(spark, name)
    rows = table(spark, sf_dir, "events")
    low, high = rows.agg(F.min("event_id"), F.max("event_id")).first()
    lot = F.floor((F.col("event_id") - F.lit(low or 0)) * PARTS / F.lit((high or 0) - (low or 0) + 1))
    for i in range(PARTS):
        rows.where(lot == i).write.mode("append").parquet(f"{path}/in")
        read = spark.readStream.schema(rows.schema).parquet(f"{path}/in").selectExpr(*columns)
        save(read, path).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return path


@query(with_(MESSAGES, CHECKPOINTS) + " SELECT * FROM cps")
def stream_session_state(spark, sf_dir):
    save = lambda rows, path: sessions.session_state(rows).writeStream.format("parquet").option("path", f"{path}/out").outputMode("append")
    path = arrivals(spark, sf_dir, "stream", ("user_id AS session_id", "event_id AS seq", "ts"), save)
    return spark.read.schema("session_id long, pair_no long, ts timestamp").parquet(f"{path}/out")


SAVED = ("event_id AS seq", "event_type AS kind", "CAST(user_id AS string) AS id", "ts AS create_time", "CAST(NULL AS string) AS create_by")


@query(f"""WITH lots AS (SELECT *, floor((event_id - (SELECT min(event_id) FROM events)) * {PARTS} / (SELECT max(event_id) - min(event_id) + 1 FROM events)) AS lot FROM events)
SELECT seq, kind, id, create_time, 'system' AS create_by FROM (SELECT event_id AS seq, event_type AS kind, user_id::VARCHAR AS id, ts AS create_time, row_number() OVER (PARTITION BY event_type, user_id ORDER BY lot DESC, event_id) AS n FROM lots WHERE event_type IS NOT NULL) WHERE n = 1""")
def stream_save(spark, sf_dir):
    """Each lot's first row of a key takes the place of the lots' before; a compaction falls between."""
    save = lambda rows, path: rows.writeStream.foreachBatch(sessions.save_batch(f"{path}/out", compact_after=2))
    path = arrivals(spark, sf_dir, "save", SAVED, save)
    schema = "seq long, kind string, id string, create_time timestamp, create_by string"
    return changes.saved(spark, f"{path}/out", schema)
