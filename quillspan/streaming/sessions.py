"""Session state over a stream of message pairs, and saving micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspan.functions import vectors as V
from quillspan.operators import memory as M
from quillspan.sources import changes as C

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Counts(StatefulProcessor):
    """State of a session: its number of pairs, and of messages since its checkpoint."""

    def __init__(self, threshold: int, summarise: Callable[[int, pd.Timestamp], bool] | None, zone: str = "UTC"):
        self.threshold, self.summarise, self.zone = threshold, summarise, zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "n long, count long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        # State is asked for and told once; rows have times as numbers, null last, and no frame is made for a session.
        n, count = self.counts.get() or (0, 0)
        out, last = [], lambda x: (x is None, 0 if x is None else x)
        for ts in [r.ts for r in sorted(rows, key=lambda r: (last(r.ts), last(r.seq)))]:
            if n == 0 or (count >= self.threshold and (self.summarise is None or self.summarise(key[0], self._time(ts)))):
                out.append(Row(session_id=key[0], pair_no=n, ts=ts))
                count = 0
            else:
                count += 2
            n += 1
        self.counts.update((n, count))
        yield from out

    def _time(self, ts: int | None) -> pd.Timestamp:
        """A time in the zone of the session of Spark."""
        return pd.NaT if ts is None else pd.Timestamp(ts, unit="us", tz="UTC").tz_convert(self.zone).tz_localize(None)

    def close(self) -> None:
        pass


def session_state(pairs: DataFrame, threshold: int = 8, summarise: Callable[[int, pd.Timestamp], bool] | None = None) -> DataFrame:
    """(session_id, pair_no, ts) of the pairs that become checkpoints of a stream of (session_id, seq, ts).

    The first pair opens the session and is its checkpoint. A pair that finds ``threshold`` messages or more makes
    a summary due; it becomes the checkpoint, and isn't counted, if ``summarise`` succeeds
    (always, by default), else it is counted and the next pair tries again. Pairs of a batch
    are taken in order of ts and seq. State lies in RocksDB, which the session is set to, and so on disk where it is large."""
    conf = pairs.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = pairs.select("session_id", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    counts = Counts(threshold, summarise, conf.get("spark.sql.session.timeZone"))
    out = rows.groupBy("session_id").transformWithState(counts, "session_id long, pair_no long, ts long", "append", "none")
    return out.select("session_id", "pair_no", F.timestamp_micros("ts").alias("ts"))


def save_batch(path: str, now: str = "2024-01-01 00:00:00", embed: Callable[[pd.Series], np.ndarray] | None = None, compact_after: int = 16, buckets: int = C.BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows (kind, id, seq, create_time, create_by, ...) are filled, deduplicated and saved as changes to those with
    their kind and id (:mod:`quillspan.sources.changes`); with ``embed`` they have the ``vector`` of their ``content``.

    A batch writes no more than its own rows; after every ``compact_after`` batches the buckets that they touched are
    written anew. A batch that is tried again gives the same. Read with :func:`quillspan.sources.changes.saved`."""

    def save(batch: DataFrame, batch_id: int) -> None:
        # First those with an id; those that are given one are alike in every column if they share it.
        rows = M.dedupe_batch(M.fill_defaults(M.dedupe_batch(batch), F.to_timestamp(F.lit(now)), batch_id))
        if embed is not None:
            rows = rows.withColumn("vector", V.embed(F.col("content"), embed))
        C.append(path, rows, batch_id)
        if (batch_id + 1) % compact_after == 0:
            C.compact(batch.sparkSession, path, rows.schema, buckets=buckets)

    return save
