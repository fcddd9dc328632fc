"""Events as they arrive: counts by window with late data, and the rolling admission limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.filters import own_us
from ..sources import log_bytes, logs

PER_HOUR, COOLDOWN, HOUR = 10, 300, 3600


def follow(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """A stream of the event files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def follow_logs(spark: SparkSession, root: str, archive: str, path: str, checkpoint: str, idle: float = 60, split: int = log_bytes.SPLIT):
    """Appends the events of the log files below a folder to an archive table as they are written; returns the writer, to be started.

    Files are read from where the batch before has ended, in splits, so a file of any size that still grows is followed; an event is
    passed on once the next one begins, or its file has not grown for ``idle`` seconds. The table is written by Spark's file sink: each
    event is in it once, after restarts too. Ids are hashes of file and place; source_line_start is null, as lines aren't counted."""
    raw = log_bytes.tail(spark, root, checkpoint, idle, split)
    rows = raw.select(F.xxhash64("file", "offset").alias("id"), "file", F.lit(None).cast("int").alias("line"), "modified", F.lit("utf-8").alias("encoding"), "body")
    return logs.interpreted(rows, archive).writeStream.format("parquet").partitionBy("archive_id").option("path", path).option("checkpointLocation", checkpoint)


def calls_with_locks(calls: DataFrame, locks: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Each call with the locks of its session in the seconds up to it; a join of two streams whose state ends with the watermark."""
    a = calls.select(F.col("id").alias("call_id"), "session_id", F.col("ts").cast("timestamp").alias("call_at")).withWatermark("call_at", late)
    b = locks.select(F.col("id").alias("lock_id"), F.col("session_id").alias("_session"), F.col("ts").cast("timestamp").alias("lock_at")).withWatermark("lock_at", late)
    near = F.expr(f"session_id = _session AND lock_at <= call_at AND lock_at >= call_at - INTERVAL {int(seconds)} SECONDS")
    return a.join(b, near).select("call_id", "lock_id", "session_id", "call_at", "lock_at")


def lock_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Locks and deadlocks by window; events later than ``late`` behind the newest are dropped."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).where(F.col("event_type").isin("TLOCK", "TDEADLOCK"))
    counts = rows.groupBy(F.window("at", width)).agg(F.count_if(F.col("event_type") == "TLOCK").alias("locks"), F.count_if(F.col("event_type") == "TDEADLOCK").alias("deadlocks"))
    return counts.select(F.col("window.start").alias("bucket"), "locks", "deadlocks")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None, key: str = "session_id") -> DataFrame:
    """key, start, end, events, own_us, errors of each session: events of one key of which none is ``gap`` or more behind the one before. The
    end is the last event's time plus the gap.

    Over a stream, ``late`` says how far behind the newest event others may come: a session is passed on once the watermark has gone by
    its end, and until then late events join sessions, or merge two. What is later is left out. Null keys are left out. Over a table, it
    is not needed. Partial sums go before the shuffle, so a busy key's rows meet as its partial sessions."""
    rows = events.where(F.col(key).isNotNull()).withColumn("at", F.col("ts").cast("timestamp"))
    rows = rows if late is None else rows.withWatermark("at", late)
    found = rows.groupBy(F.session_window("at", gap).alias("w"), key).agg(
        F.count(F.lit(1)).alias("events"), F.sum(own_us()).alias("own_us"), F.count_if(F.col("event_type").isin("EXCP", "EXCPCNTX")).alias("errors")
    )
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "own_us", "errors")


ADMITTED = "key string, item string, at long, admitted boolean, reason string"


class Admission(StatefulProcessor):
    """Of each key the times admitted in the last hour, by item. An hour after the last one a timer drops the state."""

    def __init__(self, per_hour: int, cooldown: int):
        self.per_hour, self.cooldown = per_hour, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, item string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(at, item) for at, item in self.held.get()]
        batch = pd.concat(list(rows)).sort_values(["at", "item"], kind="stable")
        verdicts = []
        for item, at in zip(batch["item"], batch["at"], strict=True):
            held = [(t, i) for t, i in held if t > at - HOUR]
            # What concerns the item tells more, so it is named first.
            reason = "per_item" if any(i == item and t > at - self.cooldown for t, i in held) else "per_key" if len(held) >= self.per_hour else None
            if reason is None:
                held.append((at, item))
            verdicts.append(reason)
        self._keep(held)
        yield pd.DataFrame({"key": key[0], "item": batch["item"], "at": batch["at"], "admitted": [r is None for r in verdicts], "reason": verdicts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        self._keep([(t, i) for t, i in self.held.get() if t > now - HOUR])
        yield pd.DataFrame(columns=["key", "item", "at", "admitted", "reason"])

    def _keep(self, held: list[tuple[int, str]]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.held.put([(int(t), str(i)) for t, i in held])
            self.handle.registerTimer((max(int(t) for t, _ in held) + HOUR) * 1000)
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def admitted(requests: DataFrame, per_hour: int = PER_HOUR, cooldown: int = COOLDOWN, late: str = "10 minutes") -> DataFrame:
    """key, item, at, admitted, reason: at most ``per_hour`` in any hour of a key, and one per item in ``cooldown`` seconds. The reason is null,
    ``per_item`` or ``per_key``; the first of these two if both hold.

    requests: key, item, at (seconds), at most ``late`` behind the newest. State is the times admitted in the last hour, so it is bounded by
    ``per_hour``, and it ends with the hour: keys that ask no more hold nothing. Requests of a batch are judged in the order of their
    times, those with a null key or time not at all. The session must keep state in RocksDB (``with_state``)."""
    rows = requests.where("key IS NOT NULL AND at IS NOT NULL").select("key", "item", "at", F.timestamp_seconds("at").alias("_at")).withWatermark("_at", late)
    return rows.groupBy("key").transformWithStateInPandas(Admission(per_hour, cooldown), ADMITTED, "append", "eventTime")


def with_state(spark: SparkSession) -> None:
    """Lets streams that are started from now on keep their state in RocksDB, which timers and lists need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
