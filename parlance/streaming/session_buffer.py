"""Session state on streams (#9, #72-#75) with Structured Streaming.

``stream_session_buffer`` is the online form of ``message_disposition``: per
session a ``ListState`` holds the live buffer (never more than ``limit + 1``
messages, so state is bounded by the policy, not by the session length) and a
``ValueState`` holds the segment counters.  After each append, if the buffer
holds more than ``limit`` messages, all but the newest ``limit // 2`` are emitted
as ``archived``.  An idle gap of ``ttl`` seconds closes the segment: inside a
micro-batch this is seen directly from the gap, across batches an event-time
timer at ``last_ts + ttl`` fires once the watermark passes it; the remaining
buffer is emitted as ``expired``.  Every time the session's archived total
crosses a multiple of ``summary_every`` a ``summary_trigger`` row is emitted
(#74); the total lives in state without a TTL.

Rows of one micro-batch are applied in ``(ts, msg_id)`` order; rows older than the
watermark are dropped by Spark (an eviction already emitted cannot be undone).
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parlance.operators.memory import BUFFER_LIMIT, SUMMARY_EVERY, TTL_SECONDS
from parlance.session import ensure_checkpoint_dir
from parlance.sources.tables import DRIVER_SCHEMAS, table_path

# The processor class is shipped to Python workers by value, so executors need only
# pyspark, not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Files of one micro-batch.
MAX_FILES = 16

BUFFER_SCHEMA = "msg_id long, ts long, pos int"
META_SCHEMA = "last_ts long, seg_no int, seg_count int, archived_total long"
OUTPUT_SCHEMA = ("session_id long, msg_id long, ts long, seg_no int, pos int, disposition string, "
                 "eviction_turn int, archived_total long")
OUTPUT_ROW = Row("session_id", "msg_id", "ts", "seg_no", "pos", "disposition", "eviction_turn", "archived_total")


def in_order(rows: Iterable[Row], *columns: str) -> list[tuple]:
    """One session's rows of a micro-batch, as tuples of ``columns`` in ``(ts, msg_id)`` order (nulls last)."""
    def place(r):
        return r.ts is None, r.ts or 0, r.msg_id is None, r.msg_id or 0

    return [tuple(r[c] for c in columns) for r in sorted(rows, key=place)]


def move_timer(handle: StatefulProcessorHandle, before_ts: int | None, last_ts: int, ttl: int) -> None:
    """The session's one timer goes to ``last_ts + ttl``; it stood at ``before_ts + ttl``, if there was one."""
    if before_ts != last_ts:
        if before_ts is not None:
            handle.deleteTimer((before_ts + ttl) * 1000)
        handle.registerTimer((last_ts + ttl) * 1000)


class SessionBufferProcessor(StatefulProcessor):
    """Buffer, evict and expire one session's messages (see the module doc)."""

    def __init__(self, limit: int = BUFFER_LIMIT, ttl: int = TTL_SECONDS, summary_every: int = SUMMARY_EVERY):
        self.limit, self.keep, self.ttl, self.every = limit, limit // 2, ttl, summary_every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buf = handle.getListState("buf", BUFFER_SCHEMA)
        self.meta = handle.getValueState("meta", META_SCHEMA)

    def handleInputRows(self, key, rows, timerValues):
        sid = key[0]
        last_ts, seg_no, seg_count, total = self.meta.get() or (None, 0, 0, 0)
        before_ts = last_ts
        buf = [] if last_ts is None else list(self.buf.get())
        held, out = len(buf), []
        for msg_id, ts in in_order(rows, "msg_id", "ts"):
            if last_ts is None or ts - last_ts >= self.ttl:
                out += [(sid, m, t, seg_no, p, "expired", None, None) for m, t, p in buf]
                buf, seg_no, seg_count = [], seg_no + 1, 0
            seg_count += 1
            buf.append((msg_id, ts, seg_count))
            if len(buf) > self.limit:
                evicted, buf = buf[:-self.keep] if self.keep else buf, buf[-self.keep:] if self.keep else []
                before, total = total, total + len(evicted)
                out += [(sid, m, t, seg_no, p, "archived", seg_count, None) for m, t, p in evicted]
                if total // self.every > before // self.every:
                    out.append((sid, msg_id, ts, seg_no, seg_count, "summary_trigger", seg_count, total))
            last_ts = ts
        if buf:
            self.buf.put(buf)
        elif held:
            self.buf.clear()
        self.meta.update((last_ts, seg_no, seg_count, total))
        move_timer(self.handle, before_ts, last_ts, self.ttl)
        return (OUTPUT_ROW(*r) for r in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        sid = key[0]
        meta = self.meta.get()
        if meta is None:
            return iter(())
        buf = list(self.buf.get())
        self.buf.clear()
        return iter([OUTPUT_ROW(sid, m, t, meta[1], p, "expired", None, None) for m, t, p in buf])

    def close(self) -> None:
        pass


CONTEXT_OUTPUT = ("session_id long, current_goal string, extracted_entities string, last_tool_used string, "
                  "user_mood string, total_tokens long, created_at long, updated_at long, version long")
CONTEXT_ROW = Row("session_id", "current_goal", "extracted_entities", "last_tool_used", "user_mood", "total_tokens",
                  "created_at", "updated_at", "version")


class SessionContextProcessor(StatefulProcessor):
    """#73: last-write-wins context fields (``MapState``) and a signed token counter (``ValueState``).

    State per session is one map entry per context field plus four counters, so it
    is bounded by the number of fields.  Emits the session's context after each
    micro-batch that touched it; ``version`` counts applied updates.
    """

    FIELDS = ("current_goal", "extracted_entities", "last_tool_used", "user_mood")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getMapState("fields", "field string", "value string, ts long, msg_id long")
        self.totals = handle.getValueState("totals", "total long, first_ts long, last_ts long, version long")

    def handleInputRows(self, key, rows, timerValues):
        # the session's state is read once, changed here, and written once
        totals = self.totals.get()
        total, first, last, version = totals or (0, None, None, 0)
        held = {k[0]: v for k, v in self.fields.iterator()} if totals else {}
        written = set()
        for f, v, ts, mid, inc in in_order(rows, "field", "value", "ts", "msg_id", "increment"):
            cur = held.get(f)
            if cur is None or (ts, mid) > (cur[1], cur[2]):
                held[f] = (v, ts, mid)
                written.add(f)
            total += inc or 0
            first = ts if first is None else min(first, ts)
            last = ts if last is None else max(last, ts)
            version += 1
        for f in written:
            self.fields.updateValue((f,), held[f])
        self.totals.update((total, first, last, version))
        values = [held[f][0] if f in held else None for f in self.FIELDS]
        return iter([CONTEXT_ROW(key[0], *values, total, first, last, version)])

    def close(self) -> None:
        pass


def stream_context(updates: DataFrame, watermark: str = "0 seconds") -> DataFrame:
    """#73: online context state per session (``updates`` as in ``context_state`` plus ``event_time``)."""
    return (updates.withWatermark("event_time", watermark).groupBy("session_id")
            .transformWithState(SessionContextProcessor(), CONTEXT_OUTPUT, "append", "None"))


def source_files(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """``path, length, modificationTime`` of a driver table's files; their bytes are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
        table_path(sf_dir, table)).select("path", "length", "modificationTime")


def message_stream(spark: SparkSession, sf_dir: str, table: str = "events",
                   max_files_per_trigger: int = MAX_FILES) -> DataFrame:
    """#9: a driver table as a file stream.  A table that is one file is read by its directory
    and a glob filter (single-file paths are refused), a folder of part files by its own path.
    ``max_files_per_trigger`` bounds a micro-batch, and so the rows of one session that the
    processors sort at a time."""
    stream = spark.readStream.schema(DRIVER_SCHEMAS[table]).option("maxFilesPerTrigger", max_files_per_trigger)
    one = source_files(spark, sf_dir, table).filter(F.col("path").endswith(f"/{table}.parquet")).select("path").first()
    if one and one["path"].rsplit("/", 2)[-2] == sf_dir.rstrip("/").rsplit("/", 1)[-1]:
        return stream.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    return stream.parquet(table_path(sf_dir, table))


def events_as_messages(stream: DataFrame) -> DataFrame:
    """Streamed events in the message-log shape, with an event-time column for the watermark."""
    return stream.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("msg_id"),
        F.unix_timestamp("ts").alias("ts"),
        F.timestamp_seconds(F.unix_timestamp("ts")).alias("event_time"))


def stream_session_buffer(messages: DataFrame, limit: int = BUFFER_LIMIT, ttl: int = TTL_SECONDS,
                          watermark: str = "0 seconds", summary_every: int = SUMMARY_EVERY) -> DataFrame:
    """#72 / #74: evicted, expired and summary-trigger rows of every session, online."""
    return (messages.withWatermark("event_time", watermark)
            .groupBy("session_id")
            .transformWithState(SessionBufferProcessor(limit, ttl, summary_every), OUTPUT_SCHEMA,
                                        "append", "EventTime"))


def stream_turn_decisions(analyses_stream: DataFrame) -> DataFrame:
    """#75: stateless handoff and routing rules applied to a stream (same code as batch)."""
    from parlance.operators import decisions as D
    return D.task_routing(D.handoff_decision(analyses_stream))


def run_available_now(df: DataFrame, name: str, checkpoint_root: str | None = None) -> DataFrame:
    """Run a streaming DataFrame over everything available and return its output table.

    Executors write each micro-batch as Parquet under a partition of its batch id, so a
    batch that runs again replaces its own files.  Checkpoint and output live under
    ``<spark.checkpoint.dir>/<name>``: a query started again under the same name resumes
    there and only adds what is new.  Nothing passes through the driver.
    """
    spark = df.sparkSession
    root = os.path.join(checkpoint_root or ensure_checkpoint_dir(spark), name)
    out = os.path.join(root, "out")

    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out))

    # transformWithState keeps its state in RocksDB (the default provider cannot hold it)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB_PROVIDER)
    try:
        q = (df.writeStream.outputMode("append").foreachBatch(sink)
             .option("checkpointLocation", os.path.join(root, "checkpoint"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    schema = T.StructType([*df.schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(out).drop("batch_id")
