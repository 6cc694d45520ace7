"""Archiving of evicted messages from the stream, with their content (#74, then #35).

The live buffer of a session holds whole messages (never more than ``limit + 1``).  What is evicted goes to
the archive table, and where the session's archived total passes a multiple of ``summary_every`` a
row goes to the trigger table.  One ``foreachBatch`` writes both, each into a partition of the batch's
number: a batch that runs again replaces its own rows in both tables.
"""

from __future__ import annotations

import os
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parlance.functions.ids import uuid5_dns
from parlance.operators import mutations
from parlance.operators.memory import BUFFER_LIMIT, SUMMARY_EVERY, TTL_SECONDS
from parlance.session import ensure_checkpoint_dir
from parlance.streaming.session_buffer import ROCKSDB_PROVIDER, in_order, move_timer

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MESSAGE = ["msg_id", "ts", "role", "content", "tokens", "tool_calls"]
_STATE = "msg_id long, ts long, role string, content string, tokens long, tool_calls string"
_OUTPUT = f"session_id long, {_STATE}, kind string, archived_total long"
_ROW = Row("session_id", *MESSAGE, "kind", "archived_total")


class ArchivingBuffer(StatefulProcessor):
    """One session's buffer of whole messages: appends, evicts the older half, expires."""

    def __init__(self, limit: int = BUFFER_LIMIT, ttl: int = TTL_SECONDS, summary_every: int = SUMMARY_EVERY):
        self.limit, self.keep, self.ttl, self.every = limit, limit // 2, ttl, summary_every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _STATE)
        self.counts = handle.getValueState("counts", "last_ts long, total long")

    def handleInputRows(self, key, rows, timerValues):
        sid, out = key[0], []
        last, total = self.counts.get() or (None, 0)
        before_ts = last
        held = [] if last is None else list(self.held.get())
        had = len(held)
        for message in in_order(rows, *MESSAGE):
            ts = message[1]
            if last is not None and ts - last >= self.ttl:
                held = []
            held.append(message)
            if len(held) > self.limit:
                gone, held = held[:len(held) - self.keep], held[len(held) - self.keep:]
                before, total = total, total + len(gone)
                out += [(sid, *m, "archived", None) for m in gone]
                if total // self.every > before // self.every:
                    out.append((sid, message[0], ts, None, None, None, None, "trigger", total))
            last = ts
        if held:
            self.held.put(held)
        elif had:
            self.held.clear()
        self.counts.update((last, total))
        move_timer(self.handle, before_ts, last, self.ttl)
        return (_ROW(*r) for r in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def archiving_stream(messages: DataFrame, limit: int = BUFFER_LIMIT, ttl: int = TTL_SECONDS,
                     summary_every: int = SUMMARY_EVERY, watermark: str = "0 seconds") -> DataFrame:
    """Evicted messages and triggers of a stream ``session_id, event_time`` and the message's columns."""
    return (messages.select("session_id", *MESSAGE, "event_time").withWatermark("event_time", watermark).groupBy("session_id")
            .transformWithState(ArchivingBuffer(limit, ttl, summary_every), _OUTPUT, "append", "EventTime"))


def write_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    """Both tables of one micro-batch.  Its rows are read once and written twice."""
    batch.persist()
    try:
        gone = batch.where("kind = 'archived'")
        mutations.archive_append(mutations.archive_rows(gone), os.path.join(root, "archive"), batch_id)
        mutations.archive_append(batch.where("kind = 'trigger'").select("session_id", "msg_id", "ts", "archived_total"),
                                 os.path.join(root, "triggers"), batch_id)
    finally:
        batch.unpersist()


def archive_ids(messages: DataFrame) -> DataFrame:
    """Messages with the id that their archive row has, so that archive and log can be joined."""
    session = F.col("session_id").cast("string")
    return messages.withColumn("id", uuid5_dns(F.concat_ws("/", F.lit("msg"), session, F.col("msg_id").cast("string"))))


TABLES = {"archive": "id string, session_id string, role string, content string, token_count int, tool_calls string, "
                     "created_at string, batch_id long",
          "triggers": "session_id long, msg_id long, ts long, archived_total long, batch_id long"}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(os.path.join(root, name)).drop("batch_id")


def run_archive(stream: DataFrame, name: str, checkpoint_root: str | None = None) -> str:
    """Archive everything available; the folder that holds the tables ``archive`` and ``triggers``."""
    spark = stream.sparkSession
    root = os.path.join(checkpoint_root or ensure_checkpoint_dir(spark), name)
    query = (stream.writeStream.outputMode("append").foreachBatch(lambda batch, number: write_batch(batch, number, root))
             .option("checkpointLocation", os.path.join(root, "checkpoint")).trigger(availableNow=True))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB_PROVIDER)
    try:
        query.start().awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return root
