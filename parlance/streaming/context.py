"""Session context with expiry, online (#73) and in closed form (#28).

A context is one record per session: last write wins per field, and a signed token counter.  It lives for
``ttl`` seconds after its last update; an update after that starts a new one.  ``context_segments``
computes every context a session ever had from the whole log; ``stream_context_expiry`` does the same on
a stream, with a ``MapState`` for the fields and an event-time timer at the expiry.

Typed reads, as both do them: an increment that is no integer counts 0 and is counted in
``bad_numbers``; entities that are no JSON object are null and ``error`` names the field.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parlance.operators.memory import CHUNK_SECONDS, CONTEXT_FIELDS, TTL_SECONDS, _segment_frame
from parlance.streaming.session_buffer import in_order, move_timer

cloudpickle.register_pickle_by_value(sys.modules[__name__])

INTEGER = r"^\s*[+-]?[0-9]{1,18}\s*$"
ENTITIES = "extracted_entities"
OUTPUT = ("session_id long, seg_no int, current_goal string, extracted_entities string, last_tool_used string, "
          "user_mood string, total_tokens long, created_at long, updated_at long, version long, bad_numbers long, "
          "closed boolean")
CONTEXT_ROW = Row("session_id", "seg_no", *CONTEXT_FIELDS, "total_tokens", "created_at", "updated_at", "version", "bad_numbers",
                  "closed")


def typed_number(text: Column) -> tuple[Column, Column]:
    """An increment's value, and 1 if its text is no integer; null is no increment."""
    good = F.rlike(text, F.lit(INTEGER))
    return (F.when(good, F.trim(text).cast("bigint")).otherwise(F.lit(0)).cast("bigint"),
            F.when(text.isNotNull() & ~good, 1).otherwise(0).cast("bigint"))


def typed_context(contexts: DataFrame) -> DataFrame:
    """Entities as read: text that is no JSON object becomes null, with the reason in ``error``."""
    value = F.col(ENTITIES)
    good = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(value)), F.lit("OBJECT")), F.lit(False))
    return (contexts.withColumn("error", F.when(value.isNotNull() & ~good, F.lit(ENTITIES)))
            .withColumn(ENTITIES, F.when(good, value)))


def context_segments(updates: DataFrame, ttl: int = TTL_SECONDS, chunk_seconds: int = CHUNK_SECONDS,
                     fields=CONTEXT_FIELDS) -> DataFrame:
    """Every context of every session: ``session_id, seg_no``, the fields, the counter, times, ``version`` (updates),
    ``bad_numbers`` and ``closed`` (expired by an update that came later or by the log's last time).

    ``updates``: ``session_id, msg_id, ts, field, value, increment`` (text).  Segments come from the two-level
    prefix computation, and a context is an aggregate with partial sums: a hot session is not one task's work."""
    number, bad = typed_number(F.col("increment"))
    seg = _segment_frame(updates.withColumn("_number", number).withColumn("_bad", bad), ttl, chunk_seconds)
    order = F.struct("ts", "msg_id")
    out = seg.groupBy("session_id", "seg_no").agg(
        *[F.max_by(F.struct("value"), F.when(F.col("field") == f, order))["value"].alias(f) for f in fields],
        F.sum("_number").alias("total_tokens"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
        F.count(F.lit(1)).alias("version"), F.sum("_bad").alias("bad_numbers"), F.max("_last_seg").alias("_last"))
    now = F.lit(updates.agg(F.max("ts")).first()[0]).cast("long")  # one number: the log's last time
    return typed_context(out.withColumn(
        "closed", (F.col("seg_no") < F.col("_last")) | (F.col("updated_at") + ttl <= now)).drop("_last"))


class ExpiringContext(StatefulProcessor):
    """One session's live context; state is a map entry per field and one row of counters.

    Emits the context after each micro-batch that touched it (``closed`` false) and once more when it
    expires (``closed`` true): by a later update's gap, or by the timer at ``updated_at + ttl``."""

    FIELDS = tuple(CONTEXT_FIELDS)

    def __init__(self, ttl: int = TTL_SECONDS):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fields = handle.getMapState("fields", "field string", "value string")
        self.live = handle.getValueState(
            "live", "total long, first_ts long, last_ts long, version long, bad long")
        self.number = handle.getValueState("number", "seg_no int")

    def _load(self):
        """The session's number of contexts, its live counters (None: no context lives) and its fields."""
        number = self.number.get()
        live = self.live.get() if number else None
        return number[0] if number else 0, live, {k[0]: v[0] for k, v in self.fields.iterator()} if live else {}

    def _row(self, sid, seg_no, live, fields, closed):
        return CONTEXT_ROW(sid, seg_no, *(fields.get(f) for f in self.FIELDS), *live, closed)

    def handleInputRows(self, key, rows, timerValues):
        # the session's state is read once, changed here, and written once
        sid, out = key[0], []
        seg_no, live, fields = self._load()
        before_seg, before_ts, kept = seg_no, live[2] if live else None, dict(fields)
        for ts, name, value, number, bad in in_order(rows, "ts", "field", "value", "number", "bad"):
            if live and ts - live[2] >= self.ttl:
                out.append(self._row(sid, seg_no, live, fields, True))
                live, fields = None, {}
            if not live:
                seg_no, live = seg_no + 1, (0, ts, ts, 0, 0)
            total, first, last, version, wrong = live
            if name in self.FIELDS:
                fields[name] = value
            live = (total + number, first, ts, version + 1, wrong + bad)
        if seg_no != before_seg:
            self.number.update((seg_no,))
            if kept:
                self.fields.clear()
                kept = {}
        for name, value in fields.items():
            if name not in kept or kept[name] != value:
                self.fields.updateValue((name,), (value,))
        self.live.update(live)
        move_timer(self.handle, before_ts, live[2], self.ttl)
        out.append(self._row(sid, seg_no, live, fields, False))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        seg_no, live, fields = self._load()
        if not live:
            return iter(())
        self.fields.clear()
        self.live.clear()
        return iter([self._row(key[0], seg_no, live, fields, True)])

    def close(self) -> None:
        pass


def stream_context_expiry(updates: DataFrame, ttl: int = TTL_SECONDS, watermark: str = "0 seconds") -> DataFrame:
    """#73: contexts with expiry of a stream of updates (as in ``context_segments``, plus ``event_time``).

    Rows of one session that are older than the watermark are dropped by Spark."""
    number, bad = typed_number(F.col("increment"))
    typed = updates.select("session_id", "msg_id", "ts", "field", "value", number.alias("number"), bad.alias("bad"), "event_time")
    return (typed.withWatermark("event_time", watermark).groupBy("session_id")
            .transformWithState(ExpiringContext(ttl), OUTPUT, "append", "EventTime"))


def latest_contexts(emitted: DataFrame) -> DataFrame:
    """The last state of every context among the rows that the stream has emitted."""
    rest = [c for c in emitted.columns if c not in ("session_id", "seg_no")]
    last = emitted.groupBy("session_id", "seg_no").agg(
        F.max_by(F.struct(*rest), F.struct("version", "closed")).alias("s"))
    return typed_context(last.select("session_id", "seg_no", "s.*"))
