"""Streaming queries (#9, #72-#75), each run once with an ``availableNow`` trigger.

The builders start a streaming query over the driver table (a file stream),
run it to completion into a Parquet table and return that table, so the result can be
checked like any batch query.  Checkpoints and tables go under ``spark.checkpoint.dir``,
in a folder named after the query and its source's files (path, length and modification
time), where a later run over the same files resumes; a replaced file starts a new one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from parlance.plans.registry import register
from parlance.operators import memory as M
from parlance.operators import profile as P
from parlance.operators import scoring as S
from parlance.plans import scoring_queries as SQ
from parlance.plans.memory_queries import (_SMALL_LONG, _TRIG_SQL, AS_OF, LONG_TTL, SMALL_LIMIT, _ctx_sql, _disp_sql,
                                           _seg_sql)
from parlance.plans.profile_queries import _history, _label_sql, _priority_sql
from parlance.plans.sqlfn import iso_sql, uuid5_sql
from parlance.plans.turn_queries import _ROUTED_SQL, _final_sql, final_from
from parlance.sources import bindings as B
from parlance.sources.tables import read_table


#: An idle time that many sessions of the driver data pass, so that buffers and contexts expire.
CONTEXT_TTL = 86400


def _sb():
    from parlance.streaming import session_buffer as SB
    return SB


def _name(query: str, spark, d: str, table: str = "events") -> str:
    files = F.concat_ws("|", "path", "length", F.unix_micros("modificationTime"))
    held = _sb().source_files(spark, d, table).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(files)), "\n"), 256)).first()[0]
    return f"{query}-{hashlib.sha256(f'{d} {held}'.encode()).hexdigest()[:12]}"


@register("message_stream", "SELECT event_id, user_id, event_type FROM events")
def message_stream(spark, d):
    SB = _sb()
    return SB.run_available_now(SB.message_stream(spark, d).select("event_id", "user_id", "event_type"),
                                _name("message_stream", spark, d))


# With the 30-day idle limit no session of the driver data goes idle long enough to
# expire, so the stream emits exactly the batch operator's archived rows.
@register("stream_session_buffer", _SMALL_LONG + """
SELECT session_id, msg_id, seg_no, pos, disposition, eviction_turn FROM disp WHERE disposition = 'archived'""")
def stream_session_buffer(spark, d):
    """Evictions and expiries with the small buffer and the long idle limit."""
    SB = _sb()
    s = SB.stream_session_buffer(SB.events_as_messages(SB.message_stream(spark, d)), limit=SMALL_LIMIT, ttl=LONG_TTL)
    return SB.run_available_now(s, _name("stream_session_buffer", spark, d)).where(F.col("disposition") != "summary_trigger").select(
        "session_id", "msg_id", "seg_no", "pos", "disposition", "eviction_turn")


def _expiry_sql():
    """Dispositions as of the log's last time: what the stream has emitted when its watermark is there."""
    disp = _disp_sql("messages_long", SMALL_LIMIT, CONTEXT_TTL).replace(str(AS_OF), "(SELECT max(ts) FROM messages_long)")
    return B.with_ctes("messages_long") + "," + disp + """
SELECT session_id, msg_id, seg_no, pos, disposition, eviction_turn FROM disp WHERE disposition <> 'in_buffer'"""


@register("stream_buffer_expiry", _expiry_sql())
def stream_buffer_expiry(spark, d):
    """Evictions and expiries with an idle limit of a day: most sessions expire several times."""
    SB = _sb()
    s = SB.stream_session_buffer(SB.events_as_messages(SB.message_stream(spark, d)), limit=SMALL_LIMIT, ttl=CONTEXT_TTL)
    return SB.run_available_now(s, _name("stream_buffer_expiry", spark, d)).where(F.col("disposition") != "summary_trigger").select(
        "session_id", "msg_id", "seg_no", "pos", "disposition", "eviction_turn")


@register("stream_archive_and_summary", _SMALL_LONG + _TRIG_SQL + "\nSELECT session_id, msg_id, ts, archived_total FROM trig")
def stream_archive_and_summary(spark, d):
    """Summary triggers emitted from the persistent archived counter."""
    SB = _sb()
    s = SB.stream_session_buffer(SB.events_as_messages(SB.message_stream(spark, d)), limit=SMALL_LIMIT, ttl=LONG_TTL)
    return SB.run_available_now(s, _name("stream_archive_and_summary", spark, d)).where(F.col("disposition") == "summary_trigger").select(
        "session_id", "msg_id", "ts", "archived_total")


@register("stream_context", _ctx_sql())
def stream_context(spark, d):
    SB = _sb()
    ev = SB.message_stream(spark, d)
    upd = B.context_updates_from(ev).withColumn("event_time", F.timestamp_seconds("ts"))
    out = SB.run_available_now(SB.stream_context(upd), _name("stream_context", spark, d))
    last = out.groupBy("session_id").agg(F.max_by(F.struct(*[c for c in out.columns if c != "session_id"]),
                                                  "version").alias("s"))
    return last.select("session_id", "s.current_goal", "s.extracted_entities", "s.last_tool_used", "s.user_mood",
                       "s.total_tokens", "s.created_at", "s.updated_at")


@register("stream_turn_decisions", _ROUTED_SQL + "SELECT event_id, task, task_reason, handoff_required FROM routed")
def stream_turn_decisions(spark, d):
    SB = _sb()
    a = B.analyses_from(SB.message_stream(spark, d))
    return SB.run_available_now(SB.stream_turn_decisions(a).select("event_id", "task", "task_reason",
                                                                    "handoff_required"),
                                _name("stream_turn_decisions", spark, d))


# ------------------------------------------------------------------ #73 with expiry
def _context_sql():
    fields = ",\n       ".join(f"arg_max([value], (ts, msg_id)) FILTER (WHERE field = '{f}')[1] AS {f}" for f in M.CONTEXT_FIELDS)
    return B.with_ctes("context_writes") + "," + _seg_sql("context_writes", CONTEXT_TTL) + f""",
typed AS (SELECT *, regexp_full_match(increment, '\\s*[+-]?[0-9]{{1,18}}\\s*') AS good FROM seg),
ctx AS (
  SELECT session_id, seg_no, {fields},
         CAST(sum(CASE WHEN good THEN CAST(trim(increment) AS BIGINT) ELSE 0 END) AS BIGINT) AS total_tokens,
         min(ts) AS created_at, max(ts) AS updated_at, count(*) AS version,
         CAST(sum(CASE WHEN increment IS NOT NULL AND NOT good THEN 1 ELSE 0 END) AS BIGINT) AS bad_numbers
  FROM typed GROUP BY session_id, seg_no)
SELECT session_id, seg_no, current_goal,
       CASE WHEN object THEN extracted_entities END AS extracted_entities,
       last_tool_used, user_mood, total_tokens, created_at, updated_at, version, bad_numbers,
       seg_no < max(seg_no) OVER (PARTITION BY session_id)
         OR updated_at + {CONTEXT_TTL} <= (SELECT max(ts) FROM context_writes) AS closed,
       CASE WHEN extracted_entities IS NOT NULL AND NOT object THEN 'extracted_entities' END AS error
FROM (SELECT *, CASE WHEN json_valid(extracted_entities) THEN json_type(extracted_entities) = 'OBJECT' ELSE false END AS object
      FROM ctx)"""


@register("context_segments", _context_sql())
def context_segments(spark, d):
    """#28 with expiry and typed reads, over the whole log."""
    from parlance.streaming import context as SC

    ev = read_table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    return SC.context_segments(B.context_writes_from(ev), CONTEXT_TTL)


@register("stream_context_expiry", _context_sql())
def stream_context_expiry(spark, d):
    """The same contexts, online."""
    from parlance.streaming import context as SC

    SB = _sb()
    updates = B.context_writes_from(SB.message_stream(spark, d)).withColumn("event_time", F.timestamp_seconds("ts"))
    out = SB.run_available_now(SC.stream_context_expiry(updates, CONTEXT_TTL), _name("stream_context_expiry", spark, d))
    return SC.latest_contexts(out)


# ------------------------------------------------------------------ #74 archive with content
def archive_messages(ev):
    """Events as whole messages; some of the assistant's carry tool calls."""
    call = F.when((F.col("event_type") == "view") & (F.col("event_id") % 5 == 0), F.concat(
        F.lit('[{"name": "lookup", "id": '), F.col("event_id").cast("string"), F.lit("}]")))
    return ev.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("msg_id"), F.unix_timestamp("ts").alias("ts"),
        F.when(F.col("event_type") == "view", F.lit("assistant")).otherwise(F.lit("user")).alias("role"),
        F.col("event_type").alias("content"), F.floor("value").cast("bigint").alias("tokens"), call.alias("tool_calls"),
        F.timestamp_seconds(F.unix_timestamp("ts")).alias("event_time"))


@register("stream_archive", _SMALL_LONG + f""",
kept AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, msg_id DESC) <= {M.RETENTION_KEEP} AS keep
  FROM disp WHERE disposition = 'archived')
SELECT {uuid5_sql("'msg/' || CAST(session_id AS VARCHAR) || '/' || CAST(msg_id AS VARCHAR)")} AS id,
       {uuid5_sql("CAST(session_id AS VARCHAR)")} AS session_id, role, content,
       CAST(coalesce(tokens, 0) AS INTEGER) AS token_count,
       CASE WHEN role = 'assistant' AND msg_id % 5 = 0 THEN '[{{"name": "lookup", "id": ' || CAST(msg_id AS VARCHAR) || '}}]' END
         AS tool_calls,
       {iso_sql('ts')} AS created_at, keep
FROM kept""")
def stream_archive(spark, d):
    """The archive table that the stream writes, and what retention (#35) keeps of it."""
    from parlance.streaming import archive as SA

    SB = _sb()
    stream = SA.archiving_stream(archive_messages(SB.message_stream(spark, d)), SMALL_LIMIT, LONG_TTL)
    root = SA.run_archive(stream, _name("stream_archive", spark, d))
    rows = SA.read_table(spark, root, "archive")
    # the archive's own order: its time, then its message, by the row ids of the log
    log = archive_messages(read_table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value"))
    keyed = SA.archive_ids(log).select("id", "session_id", "msg_id", "ts")
    kept = M.retention_keep_last_n(rows.select("id").join(keyed, "id")).select("id", "keep")
    return rows.join(kept, "id")


# ------------------------------------------------------------------ #75 the turn's rules
TURN_COLUMNS = ["event_id", "session_id", "task", "handoff_required", "handoff_reason", "final_text", "error",
                "priority_score", "customer_label"]


def _stream_turns_sql():
    head, select = _final_sql().rsplit("\nSELECT r.event_id, r.task,", 1)
    return head + ",\nfinal AS (SELECT r.event_id, r.session_id, r.handoff_required, r.handoff_reason, r.task," + select + f""")
SELECT f.*, p.priority_score, l.customer_label FROM final f
LEFT JOIN ({_priority_sql(5, 10000000, 30)}) p ON p.customer_id = f.session_id
LEFT JOIN ({_label_sql()}) l ON l.customer_id = f.session_id"""


def turn_rules(turns, profiles):
    """#52-#58 of the turns, with the customers' profiles (#54, #55)."""
    return final_from(turns).join(profiles, "session_id", "left").select(*TURN_COLUMNS)


@register("stream_turn_rules", _stream_turns_sql())
def stream_turn_rules(spark, d):
    from parlance.streaming import turns as ST

    def profiles():
        return P.customer_label(P.priority_score(_history(spark, d))).select(
            F.col("customer_id").alias("session_id"), "priority_score", "customer_label")

    shape = turn_rules(read_table(spark, d, "events"), profiles()).schema
    return ST.run_batches(_sb().message_stream(spark, d), _name("stream_turn_rules", spark, d),
                          lambda batch: turn_rules(batch, profiles()), shape)


def _stream_text_sql():
    return f"""
SELECT e.*, i.intent_code, i.confidence, ({" OR ".join(f"instr(lower(trim(m.content)), '{k}') > 0" for k in S.catalog.PRICE_KEYWORDS)})
  AS price_intent
FROM ({SQ._emotion_sql()}) e JOIN ({SQ._intent_sql()}) i ON i.session_id = e.session_id AND i.msg_id = e.msg_id
JOIN (SELECT conv_id AS session_id, turn AS msg_id, text AS content FROM conversations) m
  ON m.session_id = e.session_id AND m.msg_id = e.msg_id"""


@register("stream_text_rules", _stream_text_sql())
def stream_text_rules(spark, d):
    """#51, #59 and #60 of a stream of messages, by rule tables that lie in a folder."""
    from parlance.session import stored
    from parlance.streaming import turns as ST

    rules = stored(ST.rule_rows(spark, intent=S.INTENT_RULES, emotion=S.EMOTION_RULES, flag=S.FLAG_RULES,
                                price={"price": S.catalog.PRICE_KEYWORDS}), "rules")

    def scored(turns):
        said = turns.where("role = 'user'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("msg_id"),
                                                   F.col("text").alias("content"))
        return ST.text_rules(said, ST.read_rules(rules)).drop("content")

    shape = scored(read_table(spark, d, "conversations")).schema
    return ST.run_batches(_sb().message_stream(spark, d, "conversations"), _name("stream_text_rules", spark, d, "conversations"),
                          scored, shape)
