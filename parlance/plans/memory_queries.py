"""Session memory queries (#13, #14, #26-#29, #31, #33-#38, #40) over the two message logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import memory as M
from parlance.plans.registry import register
from parlance.sources import bindings as B

AS_OF = B.EVENTS_AS_OF_EPOCH
LONG_TTL = 30 * 86400     # long idle limit: whole event histories become one buffer segment
SMALL_LIMIT = 6           # small buffer so evictions, retention and summaries all fire


def _seg_sql(src: str, ttl: int) -> str:
    return f"""
seg0 AS (
  SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY session_id ORDER BY ts, msg_id) IS NULL
                   OR ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, msg_id) >= {ttl}
                 THEN 1 ELSE 0 END AS new_seg
  FROM {src}),
seg AS (
  SELECT * EXCLUDE (new_seg), CAST(sum(new_seg) OVER (PARTITION BY session_id ORDER BY ts, msg_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS seg_no
  FROM seg0)"""


def _disp_sql(src: str, limit: int, ttl: int, as_of: int = AS_OF) -> str:
    step = limit + 1 - limit // 2
    return _seg_sql(src, ttl) + f""",
d0 AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY session_id, seg_no ORDER BY ts, msg_id) AS INTEGER) AS pos,
         count(*) OVER (PARTITION BY session_id, seg_no) AS seg_size,
         max(ts) OVER (PARTITION BY session_id, seg_no) AS seg_last_ts,
         max(seg_no) OVER (PARTITION BY session_id) AS last_seg
  FROM seg),
d1 AS (SELECT *, {limit + 1} + CAST(floor((pos - 1) / {step}) AS BIGINT) * {step} AS evict_at FROM d0),
disp AS (
  SELECT * EXCLUDE (evict_at, last_seg),
         CASE WHEN evict_at <= seg_size THEN CAST(evict_at AS INTEGER) END AS eviction_turn,
         CASE WHEN evict_at <= seg_size THEN 'archived'
              WHEN seg_no = last_seg AND {as_of} - seg_last_ts < {ttl} THEN 'in_buffer'
              ELSE 'expired' END AS disposition,
         (pos >= {limit + 1} AND (pos - {limit + 1}) % {step} = 0) AS is_eviction
  FROM d1)"""


DISP_COLS = ["session_id", "msg_id", "ts", "seg_no", "pos", "seg_size", "eviction_turn", "disposition"]


def _disp(spark, d, limit, ttl):
    return M.message_disposition(B.messages_long(spark, d), AS_OF, limit=limit, ttl=ttl)


@register("ttl_segments", B.with_ctes("messages_long") + "," + _seg_sql("messages_long", M.TTL_SECONDS)
          + "\nSELECT session_id, msg_id, seg_no FROM seg")
def ttl_segments(spark, d):
    return M.ttl_segments(B.messages_long(spark, d)).select("session_id", "msg_id", "seg_no")


@register("message_disposition", B.with_ctes("messages_long") + ","
          + _disp_sql("messages_long", M.BUFFER_LIMIT, LONG_TTL) + f"\nSELECT {', '.join(DISP_COLS)} FROM disp")
def message_disposition(spark, d):
    return _disp(spark, d, M.BUFFER_LIMIT, LONG_TTL).select(*DISP_COLS)


@register("message_disposition_small", B.with_ctes("messages_long") + ","
          + _disp_sql("messages_long", SMALL_LIMIT, M.TTL_SECONDS) + f"\nSELECT {', '.join(DISP_COLS)} FROM disp")
def message_disposition_small(spark, d):
    return _disp(spark, d, SMALL_LIMIT, M.TTL_SECONDS).select(*DISP_COLS)


@register("rolling_short_memory", B.with_ctes("messages_long") + "," + _seg_sql("messages_long", LONG_TTL) + f"""
SELECT session_id, msg_id, seg_no,
       CAST(count(*) OVER w AS INTEGER) AS n_context,
       array_to_string(list(CAST(msg_id AS VARCHAR)) OVER w, ',') AS context_ids,
       array_to_string(list(role || ': ' || content) OVER w, chr(10)) AS context_text,
       CAST(sum(tokens) OVER w AS BIGINT) AS context_tokens
FROM seg
WINDOW w AS (PARTITION BY session_id, seg_no ORDER BY ts, msg_id ROWS BETWEEN {M.SHORT_MEMORY - 1} PRECEDING AND CURRENT ROW)""")
def rolling_short_memory(spark, d):
    r = M.rolling_short_memory(B.messages_long(spark, d), ttl=LONG_TTL)
    mem = F.col("short_memory")
    return r.select(
        "session_id", "msg_id", "seg_no", F.size(mem).alias("n_context"),
        F.array_join(F.transform(mem, lambda m: m["msg_id"].cast("string")), ",").alias("context_ids"),
        F.array_join(F.transform(mem, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
        .alias("context_text"),
        F.aggregate(mem, F.lit(0).cast("bigint"), lambda acc, m: acc + m["tokens"]).alias("context_tokens"))


@register("last_n_messages", B.with_ctes("messages_long") + f""",
k AS (SELECT session_id, msg_id, ts,
             row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, msg_id DESC) AS rn,
             count(*) OVER (PARTITION BY session_id) AS n FROM messages_long)
SELECT session_id, msg_id, ts, CAST(least(n, {M.SHORT_MEMORY}) - rn + 1 AS INTEGER) AS position
FROM k WHERE rn <= {M.SHORT_MEMORY}""")
def last_n_messages(spark, d):
    return M.last_n_messages(B.messages_long(spark, d)).select("session_id", "msg_id", "ts", "position")


SLICE_START, SLICE_END = 5, -5


@register("message_slice", B.with_ctes("messages_long") + f""",
k AS (SELECT session_id, msg_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts, msg_id) - 1 AS INTEGER) AS idx,
             count(*) OVER (PARTITION BY session_id) AS n FROM messages_long)
SELECT session_id, msg_id, idx FROM k
WHERE idx >= greatest({SLICE_START}, 0) AND idx <= least(n + ({SLICE_END}), n - 1)""")
def message_slice(spark, d):
    return M.message_slice(B.messages_long(spark, d), SLICE_START, SLICE_END).select("session_id", "msg_id", "idx")


_SMALL_LONG = B.with_ctes("messages_long") + "," + _disp_sql("messages_long", SMALL_LIMIT, LONG_TTL)


def _disp_small_long(spark, d):
    return _disp(spark, d, SMALL_LIMIT, LONG_TTL)


@register("retention_keep_last_n", _SMALL_LONG + f"""
SELECT session_id, msg_id,
       row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, msg_id DESC) <= {M.RETENTION_KEEP} AS keep
FROM disp WHERE disposition = 'archived'""")
def retention_keep_last_n(spark, d):
    arch = _disp_small_long(spark, d).where(F.col("disposition") == "archived")
    return M.retention_keep_last_n(arch).select("session_id", "msg_id", "keep")


_STEP_SMALL = SMALL_LIMIT + 1 - SMALL_LIMIT // 2
_TRIG_SQL = f""",
ev AS (SELECT session_id, msg_id, ts,
              CAST(count(*) OVER (PARTITION BY session_id ORDER BY ts, msg_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * {_STEP_SMALL} AS BIGINT) AS archived_total
       FROM disp WHERE is_eviction),
trig AS (SELECT * FROM ev
         WHERE floor(archived_total / {M.SUMMARY_EVERY}) > floor((archived_total - {_STEP_SMALL}) / {M.SUMMARY_EVERY}))"""


@register("summary_trigger_points", _SMALL_LONG + _TRIG_SQL + "\nSELECT session_id, msg_id, ts, archived_total FROM trig")
def summary_trigger_points(spark, d):
    disp = _disp_small_long(spark, d)
    return M.summary_trigger_points(disp, limit=SMALL_LIMIT).select("session_id", "msg_id", "ts", "archived_total")


@register("summary_input", _SMALL_LONG + _TRIG_SQL + f""",
arch AS (SELECT session_id, msg_id, ts,
                row_number() OVER (PARTITION BY session_id ORDER BY ts, msg_id) AS arank
         FROM disp WHERE disposition = 'archived')
SELECT t.session_id, t.msg_id AS trigger_msg_id, t.archived_total, count(*) AS n_input,
       string_agg(CAST(a.msg_id AS VARCHAR), ',' ORDER BY a.ts, a.msg_id) AS input_ids
FROM trig t JOIN arch a ON t.session_id = a.session_id
     AND a.arank > t.archived_total - {M.SUMMARY_INPUT} AND a.arank <= t.archived_total
GROUP BY t.session_id, t.msg_id, t.archived_total""")
def summary_input(spark, d):
    disp = _disp_small_long(spark, d)
    trig = M.summary_trigger_points(disp, limit=SMALL_LIMIT)
    s = M.summary_input(disp, trig)
    return s.select("session_id", "trigger_msg_id", "archived_total", F.size("messages").cast("bigint").alias("n_input"),
                    F.array_join(F.transform("messages", lambda m: m["msg_id"].cast("string")), ",").alias("input_ids"))


#: Triggers after every so many archived messages, and the messages each reads: short, so that sessions of the
#: driver data have chains of several summaries.
CHAIN_EVERY, CHAIN_INPUT = 10, 10


def topic_messages(spark, d):
    """The long message log with a few topic words in each message."""
    topic = lambda n: F.concat(F.lit("topic"), (F.col("msg_id") % n).cast("string"))
    return B.messages_long(spark, d).withColumn("content", F.concat_ws(" ", "content", topic(11), topic(7), topic(5)))


@register("chained_summaries", _SMALL_LONG.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
ev AS (SELECT session_id, msg_id, ts,
              CAST(count(*) OVER (PARTITION BY session_id ORDER BY ts, msg_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * {_STEP_SMALL} AS BIGINT) AS archived_total
       FROM disp WHERE is_eviction),
trig AS (SELECT session_id, archived_total, row_number() OVER (PARTITION BY session_id ORDER BY archived_total) AS place FROM ev
         WHERE floor(archived_total / {CHAIN_EVERY}) > floor((archived_total - {_STEP_SMALL}) / {CHAIN_EVERY})),
arch AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, msg_id) AS arank,
                [content, 'topic' || CAST(msg_id % 11 AS VARCHAR), 'topic' || CAST(msg_id % 7 AS VARCHAR),
                 'topic' || CAST(msg_id % 5 AS VARCHAR)] AS words
         FROM disp WHERE disposition = 'archived'),
wt AS (SELECT session_id, place, term, count(*) AS n FROM (
         SELECT t.session_id, t.place, unnest(a.words) AS term FROM trig t JOIN arch a ON a.session_id = t.session_id
            AND a.arank > t.archived_total - {CHAIN_INPUT} AND a.arank <= t.archived_total) GROUP BY ALL),
lists AS (SELECT session_id, place, map_from_entries(list((term, n))) AS said FROM wt GROUP BY ALL),
chain AS (
  SELECT session_id, CAST(0 AS BIGINT) AS place, CAST(map([], []) AS MAP(VARCHAR, BIGINT)) AS terms
  FROM (SELECT DISTINCT session_id FROM trig)
  UNION ALL
  SELECT c.session_id, l.place, map_from_entries(list_transform(list_slice(list_sort(list_transform(
           list_distinct(list_concat(map_keys(c.terms), map_keys(l.said))),
           lambda w: (-(coalesce(c.terms[w], 0) // 2 + 2 * coalesce(l.said[w], 0)), w))), 1, 5),
           lambda x: (x[2], -x[1])))
  FROM chain c JOIN lists l ON l.session_id = c.session_id AND l.place = c.place + 1)
SELECT c.session_id, t.archived_total, CAST(c.place AS INTEGER) AS place,
       array_to_string(list_transform(map_entries(c.terms), lambda x: x.key || ':' || CAST(x.value AS VARCHAR)), ',') AS terms
FROM chain c JOIN trig t ON t.session_id = c.session_id AND t.place = c.place""")
def chained_summaries(spark, d):
    """#38 and #60g with the previous summary: chains of summaries of every session."""
    from parlance.operators import summaries as SU

    disp = M.message_disposition(topic_messages(spark, d), AS_OF, limit=SMALL_LIMIT, ttl=LONG_TTL)
    trig = M.summary_trigger_points(disp, limit=SMALL_LIMIT, every=CHAIN_EVERY)
    out = SU.chained_summaries(M.summary_input(disp, trig, n=CHAIN_INPUT))
    return out.select("session_id", "archived_total", "place", F.array_join(F.transform(
        "terms", lambda t: F.concat(t["term"], F.lit(":"), t["score"].cast("string"))), ",").alias("terms"))


@register("messages_per_session", _SMALL_LONG + """
SELECT session_id, count(*) FILTER (WHERE disposition = 'archived') AS archived_count FROM disp GROUP BY session_id""")
def messages_per_session(spark, d):
    return M.messages_per_session(_disp_small_long(spark, d))


@register("buffer_tokens", B.with_ctes("messages_long") + "," + _disp_sql("messages_long", M.BUFFER_LIMIT, LONG_TTL) + """
SELECT session_id, CAST(coalesce(sum(tokens) FILTER (WHERE disposition = 'in_buffer'), 0) AS BIGINT) AS buffer_tokens,
       count(*) FILTER (WHERE disposition = 'in_buffer') AS buffer_messages
FROM disp GROUP BY session_id""")
def buffer_tokens(spark, d):
    return M.buffer_tokens(_disp(spark, d, M.BUFFER_LIMIT, LONG_TTL))


@register("transcript_text", B.with_ctes("messages_short") + f""",
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, msg_id DESC) AS rn FROM messages_short)
SELECT session_id, string_agg(coalesce(role, 'unknown') || ': ' || coalesce(content, ''), chr(10) ORDER BY ts, msg_id)
         AS transcript, CAST(count(*) AS INTEGER) AS n_messages
FROM k WHERE rn <= {M.SUMMARY_INPUT} GROUP BY session_id""")
def transcript_text(spark, d):
    return M.transcript_text(B.messages_short(spark, d))


@register("transcript_numbered", B.with_ctes("messages_long") + f""",
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, msg_id DESC) AS rn,
             least(count(*) OVER (PARTITION BY session_id), {M.SHORT_MEMORY}) AS n FROM messages_long)
SELECT session_id, string_agg(CAST(n - rn + 1 AS VARCHAR) || '. [' || coalesce(role, 'unknown') || ']: '
                              || coalesce(content, ''), chr(10) ORDER BY ts, msg_id) AS transcript,
       CAST(count(*) AS INTEGER) AS n_messages
FROM k WHERE rn <= {M.SHORT_MEMORY} GROUP BY session_id""")
def transcript_numbered(spark, d):
    return M.transcript_text(B.messages_long(spark, d), n=M.SHORT_MEMORY, numbered=True)


ACTIVE_TTL = 86400


@register("active_sessions", B.with_ctes("messages_long") + "," + _seg_sql("messages_long", ACTIVE_TTL) + f""",
l AS (SELECT *, max(seg_no) OVER (PARTITION BY session_id) AS last_seg FROM seg),
c AS (SELECT session_id, max(ts) AS last_ts, count(*) AS message_count FROM l WHERE seg_no = last_seg
      GROUP BY session_id)
SELECT session_id, last_ts + {ACTIVE_TTL} - {AS_OF} AS remaining_ttl, message_count FROM c
WHERE last_ts + {ACTIVE_TTL} - {AS_OF} > 0""")
def active_sessions(spark, d):
    return M.active_sessions(B.messages_long(spark, d), AS_OF, ttl=ACTIVE_TTL)


@register("token_counter", B.with_ctes("context_updates") + """
SELECT session_id, msg_id, increment,
       CAST(sum(increment) OVER (PARTITION BY session_id ORDER BY ts, msg_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_total
FROM context_updates""")
def token_counter(spark, d):
    return M.token_counter(B.context_updates(spark, d)).select("session_id", "msg_id", "increment", "running_total")


def _ctx_sql():
    cols = ",\n       ".join(
        f"arg_max(value, (ts, msg_id)) FILTER (WHERE field = '{f}') AS {f}" for f in M.CONTEXT_FIELDS)
    return B.with_ctes("context_updates") + f"""
SELECT session_id, {cols},
       CAST(coalesce(sum(increment), 0) AS BIGINT) AS total_tokens, min(ts) AS created_at, max(ts) AS updated_at
FROM context_updates GROUP BY session_id"""


@register("context_state", _ctx_sql())
def context_state(spark, d):
    return M.context_state(B.context_updates(spark, d))
