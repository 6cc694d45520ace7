"""Session memory policies over message logs (#13, #14, #26-#29, #31, #33-#38, #40).

Input: a message log ``(session_id, msg_id, ts, role, content, tokens)`` with
integer epoch seconds.  Every operator is a window or aggregate keyed by session,
so all of them share one hash partitioning on ``session_id`` (a single Exchange
for a chain of windows; later windows keyed by ``(session_id, seg_no)`` reuse it).

Buffer policy in closed form (the reference applies it one append at a time):
after each append, if the buffer holds more than M messages, all but the newest
K = M // 2 are archived.  With S = M + 1 - K, message i (1-based inside its TTL
segment) of a segment of N messages belongs to eviction batch b = ceil(i / S),
evicted on the arrival of message e = M + 1 + (b - 1) * S; it is archived iff
e <= N.  A segment ends when the idle gap reaches the TTL (key expiry), and its
never-evicted messages expire, except in a session's last segment while
``as_of - last_ts < ttl`` (still in the buffer).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUFFER_LIMIT = 50        # messages in the buffer before eviction
TTL_SECONDS = 3600       # idle expiry of a session buffer
SHORT_MEMORY = 20        # messages read per turn
SUMMARY_EVERY = 50       # archived messages between summaries
SUMMARY_INPUT = 50       # archived messages fed to a summary
RETENTION_KEEP = 50      # archived messages kept per session


def _by_session():
    return Window.partitionBy("session_id").orderBy("ts", "msg_id")


def chunked_prefix(df: DataFrame, value_col: str | None = None, chunk_seconds: int = 86400) -> DataFrame:
    """Row number, running sum of ``value_col`` and row count per session in (ts, msg_id) order.

    Two levels, so no task holds a whole session: windows per ``(session, chunk)``,
    then offsets from a window over one row per chunk, joined back on
    ``(session, chunk)`` (the rows' own partitioning).  Adds ``_rn`` (1-based),
    ``_n`` (session size) and, with ``value_col``, ``_run`` (running sum).
    """
    d = df.withColumn("_c", F.floor(F.col("ts") / chunk_seconds))
    wl = Window.partitionBy("session_id", "_c").orderBy("ts", "msg_id")
    d = d.withColumn("_lrn", F.row_number().over(wl))
    aggs = [F.count(F.lit(1)).alias("_cn")]
    if value_col:
        d = d.withColumn("_lsum", F.sum(value_col).over(wl.rowsBetween(Window.unboundedPreceding, 0)))
        aggs.append(F.coalesce(F.sum(value_col), F.lit(0)).alias("_cs"))
    per = d.groupBy("session_id", "_c").agg(*aggs)
    wc = Window.partitionBy("session_id").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("_nb", F.coalesce(F.sum("_cn").over(wc), F.lit(0)))
           .withColumn("_n", F.sum("_cn").over(Window.partitionBy("session_id"))))
    keep = ["session_id", "_c", "_nb", "_n"]
    if value_col:
        per = per.withColumn("_sb", F.coalesce(F.sum("_cs").over(wc), F.lit(0)))
        keep.append("_sb")
    out = d.join(per.select(*keep), ["session_id", "_c"])
    out = out.withColumn("_rn", F.col("_nb") + F.col("_lrn"))
    if value_col:
        out = out.withColumn("_run", F.col("_sb") + F.col("_lsum"))
    return out.drop("_c", "_lrn", "_nb", "_lsum", "_sb")


CHUNK_SECONDS = 86400    # time chunk for the two-level (hot-session safe) segmentation


def _segment_frame(messages: DataFrame, ttl: int, chunk_seconds: int, limit: int | None = None) -> DataFrame:
    """TTL segments with position, size and end of every message's segment, hot-session safe.

    A two-level prefix computation instead of one window over a whole session:

    1. rows are windowed per ``(session, chunk)`` (``chunk = ts // chunk_seconds``):
       local segment index ``_k`` (idle gaps >= ttl inside the chunk) and local position;
    2. one row per ``(session, chunk, _k)`` (a partial aggregate) and one per
       ``(session, chunk)`` carry sizes and first/last times;
    3. windows over those small summaries decide whether a chunk's first row opens a
       segment (gap to the previous chunk's last row), number the segments, and carry
       row offsets and sizes of segments that span chunks;
    4. rows join their summary back on ``(session, chunk, _k)``.

    A session with a third of all messages is spread over its chunks in steps 1 and
    4; steps 2-3 see one row per chunk / local segment.
    """
    m = messages.withColumn("_c", F.floor(F.col("ts") / chunk_seconds))
    wl = Window.partitionBy("session_id", "_c").orderBy("ts", "msg_id")
    prev = F.lag("ts").over(wl)
    m = m.withColumn("_lflag", F.when(prev.isNotNull() & (F.col("ts") - prev >= ttl), 1).otherwise(0))
    m = m.withColumn("_k", F.sum("_lflag").over(wl.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("_lpos", F.row_number().over(
        Window.partitionBy("session_id", "_c", "_k").orderBy("ts", "msg_id")))
    local = m.groupBy("session_id", "_c", "_k").agg(
        F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_min"), F.max("ts").alias("_max"))
    chunks = local.groupBy("session_id", "_c").agg(
        F.min("_min").alias("_first"), F.max("_max").alias("_last"), F.max("_k").alias("_nflags"))
    wc = Window.partitionBy("session_id").orderBy("_c")
    prev_last = F.lag("_last").over(wc)
    chunks = chunks.withColumn("_b", F.when(prev_last.isNull() | (F.col("_first") - prev_last >= ttl), 1)
                               .otherwise(0))
    chunks = chunks.withColumn("_before", F.coalesce(
        F.sum(F.col("_b") + F.col("_nflags")).over(wc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    seg = (local.join(chunks.select("session_id", "_c", "_b", "_before"), ["session_id", "_c"])
           .withColumn("seg_no", (F.col("_before") + F.col("_b") + F.col("_k")).cast("int")))
    ws = Window.partitionBy("session_id", "seg_no")
    seg = (seg.withColumn("_prev_rows", F.coalesce(F.sum("_n").over(
               ws.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("seg_size", F.sum("_n").over(ws))
           .withColumn("seg_last_ts", F.max("_max").over(ws))
           .withColumn("_last_seg", F.max("seg_no").over(Window.partitionBy("session_id"))))
    info = [F.col("seg_no"), F.col("_prev_rows"), F.col("seg_size"), F.col("seg_last_ts"), F.col("_last_seg")]
    if limit is not None:
        # archived messages of all earlier segments of the session (archive rank offset):
        # each segment counts once (on its first chunk row), summed over lower seg_no
        step = limit + 1 - limit // 2
        n = F.col("seg_size")
        archived = F.when(n <= limit, F.lit(0)).otherwise((F.floor((n - (limit + 1)) / step) + 1) * step)
        seg = seg.withColumn("_arch", F.when(F.col("_prev_rows") == 0, archived).otherwise(0).cast("bigint"))
        seg = seg.withColumn("_arch_before", F.coalesce(F.sum("_arch").over(
            Window.partitionBy("session_id").orderBy("seg_no").rangeBetween(Window.unboundedPreceding, -1)),
            F.lit(0)))
        info.append(F.col("_arch_before"))
    # one row per (session, chunk) holding its local segments in _k order: the join
    # back is keyed like the rows' own partitioning, so the rows are not shuffled again
    per_chunk = seg.groupBy("session_id", "_c").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_k"), *info))).alias("_segs"))
    out = m.join(per_chunk, ["session_id", "_c"])
    out = out.withColumn("_s", F.element_at(F.col("_segs"), (F.col("_k") + 1).cast("int")))
    cols = ["seg_no", "seg_size", "seg_last_ts", "_last_seg"] + (["_arch_before"] if limit is not None else [])
    out = out.select("*", *[F.col(f"_s.{c}").alias(c) for c in cols],
                     (F.col("_s._prev_rows") + F.col("_lpos")).cast("int").alias("pos"))
    return out.drop("_c", "_k", "_lflag", "_lpos", "_segs", "_s")


def ttl_segments(messages: DataFrame, ttl: int = TTL_SECONDS, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """#34: cut each session where the idle gap reaches ``ttl`` (>=, key expiry semantics).

    Adds ``seg_no`` (1-based per session); see ``_segment_frame`` for the plan.
    """
    return (_segment_frame(messages, ttl, chunk_seconds)
            .drop("pos", "seg_size", "seg_last_ts", "_last_seg"))


def message_disposition(messages: DataFrame, as_of: int, limit: int = BUFFER_LIMIT,
                        ttl: int = TTL_SECONDS, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """#33: per message ``archived`` (with its eviction turn), ``in_buffer`` or ``expired``.

    Pure arithmetic on (position, segment size) from ``_segment_frame``; also
    ``arank`` (the message's rank in the session's archive) for archived messages.
    """
    keep = limit // 2
    step = limit + 1 - keep
    d = _segment_frame(messages, ttl, chunk_seconds, limit=limit)
    batch = F.floor((F.col("pos") - 1) / step) + 1
    evict_at = (limit + 1) + (batch - 1) * step
    archived = evict_at <= F.col("seg_size")
    alive = (F.col("seg_no") == F.col("_last_seg")) & (F.lit(as_of) - F.col("seg_last_ts") < ttl)
    return (d.withColumn("eviction_turn", F.when(archived, evict_at.cast("int")))
            .withColumn("disposition", F.when(archived, F.lit("archived"))
                        .when(alive, F.lit("in_buffer")).otherwise(F.lit("expired")))
            .withColumn("is_eviction", (F.col("pos") >= limit + 1) & ((F.col("pos") - (limit + 1)) % step == 0))
            .withColumn("arank", F.when(archived, F.col("_arch_before") + F.col("pos")))
            .withColumnRenamed("_arch_before", "archived_before")
            .drop("_last_seg"))


#: Positions of a segment that are framed together.
FRAME_ROWS = 512


def rolling_frame(messages: DataFrame, item_cols, n: int = SHORT_MEMORY, ttl: int = TTL_SECONDS,
                  chunk_seconds: int = CHUNK_SECONDS, out_col: str = "short_memory", gather: Column | None = None) -> DataFrame:
    """For every message, ``item_cols`` of the up-to-``n`` messages ending at it inside its TTL segment.

    ``gather``: an aggregate over these messages that takes the place of their list.

    Hot-session safe: a segment is cut by row count into chunks of ``FRAME_ROWS`` positions (positions come from
    the two-level segmentation), and a row among the last ``n - 1`` of a chunk is also sent to the next one.  So
    each chunk holds every frame that ends in it, a window over the chunk is the whole work, and no
    key has more rows than a chunk and its halo.  Output rows also carry ``seg_no``.
    """
    size = max(FRAME_ROWS, n)
    at = F.floor((F.col("pos") - 1) / size)
    shared = ((F.col("pos") - 1) % size >= size - (n - 1)) & ((at + 1) * size < F.col("seg_size"))
    seg = (_segment_frame(messages, ttl, chunk_seconds).drop("seg_last_ts", "_last_seg")
           .withColumn("_own", at).withColumn("_c", F.explode(F.when(shared, F.array(at, at + 1)).otherwise(F.array(at)))))
    frame = Window.partitionBy("session_id", "seg_no", "_c").orderBy("pos").rowsBetween(-(n - 1), 0)
    gather = F.collect_list(F.struct(*item_cols)) if gather is None else gather
    return (seg.withColumn(out_col, gather.over(frame)).where(F.col("_c") == F.col("_own"))
            .drop("_c", "_own", "pos", "seg_size"))


def rolling_short_memory(messages: DataFrame, n: int = SHORT_MEMORY, ttl: int = TTL_SECONDS,
                         chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """#36: for every message, the up-to-``n`` messages ending at it inside its TTL segment."""
    return rolling_frame(messages, ["ts", "msg_id", "role", "content", "tokens"], n, ttl, chunk_seconds)


def last_n_messages(messages: DataFrame, n: int = SHORT_MEMORY) -> DataFrame:
    """#13: newest ``n`` per session, numbered oldest first; ``n <= 0`` keeps everything.

    ``row_number() <= n`` plans as WindowGroupLimit, which trims each session to
    ``n`` rows inside every map task before the shuffle.
    """
    if n <= 0:
        return (chunked_prefix(messages).withColumn("position", F.col("_rn").cast("int"))
                .drop("_rn", "_n"))
    wd = Window.partitionBy("session_id").orderBy(F.col("ts").desc(), F.col("msg_id").desc())
    kept = messages.withColumn("_rn", F.row_number().over(wd)).where(F.col("_rn") <= n)
    # position counted from the oldest kept message: size of the kept set minus rank + 1
    wc = Window.partitionBy("session_id")
    return (kept.withColumn("position", (F.count(F.lit(1)).over(wc) - F.col("_rn") + 1).cast("int"))
            .drop("_rn"))


def message_slice(messages: DataFrame, start: int = 0, end: int = -1) -> DataFrame:
    """#14: inclusive 0-based range per session; negative bounds count from the end, clipped."""
    d = chunked_prefix(messages).withColumn("idx", (F.col("_rn") - 1).cast("int")).drop("_rn")
    s = F.lit(start) if start >= 0 else F.col("_n") + start
    e = F.lit(end) if end >= 0 else F.col("_n") + end
    s = F.greatest(s, F.lit(0))
    e = F.least(e, F.col("_n") - 1)
    return d.where((F.col("idx") >= s) & (F.col("idx") <= e)).drop("_n")


def retention_keep_last_n(archived: DataFrame, keep: int = RETENTION_KEEP) -> DataFrame:
    """#35: mark archived messages beyond the newest ``keep`` per session for deletion.

    With the archive rank ``arank`` (from ``message_disposition``) a message is kept
    iff ``arank > total - keep``; the per-session total is a partial aggregate joined
    back on ``session_id`` (one row per session on that side, so AQE can split a hot
    session's rows).  Without ``arank`` it falls back to a descending ``row_number``.
    """
    if "arank" not in archived.columns:
        wd = Window.partitionBy("session_id").orderBy(F.col("ts").desc(), F.col("msg_id").desc())
        return archived.withColumn("keep", F.row_number().over(wd) <= keep)
    totals = archived.groupBy("session_id").agg(F.max("arank").alias("_total"))
    return (archived.join(totals, "session_id")
            .withColumn("keep", F.col("arank") > F.col("_total") - keep).drop("_total"))


def summary_trigger_points(disposition: DataFrame, limit: int = BUFFER_LIMIT,
                           every: int = SUMMARY_EVERY) -> DataFrame:
    """#37: evictions at which the session's cumulative archived count crosses a multiple of ``every``.

    The b-th eviction of a segment (at position M + 1 + (b - 1) S) brings the
    session's archive to ``archived_before + b * S``: arithmetic per eviction row,
    no window over the session.
    """
    step = limit + 1 - limit // 2
    ev = disposition.where(F.col("is_eviction"))
    b = F.floor((F.col("pos") - (limit + 1)) / step) + 1
    ev = ev.select("session_id", "msg_id", "ts",
                   (F.col("archived_before") + b * step).cast("bigint").alias("archived_total"))
    crossed = F.floor(F.col("archived_total") / every) > F.floor((F.col("archived_total") - step) / every)
    return ev.where(crossed)


def summary_input(disposition: DataFrame, triggers: DataFrame, n: int = SUMMARY_INPUT) -> DataFrame:
    """#38: for each trigger, the last ``n`` archived messages (time order) up to it.

    Archived messages carry their archive rank r per session (``arank`` from
    ``message_disposition``, computed from segment-level counts); a trigger at total c
    reads ranks (c - n, c].  Both sides are keyed by ``(session_id, bucket)`` with
    bucket = floor((r - 1) / n); a trigger touches at most two buckets, so the join
    is an equi-join with a fan-out of two and no hot key even for a huge session.
    """
    arch = disposition.where(F.col("disposition") == "archived")
    arch = arch.withColumn("bucket", F.floor((F.col("arank") - 1) / n))
    trig = triggers.select("session_id", F.col("msg_id").alias("trigger_msg_id"), "archived_total")
    hi_b = F.floor((F.col("archived_total") - 1) / n)
    trig = trig.withColumn("bucket", F.explode(F.array_distinct(F.array(
        F.greatest(hi_b - 1, F.lit(0)), hi_b))))
    j = trig.join(arch, ["session_id", "bucket"])
    j = j.where((F.col("arank") > F.col("archived_total") - n) & (F.col("arank") <= F.col("archived_total")))
    carried = [c for c in ("ts", "msg_id", "role", "content") if c in disposition.columns]
    return (j.groupBy("session_id", "trigger_msg_id", "archived_total")
            .agg(F.array_sort(F.collect_list(F.struct(*carried))).alias("messages")))


def messages_per_session(disposition: DataFrame) -> DataFrame:
    """#26: archived message count per session."""
    return disposition.groupBy("session_id").agg(
        F.count(F.when(F.col("disposition") == "archived", 1)).alias("archived_count"))


def buffer_tokens(disposition: DataFrame) -> DataFrame:
    """#27: sum of token counts of the messages still in the buffer, per session."""
    return disposition.groupBy("session_id").agg(
        F.coalesce(F.sum(F.when(F.col("disposition") == "in_buffer", F.col("tokens"))), F.lit(0))
        .cast("bigint").alias("buffer_tokens"),
        F.count(F.when(F.col("disposition") == "in_buffer", 1)).alias("buffer_messages"))


def transcript_text(messages: DataFrame, n: int = SUMMARY_INPUT, numbered: bool = False) -> DataFrame:
    """#31: the newest ``n`` messages of a session as text, oldest first.

    Lines are ``role: content``, or ``i. [role]: content`` when ``numbered``;
    a missing role prints as ``unknown``.  Groups are capped at ``n`` before the
    ``collect_list`` (the reference reads the last 50 / last 20 messages).
    """
    kept = last_n_messages(messages, n)
    role = F.coalesce(F.col("role"), F.lit("unknown"))
    content = F.coalesce(F.col("content"), F.lit(""))
    if numbered:
        line = F.concat(F.col("position").cast("string"), F.lit(". ["), role, F.lit("]: "), content)
    else:
        line = F.concat(role, F.lit(": "), content)
    g = kept.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("position"), line.alias("line")))).alias("_lines"))
    return g.select("session_id", F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("transcript"),
                    F.size("_lines").alias("n_messages"))


def active_sessions(messages: DataFrame, as_of: int, ttl: int = TTL_SECONDS,
                    chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """#40: sessions whose buffer key is alive at ``as_of``: remaining TTL and size of the live segment.

    Every row carries its segment's size and end and the session's last segment
    number (from the two-level segmentation), so this is a filter and a per-session
    aggregate - no window over a whole session.
    """
    seg = _segment_frame(messages, ttl, chunk_seconds)
    last = (seg.where(F.col("seg_no") == F.col("_last_seg"))
            .groupBy("session_id").agg(F.max("seg_last_ts").alias("last_ts"),
                                       F.max("seg_size").alias("message_count")))
    return (last.withColumn("remaining_ttl", F.col("last_ts") + ttl - F.lit(as_of))
            .where(F.col("remaining_ttl") > 0)
            .select("session_id", "remaining_ttl", "message_count"))


def token_counter(updates: DataFrame) -> DataFrame:
    """#29: running total of signed increments per session, in (ts, id) order (two-level prefix sum)."""
    return (chunked_prefix(updates, "increment").withColumn("running_total", F.col("_run").cast("bigint"))
            .drop("_rn", "_n", "_run"))


# Context fields of a session context record.
CONTEXT_FIELDS = ["current_goal", "extracted_entities", "last_tool_used", "user_mood"]


def context_state(updates: DataFrame, fields=CONTEXT_FIELDS) -> DataFrame:
    """#28: latest value per context field (last write by (ts, id) wins), token total, first/last update.

    ``updates`` rows are ``(session_id, msg_id, ts, field, value, increment)``.  One
    aggregate per session with a fixed field list (a pivot written as filtered
    ``max_by``), so partial aggregation runs map-side and a hot session costs one
    row per map task in the shuffle.  Token total defaults to 0.
    """
    order = F.struct("ts", "msg_id")
    aggs = [F.max_by(F.col("value"), F.when(F.col("field") == f, order)).alias(f) for f in fields]
    return updates.groupBy("session_id").agg(
        *aggs,
        F.coalesce(F.sum("increment"), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
