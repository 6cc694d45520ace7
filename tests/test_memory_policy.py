"""Buffer policy: closed form (Spark) against a step-by-step model of the reference loop."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import memory as M


def stepwise(msgs, limit, ttl, as_of):
    """Apply append / evict / expire one message at a time, as the reference does."""
    out, buf, last, seg = {}, [], None, 0
    for sid, mid, ts in msgs:
        if last is not None and ts - last >= ttl:
            for m in buf:
                out[m] = ("expired", None)
            buf = []
        if last is None or ts - last >= ttl:
            seg += 1
            turn = 0
        turn += 1
        buf.append(mid)
        if len(buf) > limit:
            keep = limit // 2
            ev, buf = (buf[:-keep], buf[-keep:]) if keep else (buf, [])
            for m in ev:
                out[m] = ("archived", turn)
        last = ts
    for m in buf:
        out[m] = ("in_buffer", None) if as_of - last < ttl else ("expired", None)
    return out


def make_log(rng, sessions, ttl):
    rows, mid = [], 0
    for sid in range(sessions):
        ts = 1000
        for _ in range(rng.choice([0, 1, 5, 50, 51, 76, 77, 120, rng.randint(0, 200)])):
            gap = rng.choice([1, 5, 60, ttl - 1, ttl, ttl + 1, 3 * ttl])
            ts += gap
            rows.append((sid, mid, ts))
            mid += 1
    return rows


@pytest.mark.parametrize("limit,chunk", [(50, 86400), (10, 7), (7, 50), (6, 333), (5, 10**9)])
def test_disposition_matches_stepwise(spark, limit, chunk):
    """Chunk sizes from far below to far above the TTL exercise segments spanning chunks."""
    rng = random.Random(limit)
    ttl = 100
    rows = make_log(rng, 12, ttl)
    as_of = max(t for _, _, t in rows) + 50
    df = spark.createDataFrame(rows, "session_id long, msg_id long, ts long")
    res = M.message_disposition(df, as_of, limit=limit, ttl=ttl, chunk_seconds=chunk).collect()
    got = {r.msg_id: (r.disposition, r.eviction_turn) for r in res}
    # archive rank = order of archived messages in the session
    for sid in {r.session_id for r in res}:
        arch = sorted((r.ts, r.msg_id, r.arank) for r in res if r.session_id == sid and r.disposition == "archived")
        assert [a for _, _, a in arch] == list(range(1, len(arch) + 1))
    want = {}
    for sid in sorted({s for s, _, _ in rows}):
        want.update(stepwise([r for r in rows if r[0] == sid], limit, ttl, as_of))
    assert got == want


@pytest.mark.parametrize("chunk", [1, 3600, 86400])
def test_gap_equal_to_ttl_cuts_segment(spark, chunk):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 3600), (1, 3, 3601), (1, 4, 3601)],
                               "session_id long, msg_id long, ts long")
    segs = {r.msg_id: r.seg_no for r in M.ttl_segments(df, 3600, chunk_seconds=chunk).collect()}
    assert segs == {1: 1, 2: 2, 3: 2, 4: 2}


def test_last_n_and_slice(spark):
    rows = [(1, i, i * 10) for i in range(30)] + [(2, 100 + i, i) for i in range(3)]
    df = spark.createDataFrame(rows, "session_id long, msg_id long, ts long")
    kept = M.last_n_messages(df, 20).where("session_id = 1").orderBy("position").collect()
    assert [r.msg_id for r in kept] == list(range(10, 30)) and kept[0].position == 1
    assert M.last_n_messages(df, 0).count() == 33  # N <= 0: no trim
    lst = list(range(30))
    for start, end in [(0, -1), (5, -5), (-3, -1), (-100, 2), (25, 100), (10, 5), (40, 50)]:
        got = [r.msg_id for r in M.message_slice(df, start, end).where("session_id = 1").orderBy("idx").collect()]
        s = start if start >= 0 else max(len(lst) + start, 0)
        e = end if end >= 0 else len(lst) + end
        assert got == lst[s:e + 1], (start, end)


def test_summary_triggers_cross_multiples(spark):
    rows = [(1, i, i) for i in range(400)]
    df = spark.createDataFrame(rows, "session_id long, msg_id long, ts long")
    disp = M.message_disposition(df, 10**9, limit=6, ttl=10**6)
    trig = M.summary_trigger_points(disp, limit=6, every=50).orderBy("ts").collect()
    totals = [r.archived_total for r in trig]
    assert totals == [52, 100, 152, 200, 252, 300, 352]
    inputs = M.summary_input(disp, M.summary_trigger_points(disp, limit=6, every=50)).collect()
    assert all(len(r.messages) == 50 for r in inputs)


def test_rolling_memory_bounded(spark):
    rows = [(1, i, i) for i in range(60)]
    df = spark.createDataFrame(rows, "session_id long, msg_id long, ts long, role string, content string, tokens long"
                               if False else "session_id long, msg_id long, ts long")
    df = df.withColumn("role", F.lit("user")).withColumn("content", F.lit("x")).withColumn("tokens", F.lit(1))
    r = M.rolling_short_memory(df, n=20, ttl=10**6).orderBy("msg_id").collect()
    assert [len(x.short_memory) for x in r][:3] == [1, 2, 3] and max(len(x.short_memory) for x in r) == 20
    assert [m.msg_id for m in r[-1].short_memory] == list(range(40, 60))


@pytest.mark.parametrize("chunk", [3, 25, 10**9])
def test_rolling_memory_across_chunks_matches_model(spark, chunk):
    rng = random.Random(chunk)
    ttl = 40
    rows, mid = [], 0
    for sid in range(5):
        ts = 0
        for _ in range(rng.randint(0, 90)):
            ts += rng.choice([1, 2, 5, 39, 40, 41, 100])
            rows.append((sid, mid, ts, "user", f"m{mid}", 1))
            mid += 1
    df = spark.createDataFrame(rows, "session_id long, msg_id long, ts long, role string, content string, tokens long")
    got = {r.msg_id: [m.msg_id for m in r.short_memory]
           for r in M.rolling_short_memory(df, n=20, ttl=ttl, chunk_seconds=chunk).collect()}
    want = {}
    for sid in range(5):
        seg, last = [], None
        for s_, m, t, *_ in [r for r in rows if r[0] == sid]:
            if last is not None and t - last >= ttl:
                seg = []
            seg.append(m)
            want[m] = seg[-20:]
            last = t
    assert got == want


def test_frames_cross_chunks_of_any_size(spark, monkeypatch):
    """One session holds most rows; frames are cut into chunks smaller and larger than a segment."""
    import random

    rng = random.Random(6)
    rows, ts = [], 0
    for i in range(400):
        ts += rng.choice([0, 1, 30, 30, 4000])
        rows.append((1 if i % 5 else 2, i, ts, "user", f"m{i}", i))
    log = spark.createDataFrame(rows, "session_id long, msg_id long, ts long, role string, content string, tokens long").repartition(4)
    want = {}
    for session in (1, 2):
        segment, last = [], None
        for _, i, t, *_ in sorted((r for r in rows if r[0] == session), key=lambda r: (r[2], r[1])):
            if last is not None and t - last >= 3600:
                segment = []
            segment, last = segment + [i], t
            want[i] = segment[-4:]
    for size in (1, 4, 5, 512):
        monkeypatch.setattr(M, "FRAME_ROWS", size)
        got = {r.msg_id: [m.msg_id for m in r.short_memory] for r in M.rolling_short_memory(log, n=4, ttl=3600).collect()}
        assert got == want
    assert {r.msg_id: len(r.short_memory) for r in M.rolling_short_memory(log, n=1, ttl=3600).collect()} == {i: 1 for i in want}
