"""Streams over several micro-batches and restarts equal the batch operators (#73-#75)."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parlance.operators import memory as M
from parlance.operators import mutations as X
from parlance.operators import scoring as S
from parlance.plans import streaming_queries as SQ
from parlance.sources import bindings as B
from parlance.sources.tables import read_table
from parlance.streaming import archive as SA
from parlance.streaming import context as SC
from parlance.streaming import session_buffer as SB
from parlance.streaming import turns as ST

from conftest import SF_SMALL

CUTS = [None, "2024-01-08", "2024-01-15", "2024-01-22", None]


def parts(spark):
    """The events table in four parts, in time order."""
    ev = read_table(spark, SF_SMALL, "events")
    for low, high in zip(CUTS, CUTS[1:]):
        part = ev.where(F.col("ts") >= F.lit(low).cast("timestamp_ntz")) if low else ev
        yield part.where(F.col("ts") < F.lit(high).cast("timestamp_ntz")) if high else part


def feed(spark, folder, frames, run):
    """Write the parts one by one as files; ``run`` the stream after two of them, and again after all."""
    for i, part in enumerate(frames):
        part.coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)  # files are read in order of modification
        if i == 1:
            run()
    return run()


def source(spark, folder):
    return spark.readStream.schema(read_table(spark, SF_SMALL, "events").schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_contexts_expire_alike_over_micro_batches_and_a_restart(spark, tmp_path):
    ttl = 86400

    def run():
        up = B.context_writes_from(source(spark, tmp_path / "src")).withColumn("event_time", F.timestamp_seconds("ts"))
        return SB.run_available_now(SC.stream_context_expiry(up, ttl), "contexts", str(tmp_path / "ckpt"))

    emitted = feed(spark, tmp_path / "src", list(parts(spark)), run)
    want = SC.context_segments(B.context_writes_from(read_table(spark, SF_SMALL, "events")), ttl)
    got = SC.latest_contexts(emitted).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    rows = want.collect()
    assert {r.closed for r in rows} == {True, False} and max(r.seg_no for r in rows) > 2
    assert sum(r.bad_numbers for r in rows) > 0 and any(r.error for r in rows) and any(r.extracted_entities for r in rows)
    # a context expires once
    closed = emitted.where("closed").groupBy("session_id", "seg_no").count()
    assert closed.where("count > 1").count() == 0


def test_typed_reads(spark):
    rows = [("a", 1, 0, "current_goal", "x", "5"), ("a", 2, 1, "extracted_entities", '{"k": 1}', " -3 "),
            ("a", 3, 2, "extracted_entities", None, "1.5"), ("b", 4, 0, "extracted_entities", "[1]", None),
            ("b", 5, 3600, "user_mood", "calm", "x"), ("b", 6, 3600, "user_mood", "", "+7"), ("c", 7, 9, "other", "z", "9" * 30)]
    up = spark.createDataFrame(rows, "session_id string, msg_id long, ts long, field string, value string, increment string")
    out = {(r.session_id, r.seg_no): r for r in SC.context_segments(up, 3600).collect()}
    a, b1, b2, c = out["a", 1], out["b", 1], out["b", 2], out["c", 1]
    assert (a.current_goal, a.extracted_entities, a.error, a.total_tokens, a.bad_numbers) == ("x", None, None, 2, 1)
    assert (b1.extracted_entities, b1.error, b1.total_tokens, b1.bad_numbers, b1.closed) == (None, "extracted_entities", 0, 0, True)
    assert (b2.user_mood, b2.extracted_entities, b2.total_tokens, b2.bad_numbers, b2.version) == ("", None, 7, 1, 2)
    assert (c.total_tokens, c.bad_numbers) == (0, 1)


def test_archive_equals_the_batch_rows_after_a_restart_and_a_repeated_batch(spark, tmp_path):
    limit, ttl = 6, 3 * 86400

    def run():
        stream = SA.archiving_stream(SQ.archive_messages(source(spark, tmp_path / "src")), limit, ttl)
        return SA.run_archive(stream, "archive", str(tmp_path / "ckpt"))

    root = feed(spark, tmp_path / "src", list(parts(spark)), run)
    log = SQ.archive_messages(read_table(spark, SF_SMALL, "events"))
    gone = M.message_disposition(log, 10**12, limit=limit, ttl=ttl)
    want = X.archive_rows(gone.where("disposition = 'archived'"))
    rows = lambda df: Counter(map(tuple, df.select("id", "session_id", "role", "content", "token_count", "tool_calls",
                                                    "created_at").collect()))
    archive = SA.read_table(spark, root, "archive")
    assert rows(archive) == rows(want) and archive.where("tool_calls is not null").count() > 0
    triggers = M.summary_trigger_points(gone, limit=limit).select("session_id", "msg_id")
    assert Counter(map(tuple, SA.read_table(spark, root, "triggers").select("session_id", "msg_id").collect())) == Counter(
        map(tuple, triggers.collect()))
    # the sink gets a batch a second time: its rows are replaced, those of the others stay
    numbers = sorted(r[0] for r in spark.read.parquet(f"{root}/archive").select("batch_id").distinct().collect())
    assert len(numbers) > 2
    again = numbers[1]
    by_id = SA.archive_ids(log)
    batch = (spark.read.parquet(f"{root}/archive").where(F.col("batch_id") == again).select("id")
             .join(by_id, "id").withColumn("kind", F.lit("archived")).withColumn("archived_total", F.lit(None).cast("long")))
    rerun = spark.createDataFrame(batch.collect(), batch.schema)
    for _ in range(2):
        SA.write_batch(rerun, again, root)
    assert rows(SA.read_table(spark, root, "archive")) == rows(want)


def test_retention_of_the_streamed_archive(spark, tmp_path):
    rows = SQ.stream_archive(spark, SF_SMALL)
    kept = Counter(r.session_id for r in rows.where("keep").collect())
    whole = Counter(r.session_id for r in rows.collect())
    assert whole and all(kept[s] == min(n, M.RETENTION_KEEP) for s, n in whole.items())


def test_static_sides_are_read_anew_for_every_batch(spark, tmp_path):
    """A profile and a rule that change between two batches hold from the second on."""
    profiles = str(tmp_path / "profiles")

    def put(label):
        (read_table(spark, SF_SMALL, "events").select(F.col("user_id").alias("session_id")).distinct()
         .withColumn("priority_score", F.lit(1)).withColumn("customer_label", F.lit(label)).write.mode("overwrite").parquet(profiles))

    put("first")
    shape = SQ.turn_rules(read_table(spark, SF_SMALL, "events"), spark.read.parquet(profiles)).schema
    turns = list(parts(spark))

    def run():
        return ST.run_batches(source(spark, tmp_path / "src"), "turns",
                              lambda batch: SQ.turn_rules(batch, spark.read.parquet(profiles)), shape, str(tmp_path / "ckpt"))

    turns[0].coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    run()
    put("second")
    turns[1].coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    got = {r.event_id: r.customer_label for r in run().collect()}
    assert got == {**{r.event_id: "first" for r in turns[0].collect()}, **{r.event_id: "second" for r in turns[1].collect()}}


def test_rule_tables(spark, monkeypatch):
    rules = {"intent": S.INTENT_RULES, "emotion": S.EMOTION_RULES, "flag": S.FLAG_RULES}
    rows = ST.rule_rows(spark, **rules)
    back = ST.read_rules(rows)
    assert {k: {label: sorted(t) for label, t in v.items()} for k, v in rules.items()} == back
    assert list(back["intent"]) == list(S.INTENT_RULES)  # ties go to the earlier label
    said = spark.createDataFrame([(1, "I want to buy it, what is the price?"), (2, "zz glorp"), (3, None)], "msg_id long, content string")
    changed = {**back, "intent": {"glorping": ["glorp"]}, "price": {"price": ["glorp"]}}
    got = {r.msg_id: (r.intent_code, r.price_intent) for r in ST.text_rules(said, changed).collect()}
    assert got == {1: ("unknown", False), 2: ("glorping", True), 3: ("unknown", False)}
    monkeypatch.setattr(ST, "MOST_RULES", 3)
    with pytest.raises(ValueError):
        ST.read_rules(rows)
