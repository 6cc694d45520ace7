"""Stream = batch: the session buffer over several micro-batches equals the closed form."""

import tempfile
import time

from pyspark.sql import functions as F

from parlance.operators import memory as M
from parlance.sources import bindings as B
from parlance.sources.tables import read_table
from parlance.streaming import session_buffer as SB

from conftest import SF_SMALL


def test_stream_buffer_equals_batch_over_micro_batches(spark):
    ev = read_table(spark, SF_SMALL, "events")
    src = tempfile.mkdtemp(prefix="parlance-stream-src-")
    # four files written one after another in time order -> four micro-batches in that
    # order (the file source follows modification time); timers fire as the watermark advances
    cuts = ["2024-01-08", "2024-01-15", "2024-01-22"]
    bounds = [None] + cuts + [None]
    for i in range(4):
        part = ev
        if bounds[i]:
            part = part.where(F.col("ts") >= F.lit(bounds[i]).cast("timestamp_ntz"))
        if bounds[i + 1]:
            part = part.where(F.col("ts") < F.lit(bounds[i + 1]).cast("timestamp_ntz"))
        part.coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src))
    limit, ttl = 6, 3 * 86400
    out = SB.run_available_now(SB.stream_session_buffer(SB.events_as_messages(stream), limit=limit, ttl=ttl), "buffer",
                               checkpoint_root=tempfile.mkdtemp(prefix="parlance-ckpt-"))
    batch = M.message_disposition(B.messages_long(spark, SF_SMALL), 10**12, limit=limit, ttl=ttl)
    s_arch = {(r.msg_id, r.eviction_turn) for r in out.where("disposition = 'archived'").collect()}
    b_arch = {(r.msg_id, r.eviction_turn) for r in batch.where("disposition = 'archived'").collect()}
    assert s_arch == b_arch
    s_exp = {r.msg_id for r in out.where("disposition = 'expired'").collect()}
    b_exp = {r.msg_id for r in batch.where("disposition = 'expired'").collect()}
    assert s_exp <= b_exp and len(s_exp) > 0   # open last segments stay in state
    trig = M.summary_trigger_points(batch, limit=limit).select("msg_id").collect()
    s_trig = {r.msg_id for r in out.where("disposition = 'summary_trigger'").collect()}
    assert s_trig == {r.msg_id for r in trig}


def test_a_query_started_again_resumes_and_adds_what_is_new(spark):
    ev = read_table(spark, SF_SMALL, "events").select("event_id", "user_id")
    src, root = tempfile.mkdtemp(prefix="parlance-stream-src-"), tempfile.mkdtemp(prefix="parlance-ckpt-")

    def run():
        stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
        return SB.run_available_now(stream, "again", checkpoint_root=root)

    ev.where("event_id % 2 = 0").coalesce(1).write.mode("append").parquet(src)
    assert run().count() == ev.where("event_id % 2 = 0").count()
    ev.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(src)
    out = run()
    assert out.count() == ev.count() and out.distinct().count() == ev.count()


def test_registered_query_sees_a_replaced_file_and_a_folder_table(spark, tmp_path):
    """A lasting checkpoint folder holds the first file's rows; another file of its name is another source."""
    import shutil

    from parlance.plans import streaming_queries as SQ
    from parlance.sources.tables import read_table
    events = read_table(spark, SF_SMALL, "events")
    src, parts = tmp_path / "src", tmp_path / "parts"
    src.mkdir()
    want = []
    for i, rows in enumerate((events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1 and event_id % 3 = 0"))):
        rows.coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        shutil.copyfile(next((tmp_path / f"w{i}").glob("part-*.parquet")), src / "events.parquet")
        want.append({r.event_id for r in rows.collect()})
        got = [r.event_id for r in SQ.message_stream(spark, str(src)).collect()]
        assert sorted(got) == sorted(want[-1])
        again = [r.event_id for r in SQ.message_stream(spark, str(src)).collect()]
        assert sorted(again) == sorted(got)
    assert want[0] and want[1] and want[0] != want[1]
    events.repartition(3).write.parquet(str(parts / "events.parquet"))
    assert SQ.message_stream(spark, str(parts)).count() == events.count()
