"""Shards: counts at most one apart, slots gapless, every shard near the mixture."""

import zlib
from collections import Counter

from parlance.llm import sharding as S


def rows(n=3000):
    return [(i, None if i % 50 == 0 else f"t{i % 700}", None if i % 11 == 0 else ("hot" if i % 3 else f"s{i % 7}"))
            for i in range(n)]


def test_law_slots_and_mixture(spark):
    data = rows()
    out = S.shard(spark.createDataFrame(data, "doc_id long, text string, source string").repartition(7)).collect()
    count = Counter(r.shard for r in out)
    assert set(count) == set(range(16)) and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(count[s]))
    by_id = {r.doc_id: r for r in out}
    for i, text, source in data:
        t = (text or "").encode()
        assert by_id[i]["size"] == len(t) + 1 and by_id[i].text_crc32 == zlib.crc32(t) and by_id[i].source == source
    mix = Counter(r.source for r in out)
    part = Counter((r.shard, r.source) for r in out)
    # a cut falls within one turn of the interleaving, of at most a row or two per source
    assert all(abs(part[s, x] - mix[x] / 16) <= len(mix) * max(1, mix[x] / len(out)) for s in range(16) for x in mix)


def test_buckets_do_not_change_the_result(spark, monkeypatch):
    df = spark.createDataFrame(rows(800), "doc_id long, text string, source string")
    want = {(r.doc_id, r.shard, r.slot) for r in S.shard(df).collect()}
    monkeypatch.setattr(S, "LEAST_BITS", 2)
    assert {(r.doc_id, r.shard, r.slot) for r in S.shard(df.repartition(3)).collect()} == want


def test_another_seed_shuffles_anew(spark):
    df = spark.createDataFrame(rows(500), "doc_id long, text string, source string")
    one, two = ({r.doc_id: r.shard for r in S.shard(df, seed=x).collect()} for x in (1, 2))
    assert one != two


def test_nulls_repeats_and_few_rows(spark):
    data = [(None, None, None), (None, None, None), (1, "a", ""), (1, "a", "")]
    out = S.shard(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    assert len(out) == 4 and max(Counter(r.shard for r in out).values()) == 1
    assert sorted(str(r.source) for r in out) == ["", "", "None", "None"]
    assert S.shard(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
