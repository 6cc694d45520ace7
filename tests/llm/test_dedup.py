"""Exact dedup against brute force, and the directory of the extendible-hash index."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from parlance.llm import dedup as D
from parlance.llm.common import documents

from conftest import SF_SMALL


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, hash string").repartition(5)
    out = D.exact_groups(docs).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert len(out) == len(rows)
    for r in out:
        own = groups[sha[r.text_sha256]]
        ids = [i for i in own if i is not None]
        assert r.group_size == len(own) and r.keep_id == (max(ids) if ids else None)
        assert r.doc_id in own and (not r.kept or r.doc_id == r.keep_id)
    kept = [r.text_sha256 for r in out if r.kept]
    assert sorted(kept) == sorted(sha)
    return out


def test_groups_ties_and_nulls(spark):
    check(spark, [(1, "a"), (2, "a"), (3, "b"), (3, "b"), (4, None), (5, ""), (None, "a"), (None, "only"), (None, "only"),
                  (6, "A"), (7, "a "), (8, "é"), (9, "é"), (-4, "n"), (-3, "n"), (10, "long" * 50_000)])


def test_one_hot_group(spark):
    check(spark, [(i, "copy" if i % 3 else f"text {i}") for i in range(900)])


def test_documents_of_the_driver(spark):
    check(spark, [(r.doc_id, r.text) for r in documents(spark, SF_SMALL, "doc_id", "text").collect()])


def test_directory_splits_overfull_buckets_only(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("hash")).union(
        spark.range(60).select(F.lit(5).cast("long").alias("hash")))
    table = D.directory(keys, capacity=50).collect()
    held = defaultdict(int)
    last = D.deepest(4060, 50)
    where = {r.leaf: (r.depth, r.bucket) for r in table}
    sizes = defaultdict(int)
    for r in keys.select(D._leaf("hash", last).alias("leaf")).collect():
        held[where[r.leaf]] += 1
        sizes[r.leaf] += 1
    for (depth, bucket), n in held.items():
        assert n <= 50 or depth == last
        if depth > D.START_DEPTH:  # with one bit less it would have been overfull
            width = last - depth + 1
            assert sum(m for leaf, m in sizes.items() if leaf >> width == bucket >> width) > 50
    assert any(n > 50 for n in held.values())  # one hash with many rows can't be split


def test_collisions_are_chained_and_told_apart(spark):
    texts = spark.createDataFrame([(1, 9, "a"), (2, 9, "b"), (3, 9, "a"), (4, 9, "cc")], "doc_id long, hash long, text string")
    entries, leaves, last = D.index(texts)
    out = entries.collect()
    assert sorted(r.chain for r in out) == [1, 2, 3]
    assert {(r.keep_id, r.group_size) for r in out} == {(3, 2), (2, 1), (4, 1)}


def test_one_row_of_each_text_stays(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (2, "a", "z"), (3, None, "n"), (None, "q", "r"), (None, "q", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _other string")
    out = D.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text), r._other) for r in out.collect()) == [
        ("2", "a", "y"), ("3", "None", "n"), ("None", "q", "r")]


def test_empty_table_and_plan(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert D.exact_groups(docs).count() == 0 and D.drop_copies(docs).count() == 0
    plan = D.exact_groups(documents(spark, SF_SMALL, "doc_id", "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def keys_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, hash long, text string").select(
        "doc_id", "hash", F.octet_length("text").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha"))


def test_rows_find_their_entry_through_the_directory_and_the_chain(spark):
    """Three texts of one hash; and without a bucket in the directory, or with another one, a row finds nothing."""
    rows = [(1, 9, "a"), (2, 9, "b"), (3, 9, "a"), (4, 9, "cc"), (5, -7 << 50, "d"), (6, 3 << 60, "e")]
    texts = spark.createDataFrame(rows, "doc_id long, hash long, text string")
    entries, leaves, last = D.index(texts, capacity=1)
    keys = keys_of(spark, rows)
    found = {r.doc_id: (r.keep_id, r.group_size) for r in D.looked_up(keys, entries, leaves, last).collect()}
    assert found == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1), 5: (5, 1), 6: (6, 1)}
    gone = leaves.filter(F.col("leaf") != F.shiftrightunsigned(F.lit(9).cast("long"), 64 - last))
    assert {r.doc_id for r in D.looked_up(keys, entries, gone, last).collect()} == {5, 6}
    moved = leaves.withColumn("bucket", F.col("bucket") + 1)
    assert D.looked_up(keys, entries, moved, last).count() == 0


def test_the_directory_doubles_with_the_table():
    assert [D.deepest(n, 10_000) for n in (0, 10_000, 170_000, 10**9, 10**12)] == [8, 8, 9, 21, 31]
    assert D.deepest(10**30, 1) == 62


def test_columns_that_have_no_order_and_clashing_names(spark):
    rows = [(1, "a", {"k": 1}, "p"), (1, "a", {"k": 2}, "q"), (2, "b", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _sha map<string,int>, _turn string")
    out = D.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text, r._sha, r._turn) for r in out.collect()) == [(1, "a", {"k": 1}, "p"), (2, "b", None, None)]
    assert D.drop_copies(docs.select("doc_id", "text")).count() == 2
