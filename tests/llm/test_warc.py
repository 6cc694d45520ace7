"""Fixity audit: known damage is located, trees agree with a brute-force Merkle tree."""

import hashlib
from collections import defaultdict

from parlance.llm import warc as W
from parlance.llm.queries import damaged
from parlance.sources.tables import read_table

from conftest import SF_SMALL

SCHEMA = "page_id long, url string, html string"


def audit(spark, one, two):
    a, b = (W.records(spark.createDataFrame(x, SCHEMA).repartition(3)) for x in (one, two))
    return W.audit(a, b).collect()


def pages(n=2500):
    return [(i, f"http://h/{i % 9}", f"<p>{i % 70}</p>" * (i % 5)) for i in range(n)]


def record(url, html):
    body = (html or "").encode()
    return (f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\n"
            f"Content-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


def test_manifest_offsets_and_digests(spark):
    files = defaultdict(list)
    for r in audit(spark, pages(), pages()):
        files[r.file].append(r)
    assert set(files) == {0, 1, 2}
    data = {i: record(u, h) for i, u, h in pages()}
    for own in files.values():
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r.page_id)):
            assert (r.ordinal, r.offset, r.length, r.status) == (k, at, len(data[r.page_id]), "ok")
            assert r.sha256 == hashlib.sha256(data[r.page_id]).hexdigest()
            at += r.length


def test_damage_is_located(spark):
    one, two = pages(), pages()
    two[17] = (17, two[17][1], "changed")
    two[1999] = (1999, "http://other", two[1999][2])
    two[0] = (0, None, two[0][2])
    lost = {5, 1000, 2499}
    out = audit(spark, one, [x for x in two if x[0] not in lost])
    assert {r.page_id: r.status for r in out if r.status != "ok"} == {
        17: "corrupt", 1999: "corrupt", 0: "corrupt", **{i: "missing" for i in lost}}
    assert len(out) == len(one)


def test_tree_equals_brute_force(spark):
    rows = spark.createDataFrame([(1, i, f"d{i}") for i in range(300)] + [(2, 0, None)],
                                 "file long, ordinal int, sha string")
    levels = W.tree(rows, 3)
    level = [f"d{i}" for i in range(300)]
    for nodes in levels[1:]:
        level = [hashlib.sha256("".join(level[i:i + 16]).encode()).hexdigest() for i in range(0, len(level), 16)]
        assert [r.sha for r in nodes.filter("file = 1").orderBy("node").collect()] == level
    assert levels[0].filter("file = 2").first().sha == "missing"


def test_nulls_repeats_and_few_pages(spark):
    one = [(None, "u", "a"), (None, "u", "a"), (None, None, None), (3, "x", "same"), (3, "x", "same"), (4, None, None)]
    out = audit(spark, one, one)
    assert len(out) == 6 and all(r.status == "ok" for r in out)
    out = audit(spark, one, [x for x in one if x[0] != 4][1:])
    assert sorted(r.status for r in out).count("missing") == 2
    assert audit(spark, [], []) == [] and audit(spark, [], one) == []


def test_query_damage_over_the_pages_table(spark):
    table = read_table(spark, SF_SMALL, "pages")
    out = W.audit(W.records(table), W.records(damaged(table))).collect()
    assert len(out) == table.count()
    want = {0: "missing", 1: "corrupt"}
    assert all(r.status == want.get(r.page_id % 97, "ok") for r in out)


def compare(spark, one, two):
    """``two`` has a fourth column: where the replica holds the record."""
    a = W.records(spark.createDataFrame(one, SCHEMA).repartition(3))
    b = W.records(spark.createDataFrame(two, SCHEMA + ", place long").repartition(3), position_col="place")
    return W.compare(a, b).collect()


def placed(rows):
    return [(*r, i) for i, r in enumerate(rows)]


def test_extra_records_are_found(spark):
    one = pages()
    two = [*one[:30], (29, "http://h/2", "inserted"), *one[30:1500], one[1499], *one[1500:], (9000, "u", "own file")]
    out = compare(spark, one, placed(two))
    assert sorted((r.page_id, r.file, r.ordinal) for r in out if r.status == "extra") == [
        (29, 0, 30), (1499, 1, 500), (9000, 9, 0)]
    assert all(r.status in ("ok", "extra") for r in out) and len(out) == len(one) + 3
    assert [r.status for r in compare(spark, [], placed(one[:3]))] == ["extra"] * 3


def test_moved_records_are_found(spark):
    one = pages()
    two = list(one)
    two[40], two[41] = two[41], two[40]
    two[1100], two[1900] = two[1900], two[1100]
    two.insert(2400, two.pop(2100))
    out = compare(spark, one, placed(two))
    assert {r.page_id for r in out if r.status == "moved"} == {40, 41, 1100, 1900, 2100}
    assert all(r.status in ("ok", "moved") for r in out) and len(out) == len(one)


def test_move_across_equal_leaves_behind_an_insertion(spark):
    """Lengths are equal, so the leaves between are equal and are not reached."""
    one = [(i, "u", f"<{i:03}>") for i in range(60)]
    two = [*one[:5], (7, "u", "<new>"), *one[6:50], one[5], *one[51:], one[50]]
    got = {(r.page_id, r.status) for r in compare(spark, one, placed(two)) if r.status != "ok"}
    assert got == {(5, "moved"), (7, "extra"), (50, "moved")}


def test_all_kinds_of_damage_together(spark):
    one = pages()
    two = [(*r, 10 * i) for i, r in enumerate(one) if i % 97 != 0]
    two = [(i, u, "changed" if i % 97 == 1 else h, p + (10_000 if i in (3, 1003) else 0)) for i, u, h, p in two]
    two = [(i, u, h, 5000 if i == 3 else 15_000 if i == 1003 else p) for i, u, h, p in two]
    two += [(i, "http://extra", "x", 10 * i + 5) for i in range(50, 2500, 200)]
    out = compare(spark, one, two)
    want = {i: "missing" if i % 97 == 0 else "corrupt" if i % 97 == 1 else "moved" if i in (3, 1003) else "ok" for i in range(2500)}
    assert {r.page_id: r.status for r in out if r.status != "extra"} == want
    assert sorted(r.page_id for r in out if r.status == "extra") == list(range(50, 2500, 200))


def test_leaves_cover_offset_and_length(spark):
    rows = [(1, 0, 0, 5, "a"), (1, 0, 1, 5, "a"), (1, 0, 0, 6, "a")]
    frame = spark.createDataFrame(rows, "file long, ordinal int, offset long, length long, sha string")
    assert len({r.sha for r in W.leaves(frame).collect()}) == 3


def test_only_reached_leaves_are_paired(spark):
    one = pages()
    two = list(one)
    two[1234] = (1234, two[1234][1], two[1234][2].replace("p", "q"))
    a, b, c = (W.manifest(W.records(spark.createDataFrame(x, SCHEMA))) for x in (one, two, one))
    at = W.reached(a, b)
    assert [(r.file, r.node, r.before) for r in at.collect()] == [(1, 234, 234)]
    assert [(r.page_id, r.here.ordinal, r.there.ordinal) for r in W.paired(a, b, at).collect()] == [(1234, 234, 234)]
    assert W.reached(a, c).isEmpty()
