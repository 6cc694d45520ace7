"""Deletes along declared foreign keys against a row-by-row model."""

import pytest
from pyspark.sql import functions as F

from parlance.operators import cascade as C

KEYS = [C.ForeignKey("b", "a_id", "a"), C.ForeignKey("c", "b_id", "b"), C.ForeignKey("c", "a_id", "a", C.SET_NULL),
        C.ForeignKey("d", "c_id", "c"), C.ForeignKey("d", "b_id", "b", C.SET_NULL)]


def model(tables, doomed, keys):
    """Delete one row after another, following every key, as a database would."""
    gone = {t: set(doomed.get(t, ())) for t in tables}
    rows = {t: [dict(r) for r in tables[t]] for t in tables}
    while True:
        more = {(k.child, r["id"]) for k in keys if k.on_delete == C.CASCADE for r in rows[k.child]
                if r[k.column] in gone[k.parent] and r["id"] not in gone[k.child]}
        if not more:
            break
        for t, i in more:
            gone[t].add(i)
    for k in keys:
        if k.on_delete == C.SET_NULL:
            for r in rows[k.child]:
                if r[k.column] in gone[k.parent]:
                    r[k.column] = None
    return {t: sorted((tuple(map(str, r.values())), r["id"] in gone[t]) for r in rows[t]) for t in tables}


TABLES = {
    "a": [{"id": i} for i in range(6)],
    "b": [{"id": i, "a_id": None if i == 9 else i % 7} for i in range(12)],
    "c": [{"id": i, "b_id": i % 13, "a_id": i % 5 if i % 4 else None} for i in range(40)],
    "d": [{"id": i, "c_id": i % 41, "b_id": i % 12} for i in range(90)],
    "free": [{"id": 1}, {"id": 2}],
}


def frames(spark):
    return {t: spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} long" for c in rows[0]))
            for t, rows in TABLES.items()}


def test_delete_order():
    assert C.delete_order(KEYS) == ["a", "b", "c", "d"]
    order = C.delete_order(C.FOREIGN_KEYS)
    assert all(order.index(k.parent) < order.index(k.child) for k in C.FOREIGN_KEYS)
    with pytest.raises(ValueError, match="circle"):
        C.delete_order([*KEYS, C.ForeignKey("a", "d_id", "d")])


@pytest.mark.parametrize("doomed", [{"a": [1]}, {"a": [0, 2], "c": [3, 17], "free": [2]}, {"d": [5]}, {"a": list(range(6))}, {}])
def test_rows_equal_a_row_by_row_delete(spark, doomed):
    tables = frames(spark)
    keys = {t: spark.createDataFrame([(i,) for i in [*ids, ids[0], None]], "key long") for t, ids in doomed.items()}
    out = C.cascade(tables, keys, KEYS)
    got = {t: sorted((tuple(map(str, r[:-1])), r[-1]) for r in map(tuple, out[t].collect())) for t in out}
    assert got == model(TABLES, doomed, KEYS)
    for t in tables:
        assert out[t].columns == [*tables[t].columns, "_gone"]


def test_nothing_is_orphaned_by_the_delete(spark):
    tables = frames(spark)
    before = {(r.fk, r.child_key) for r in C.orphans(tables, KEYS).collect()}
    after = {(r.fk, r.child_key) for r in C.orphans(C.kept(C.cascade(
        tables, {"a": spark.createDataFrame([(1,), (2,)], "key long")}, KEYS)), KEYS).collect()}
    assert after <= before and before == {("b.a_id", "6"), ("c.b_id", "12"), ("d.c_id", "40")}
    broken = {t: rows.where("id <> 1") if t == "a" else rows for t, rows in tables.items()}
    assert ("b.a_id", "1") in {(r.fk, r.child_key) for r in C.orphans(broken, KEYS).collect()}


def test_tables_without_their_parent_are_left_alone(spark):
    tables = {"c": frames(spark)["c"]}
    out = C.cascade(tables, {"c": spark.createDataFrame([(3,)], "key long")}, KEYS)
    assert {r.id for r in out["c"].where(F.col("_gone")).collect()} == {3}
