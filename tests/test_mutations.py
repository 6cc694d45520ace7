"""Keyed mutations on hand-written tables."""

import json

from parlance.operators import mutations as X


def test_upsert_sets_null_and_inserts(spark):
    s = spark.createDataFrame([(1, 10, "old"), (2, 20, "keep")], "id long, user_id long, handoff_reason string")
    u = spark.createDataFrame([(1, 5, 1, "x"), (1, 6, 2, None), (3, 1, 3, "new")],
                              "id long, ts long, msg_id long, handoff_reason string")
    got = {r.id: (r.handoff_reason, r.was_inserted, r.touched) for r in X.upsert_handoff_reason(s, u).collect()}
    assert got == {1: (None, False, True), 2: ("keep", False, False), 3: ("new", True, True)}


def test_update_session_merge_and_errors(spark):
    s = spark.createDataFrame([(1, None, None, '{"a": 1, "n": {"x": 1}}', 0)],
                              "id long, handoff_reason string, current_stage_id long, metadata string, updated_at long")
    u = spark.createDataFrame([(1, 1, 1, "r1", None, '{"a": 2}'), (1, 2, 2, None, 3, '{"n": {"y": 2}, "b": null}'),
                               (9, 1, 3, "zz", None, None)],
                              "id long, ts long, msg_id long, handoff_reason string, current_stage_id long, "
                              "metadata string")
    out, err = X.update_session(s, u, 99)
    r = out.collect()[0]
    assert r.handoff_reason == "r1" and r.current_stage_id == 3 and r.updated_at == 99
    assert json.loads(r.metadata) == {"a": 2, "n": {"y": 2}, "b": None}
    assert [e.id for e in err.collect()] == [9]


def test_cascade_delete(spark):
    shops = spark.createDataFrame([("A",), ("B",)], "id string")
    products = spark.createDataFrame([(1, "A"), (2, "B")], "id long, shop_id string")
    customers = spark.createDataFrame([(1, "A")], "id long, shop_id string")
    stages = spark.createDataFrame([("A", 1, "A/1"), ("B", 1, "B/1")], "shop_id string, step_order int, stage_id string")
    docs = spark.createDataFrame([(10, 1), (11, 2)], "id long, product_id long")
    sessions = spark.createDataFrame([(1, "A/1"), (2, "B/1"), (3, None)], "id long, current_stage_id string")
    messages = spark.createDataFrame([(1, 1), (3, 2)], "session_id long, msg_id long")
    t = X.cascade_delete(shops, products, customers, stages, docs, sessions, messages,
                         shops.where("id = 'A'"), sessions.where("id = 3"))
    assert [r.id for r in t["products"].collect()] == [2]
    assert [r.id for r in t["documents"].collect()] == [11]
    assert t["customers"].count() == 0
    assert sorted((r.id, r.current_stage_id) for r in t["sessions"].collect()) == [(1, None), (2, "B/1")]
    assert [r.msg_id for r in t["messages"].collect()] == [1]


def test_vector_delete_null_predicate_deletes_nothing(spark):
    v = spark.createDataFrame([(1, None, "d1", "p"), (2, "s", "d2", "p")],
                              "id long, shop_id string, doc_id string, product_id string")
    assert X.vector_delete(v, shop_id="s").count() == 1
    assert X.vector_delete(v, product_id="p", shop_id="s").count() == 1


def test_insert_if_absent_takes_the_least_row_of_a_key(spark):
    old = spark.createDataFrame([(1, 0, "x")], "id long, n int, v string")
    new = spark.createDataFrame([(1, 1, "a"), (2, 9, "b"), (2, 3, "c"), (2, 3, "d")], "id long, n int, v string")
    got = sorted(tuple(r) for r in X.insert_if_absent(old, new, ["id"], ["n"]).collect())
    assert got == [(1, 0, "x"), (2, 3, "c")]


def test_merges_fold_several_rows_of_a_key(spark):
    c = spark.createDataFrame([(1, "N", None, None, '{"a": 1}'), (2, "M", None, None, None)],
                              "customer_id long, full_name string, phone string, email string, preferences string")
    i = spark.createDataFrame([(1, 1, 1, "first", "p1", None, '{"a": 2}'), (1, 2, 2, "", None, "e2", '{"b": 3}'),
                               (2, 1, 3, None, None, "", '{"z": 1}')],
                              "customer_id long, ts long, msg_id long, name string, phone string, email string, "
                              "preferences string")
    out = {r.customer_id: r for r in X.merge_customer_info(c, i).collect()}
    assert len(out) == 2 and X.merge_customer_info(c, i).count() == 2
    assert (out[1].full_name, out[1].phone, out[1].email) == ("first", "p1", "e2")
    assert json.loads(out[1].preferences) == {"a": 2, "b": 3} and out[2].preferences is None
    s = spark.createDataFrame([(1, None, "{}")], "id long, handoff_reason string, metadata string")
    u = spark.createDataFrame([(1, 1, 1, "old", ["t"], []), (1, 2, 2, "new", [], ["k"])],
                              "id long, ts long, msg_id long, summary string, tags array<string>, key_topics array<string>")
    r = X.update_session_summary(s, u).collect()
    assert len(r) == 1 and json.loads(r[0].metadata) == {"summary": "new", "tags": ["t"], "key_topics": ["k"]}
