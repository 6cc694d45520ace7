"""Every label, flag, list and move of the rule tables occurs in the registered queries."""

from pyspark.sql import functions as F

from parlance.operators import scoring as S
from parlance.plans import branch_queries as BQ
from parlance.sources import bindings as B

from conftest import SF_CHECK


def values(df, column):
    return {r[0] for r in df.select(column).distinct().collect()}


def test_every_intent_emotion_flag_and_risk_occurs(spark):
    intents = BQ.intent_scores_terms(spark, SF_CHECK).cache()
    assert values(intents, "intent_code") == {*S.INTENT_RULES, S.FALLBACK_INTENT}
    assert len(values(intents, "confidence")) > 2
    scored = BQ.emotion_policy_terms(spark, SF_CHECK).cache()
    for name in S.EMOTION_RULES:
        assert scored.where(F.col(name) > 0.7).count() > 0 and scored.where(F.col(name) == 0).count() > 0
    for flag in S.FLAG_RULES:
        assert values(scored, flag) == {True, False}
    assert values(scored, "risk_level") == {"low", "medium", "high"}


def test_every_requirement_and_service_occurs(spark):
    out = BQ.requirement_terms_said(spark, SF_CHECK).cache()
    said = {t for r in out.select("explicit_requirements").distinct().collect() for t in r[0].split(",") if t}
    assert said == set(S.REQUIREMENT_TERMS)
    implied = {t for r in out.select("implicit_requirements").distinct().collect() for t in r[0].split(",") if t}
    assert set(S.IMPLIED_RULES) <= implied
    assert values(out, "service_type") == set(S.SERVICE_RULES)


def test_every_stage_occurs_and_pipelines_differ(spark):
    assert values(BQ.stage_classification_terms(spark, SF_CHECK), "current_sales_node") == set(B.STAGE_NAMES)
    by_shop = BQ.stage_classification_by_shop(spark, SF_CHECK).cache()
    assert values(by_shop, "current_sales_node") == {*B.STAGE_NAMES, None}
    # one node is followed by different ones in different shops
    follows = by_shop.where("current_sales_node = 'greeting'").select("shop_id", "allowed_next_nodes").distinct().collect()
    assert {r[1] for r in follows} == {"greeting,need_discovery", "greeting,solution_matching"}
    moves = BQ.stage_moves_by_shop(spark, SF_CHECK).cache()
    assert values(moves, "move_valid") == {True, False}
    steps = {(r.current_node, r.allowed_next_nodes) for r in moves.collect()}
    assert len([a for n, a in steps if n == "solution_matching"]) > 1


def test_user_info_occurs(spark):
    out = BQ.user_info_said(spark, SF_CHECK).collect()
    for field in ("name", "phone", "email", "interests"):
        assert sum(bool(r[field]) for r in out) > 20
    assert {t for r in out for t in r.interests.split(",") if t} == set(S.INTEREST_TERMS)


def test_shop_stages_by_hand(spark):
    stages = spark.createDataFrame([("a", 2, "closing"), ("a", 1, "greeting"), ("b", 1, "own step"), ("b", 2, "price_discussion")],
                                   "shop_id string, step_order int, stage_name string")
    said = spark.createDataFrame([(1, "a", "I buy it"), (2, "a", "zz"), (3, "b", "price and cost, hello"), (4, "none", "buy"),
                                  (5, "b", None), (6, "a", "hello buy")], "msg_id long, shop_id string, content string")
    got = {r.msg_id: (r.current_sales_node, r.allowed_next_nodes, r.confidence)
           for r in S.shop_stage_classification(said, stages).collect()}
    assert got == {1: ("closing", ["closing"], 1.0), 2: ("greeting", ["greeting", "closing"], 0.5),
                   3: ("price_discussion", ["price_discussion"], 1.0), 4: (None, None, None),
                   5: ("own step", ["own step", "price_discussion"], 0.5), 6: ("greeting", ["greeting", "closing"], 0.5)}
