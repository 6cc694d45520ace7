"""Rules over texts that say every rule term, and pipelines that differ from shop to shop (#39, #59-#60c, #60f).

The driver's texts are invented prose and hold few of the rules' words.  These queries bind every event to a text made
of rule terms, chosen by its number, so that each label, flag, requirement and stage occurs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import decisions as D
from parlance.operators import scoring as S
from parlance.plans import scoring_queries as SQ
from parlance.plans.memory_queries import LONG_TTL
from parlance.plans.registry import register
from parlance.sources import bindings as B
from parlance.sources.tables import read_table

TABLES = [S.INTENT_RULES, S.EMOTION_RULES, S.FLAG_RULES, S.SERVICE_RULES, S.STAGE_RULES, {"": S.REQUIREMENT_TERMS},
          {"": S.INTEREST_TERMS}]
TERMS = sorted({t for rules in TABLES for terms in rules.values() for t in terms})
#: How often every third text repeats its first term: emotions need several hits to be strong.
REPEATS = 4


def rule_messages(spark, d):
    """Every event as a message of its user: two rule terms, of which every third text repeats the first; every 20th
    gives a name, every 21st an e-mail address, every 22nd a phone number."""
    n = F.col("event_id")
    terms = F.array(*[F.lit(t) for t in TERMS])
    one, two = (F.element_at(terms, (x % len(TERMS) + 1).cast("int")) for x in (n, n * 7 + 3))
    said = F.concat(F.when(n % 3 == 0, F.repeat(F.concat(one, F.lit(" ")), F.lit(REPEATS))).otherwise(F.concat(one, F.lit(" "))), two,
                    F.when(n % 20 == 0, F.concat(F.lit(". My name is Anna"), F.chr(n % 26 + 97))).otherwise(""),
                    F.when(n % 21 == 0, F.concat(F.lit(", mail a"), n.cast("string"), F.lit("@example.org"))).otherwise(""),
                    F.when(n % 22 == 0, F.lit(", call 0912 345 678 9")).otherwise(""))
    ev = read_table(spark, d, "events", "event_id", "ts", "user_id")
    return ev.select(F.col("user_id").alias("session_id"), n.alias("msg_id"), B.epoch_seconds(F.col("ts")).alias("ts"),
                     F.lit("user").alias("role"), said.alias("content"))


_T = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in TERMS) + "]"
_MESSAGES_SQL = f"""WITH messages_short AS (
  SELECT user_id AS session_id, event_id AS msg_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, 'user' AS role,
         CASE WHEN event_id % 3 = 0 THEN repeat({_T}[event_id % {len(TERMS)} + 1] || ' ', {REPEATS})
              ELSE {_T}[event_id % {len(TERMS)} + 1] || ' ' END || {_T}[(event_id * 7 + 3) % {len(TERMS)} + 1]
         || CASE WHEN event_id % 20 = 0 THEN '. My name is Anna' || chr(CAST(event_id % 26 + 97 AS INTEGER)) ELSE '' END
         || CASE WHEN event_id % 21 = 0 THEN ', mail a' || CAST(event_id AS VARCHAR) || '@example.org' ELSE '' END
         || CASE WHEN event_id % 22 = 0 THEN ', call 0912 345 678 9' ELSE '' END AS content
  FROM events)
"""


def _over(sql: str) -> str:
    """A query's SQL over these messages in place of the conversations."""
    return sql.replace(B.with_ctes("messages_short"), _MESSAGES_SQL, 1)


@register("intent_scores_terms", _over(SQ._intent_sql()))
def intent_scores_terms(spark, d):
    return S.intent_scores(rule_messages(spark, d), "content").select("session_id", "msg_id", "intent_code", "confidence")


@register("emotion_policy_terms", _over(SQ._emotion_sql()))
def emotion_policy_terms(spark, d):
    return S.emotion_policy_scores(rule_messages(spark, d).select("session_id", "msg_id", "content"), "content").drop("content")


@register("requirement_terms_said", _over(SQ._requirement_sql()))
def requirement_terms_said(spark, d):
    out = S.requirement_terms(rule_messages(spark, d), ttl=LONG_TTL)
    return out.select("session_id", "msg_id", F.array_join("explicit_requirements", ",").alias("explicit_requirements"),
                      F.array_join("implicit_requirements", ",").alias("implicit_requirements"), "service_type")


@register("stage_classification_terms", _over(SQ._stage_sql()))
def stage_classification_terms(spark, d):
    out = S.stage_classification(rule_messages(spark, d), B.STAGE_NAMES, SQ._SUCC)
    return out.select("session_id", "msg_id", "current_sales_node",
                      F.array_join("allowed_next_nodes", ",").alias("allowed_next_nodes"), "confidence")


@register("user_info_said", _MESSAGES_SQL + f""",
x AS (SELECT session_id, ts, msg_id, nullif(regexp_extract(content, '{S.EMAIL_RE}', 0), '') AS email,
        nullif(regexp_extract(content, '{S.PHONE_RE}', 0), '') AS phone, nullif(regexp_extract(content, '{S.NAME_RE}', 1), '') AS name,
        list_distinct(list_filter({SQ._TOK.format(x='content')}, lambda t: list_contains({SQ._lit_list(S.INTEREST_TERMS)}, t))) AS ints
      FROM messages_short)
SELECT session_id, arg_max(name, (ts, msg_id)) FILTER (WHERE name IS NOT NULL) AS name,
       arg_max(phone, (ts, msg_id)) FILTER (WHERE phone IS NOT NULL) AS phone,
       arg_max(email, (ts, msg_id)) FILTER (WHERE email IS NOT NULL) AS email,
       array_to_string(list_sort(list_distinct(flatten(list(ints)))), ',') AS interests
FROM x GROUP BY session_id""")
def user_info_said(spark, d):
    out = S.user_info_extract(rule_messages(spark, d), "session_id", ["ts", "msg_id"], "content")
    return out.select("session_id", "name", "phone", "email", F.array_join("interests", ",").alias("interests"))


# ------------------------------------------------------------------ pipelines of their own
def own_stages(spark, d):
    """Every shop's own pipeline: by its number's rest it skips discovery, has objections before prices, or ends after
    the offer; the others have the default one."""
    number = F.regexp_extract("shop_id", r"([0-9]+)$", 1).cast("int") % 4
    step, name = F.col("step_order"), F.col("stage_name")
    s = B.stages(spark, d).withColumn("_kind", number)
    s = s.where(~((F.col("_kind") == 1) & (name == "need_discovery")) & ~((F.col("_kind") == 3) & (step > 3)))
    moved = (F.when((F.col("_kind") == 1) & (step > 2), step - 1)
             .when((F.col("_kind") == 2) & (name == "price_discussion"), 5)
             .when((F.col("_kind") == 2) & (name == "objection_handling"), 4).otherwise(step))
    return s.select("shop_id", moved.cast("int").alias("step_order"), "stage_name")


_OWN_SQL = """
own AS (
  SELECT shop_id, CAST(CASE WHEN kind = 1 AND step_order > 2 THEN step_order - 1
                            WHEN kind = 2 AND stage_name = 'price_discussion' THEN 5
                            WHEN kind = 2 AND stage_name = 'objection_handling' THEN 4 ELSE step_order END AS INTEGER) AS step_order,
         stage_name
  FROM (SELECT *, CAST(regexp_extract(shop_id, '([0-9]+)$', 1) AS INTEGER) % 4 AS kind FROM stages)
  WHERE NOT (kind = 1 AND stage_name = 'need_discovery') AND NOT (kind = 3 AND step_order > 3)),
prog AS (SELECT *, lead(stage_name) OVER (PARTITION BY shop_id ORDER BY step_order) AS next_stage FROM own)"""


@register("stage_moves_by_shop", B.with_ctes("stages", "sessions") + "," + _OWN_SQL + """,
s AS (SELECT id, 'Brand#' || CAST(id % 25 + 1 AS VARCHAR) AS shop_id, current_step,
             ['greeting', 'need_discovery', 'solution_matching', 'price_discussion', 'objection_handling', 'closing'][id // 7 % 6 + 1]
               AS proposed_stage FROM sessions),
a AS (SELECT s.*, p.stage_name, list_filter([p.stage_name, p.next_stage], lambda x: x IS NOT NULL) AS allowed
      FROM s LEFT JOIN prog p ON p.shop_id = s.shop_id AND p.step_order = s.current_step)
SELECT id, shop_id, stage_name AS current_node, array_to_string(allowed, ',') AS allowed_next_nodes, proposed_stage,
       coalesce(list_contains(allowed, proposed_stage), false) AS move_valid FROM a""")
def stage_moves_by_shop(spark, d):
    """#39 by the pipeline of the session's shop."""
    names = F.array(*[F.lit(n) for n in B.STAGE_NAMES])
    s = B.sessions(spark, d).select(
        "id", F.concat(F.lit("Brand#"), (F.col("id") % 25 + 1).cast("string")).alias("shop_id"), "current_step",
        F.element_at(names, (F.floor(F.col("id") / 7) % 6 + 1).cast("int")).alias("proposed_stage"))
    out = D.move_validity(s, D.stage_progression(own_stages(spark, d)))
    return out.select("id", "shop_id", "current_node", F.array_join("allowed_next_nodes", ",").alias("allowed_next_nodes"),
                      "proposed_stage", "move_valid")


def _shop_stage_sql():
    score = "CASE name " + " ".join(f"WHEN '{n}' THEN {h}" for n, h in SQ._scores_sql("toks", S.STAGE_RULES).items()) + " ELSE 0 END"
    return _MESSAGES_SQL + "," + B.SQL["shops"] + "," + B.SQL["stages"] + "," + _OWN_SQL + f""",
t AS (SELECT msg_id, 'Brand#' || CAST(session_id % 27 + 1 AS VARCHAR) AS shop_id, {SQ._TOK.format(x='content')} AS toks FROM messages_short),
j AS (SELECT t.msg_id, t.shop_id, o.step_order, o.stage_name AS name, t.toks FROM t JOIN own o ON o.shop_id = t.shop_id),
c AS (SELECT msg_id, shop_id, step_order, name, {score} AS n FROM j),
b AS (SELECT msg_id, shop_id, arg_min(step_order, (-n, step_order)) AS at, max(n) AS n, sum(n) AS total FROM c GROUP BY ALL),
e AS (SELECT b.*, c.name, x.name AS next FROM b JOIN c ON c.msg_id = b.msg_id AND c.step_order = b.at
      LEFT JOIN c x ON x.msg_id = b.msg_id AND x.step_order = b.at + 1)
SELECT t.msg_id, t.shop_id, e.name AS current_sales_node,
       CASE WHEN e.name IS NOT NULL THEN array_to_string(list_filter([e.name, e.next], lambda x: x IS NOT NULL), ',') END
         AS allowed_next_nodes,
       CASE WHEN e.n > 0 THEN round(e.n / e.total, 6) WHEN e.name IS NOT NULL THEN {S.FALLBACK_CONFIDENCE} END AS confidence
FROM t LEFT JOIN e ON e.msg_id = t.msg_id"""


@register("stage_classification_by_shop", _shop_stage_sql())
def stage_classification_by_shop(spark, d):
    """#60c by the pipeline of the message's shop; two shops have none."""
    m = rule_messages(spark, d).select("msg_id", "content", F.concat(
        F.lit("Brand#"), (F.col("session_id") % 27 + 1).cast("string")).alias("shop_id"))
    out = S.shop_stage_classification(m, own_stages(spark, d))
    return out.select("msg_id", "shop_id", "current_sales_node",
                      F.array_join("allowed_next_nodes", ",").alias("allowed_next_nodes"), "confidence")
