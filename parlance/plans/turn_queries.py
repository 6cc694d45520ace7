"""Decision and per-turn queries (#15-#20, #25, #39, #52, #53, #56, #57)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.text import (bulleted_lines, epoch_to_timestamp, iso_text, list_text, numbered_lines, percent2,
                                     preview, thousands)
from parlance.operators import decisions as D
from parlance.operators import parsing as PZ
from parlance.plans import parsing_queries as PQ
from parlance.plans.registry import register
from parlance.sources import bindings as B
from parlance.sources.tables import read_table

_REASON_SQL = """CASE WHEN frustration > 0.7 THEN 'high frustration' WHEN anger > 0.5 THEN 'high anger'
       WHEN legal THEN 'legal concern' WHEN medical THEN 'medical concern' WHEN financial_risk THEN 'financial risk'
       WHEN high_technical THEN 'high technical complexity'
       WHEN risk_level IN ('medium', 'high') THEN 'risk level ' || risk_level
       WHEN human_request THEN 'explicit human request' END"""

_ROUTED_SQL = B.with_ctes("analyses") + f""",
h AS (SELECT *, {_REASON_SQL} AS handoff_reason FROM analyses),
h2 AS (SELECT *, handoff_reason IS NOT NULL AS handoff_required FROM h),
r AS (SELECT *,
        (handoff_required OR risk_level IN ('medium', 'high') OR legal OR medical OR financial_risk OR high_technical
         OR (intent_code = 'complaint' AND (frustration > 0.7 OR anger > 0.5))) AS _human FROM h2),
routed AS (SELECT * EXCLUDE (_human),
        CASE WHEN _human THEN 'human_handle' WHEN intent_code IN ('purchase_consultation', 'product_inquiry', 'booking')
             THEN 'sales_task' WHEN handoff_required THEN 'human_handle' ELSE 'sales_task' END AS task,
        CASE WHEN _human THEN 'escalation rule' WHEN intent_code IN ('purchase_consultation', 'product_inquiry', 'booking')
             THEN 'sales intent' ELSE 'fallback by handoff flag' END AS task_reason FROM r)
"""


def _routed(spark, d):
    return D.task_routing(D.handoff_decision(B.analyses(spark, d)))


@register("handoff_decision", B.with_ctes("analyses") + f"""
SELECT event_id, {_REASON_SQL} IS NOT NULL AS handoff_required, {_REASON_SQL} AS handoff_reason FROM analyses""")
def handoff_decision(spark, d):
    return D.handoff_decision(B.analyses(spark, d)).select("event_id", "handoff_required", "handoff_reason")


@register("task_routing", _ROUTED_SQL + "SELECT event_id, task, task_reason FROM routed")
def task_routing(spark, d):
    return _routed(spark, d).select("event_id", "task", "task_reason")


@register("tone_policy", B.with_ctes("analyses") + """
SELECT event_id, CASE WHEN risk_level IN ('medium', 'high') THEN 'consultative' ELSE 'professional_warm' END AS tone
FROM analyses""")
def tone_policy(spark, d):
    return B.analyses(spark, d).select("event_id", D.tone_policy(F.col("risk_level")).alias("tone"))


@register("significant_emotions", B.with_ctes("analyses") + """
SELECT event_id, emotion, score FROM (UNPIVOT (SELECT event_id, frustration, anger, sadness, joy, fear, neutral
  FROM analyses) ON frustration, anger, sadness, joy, fear, neutral INTO NAME emotion VALUE score)
WHERE score > 0.1""")
def significant_emotions(spark, d):
    a = B.analyses(spark, d).select("event_id", *D.EMOTIONS)
    return D.significant_emotions(a, ["event_id"])


@register("human_handoff_queue", _ROUTED_SQL + """
SELECT event_id, session_id, handoff_reason,
       json_extract_string(payload, '$.task') AS payload_task,
       CAST(json_extract(payload, '$.emotion_score.anger') AS DOUBLE) AS payload_anger,
       CAST(json_extract(payload, '$.policy_flags.legal') AS BOOLEAN) AS payload_legal
FROM (SELECT *, json_object('task', task, 'intent_code', intent_code, 'risk_level', risk_level,
        'emotion_score', json_object('anger', anger), 'policy_flags', json_object('legal', legal)) AS payload
      FROM routed WHERE task = 'human_handle')""")
def human_handoff_queue(spark, d):
    q = D.human_handoff_queue(_routed(spark, d))
    return q.select("event_id", "session_id", "handoff_reason",
                    F.get_json_object("session_update", "$.task").alias("payload_task"),
                    F.get_json_object("session_update", "$.emotion_score.anger").cast("double").alias("payload_anger"),
                    F.get_json_object("session_update", "$.policy_flags.legal").cast("boolean")
                    .alias("payload_legal"))


@register("message_preview", """
SELECT conv_id, turn, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview
FROM conversations""")
def message_preview(spark, d):
    cv = read_table(spark, d, "conversations", "conv_id", "turn", "text")
    return cv.select("conv_id", "turn", preview(F.col("text"), 100).alias("preview"))


# ---------------------------------------------------------------- text forms (#17, #43, #45, #46, #48)
@register("document_previews", """
SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE coalesce(text, '') END AS message,
       CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE coalesce(text, '') END AS summary,
       substr(coalesce(text, ''), 1, 2000) AS prompt
FROM documents""")
def document_previews(spark, d):
    """The three preview lengths, of texts that are longer than each."""
    return read_table(spark, d, "documents", "doc_id", "text").select(
        "doc_id", preview("text", 100).alias("message"), preview("text", 200).alias("summary"),
        preview("text", 2000).alias("prompt"))


@register("session_lines", """
WITH t AS (
  SELECT conv_id, list(substr(text, 1, 40) ORDER BY turn) FILTER (WHERE role = 'user') AS said,
         list(substr(text, 1, 40) ORDER BY turn) FILTER (WHERE role = 'system') AS rules
  FROM conversations GROUP BY conv_id),
u AS (SELECT conv_id, coalesce(said, []) AS said, coalesce(rules, []) AS rules FROM t)
SELECT conv_id, CASE WHEN len(rules) = 0 THEN 'None' ELSE array_to_string(rules, ', ') END AS rule_list,
       CASE WHEN len(rules) = 0 THEN '(no trace)'
            ELSE array_to_string(list_transform(rules, lambda x, i: CAST(i AS VARCHAR) || '. ' || x), chr(10)) END AS rule_lines,
       array_to_string(list_transform(said, lambda x: '- ' || x), chr(10)) AS said_lines
FROM u""")
def session_lines(spark, d):
    """Lists of a session's texts as prompts show them; most sessions have no system text."""
    cv = read_table(spark, d, "conversations")
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct(
        "turn", F.substring("text", 1, 40).alias("text"))))), lambda x: x["text"])
    lists = cv.groupBy("conv_id").agg(of("user").alias("said"), of("system").alias("rules"))
    return lists.select("conv_id", list_text("rules").alias("rule_list"), numbered_lines("rules").alias("rule_lines"),
                        bulleted_lines("said").alias("said_lines"))


@register("number_formats", """
SELECT o_orderkey, format('{:,}', CAST(round_even(o_totalprice * 10 + 0.5, 0) AS BIGINT)) AS spend,
       printf('%.2f%%', (o_orderkey % 20000 / 100000.0) * 100) AS share,
       printf('%.2f%%', (o_orderkey % 64 / 64.0) * 100) AS eighth
FROM orders""")
def number_formats(spark, d):
    """Spend and confidence as prompts show them; many values lie half-way between two."""
    key = F.col("o_orderkey")
    return read_table(spark, d, "orders", "o_orderkey", "o_totalprice").select(
        "o_orderkey", thousands(F.round(F.col("o_totalprice") * 10 + 0.5, 6)).alias("spend"),
        percent2(key % 20000 / F.lit(100000.0)).alias("share"), percent2(key % 64 / F.lit(64.0)).alias("eighth"))


@register("event_times", """
SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds,
       strftime(make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') AS iso
FROM events""")
def event_times(spark, d):
    """Epoch seconds as timestamps and back, and as ISO text."""
    at = F.unix_timestamp("ts")
    return read_table(spark, d, "events", "event_id", "ts").select(
        "event_id", F.unix_seconds(epoch_to_timestamp(at)).alias("seconds"), iso_text(at).alias("iso"))


# ---------------------------------------------------------------- navigation joins (#18-#20)
@register("shop_products_documents", B.with_ctes("shops", "products") + """
SELECT s.id AS shop_id, p.id AS product_id, d.doc_id
FROM shops s LEFT JOIN products p ON p.shop_id = s.id LEFT JOIN documents d ON d.doc_id = p.id""")
def shop_products_documents(spark, d):
    shops, products = B.shops(spark, d), B.products(spark, d)
    docs = read_table(spark, d, "documents", "doc_id")
    j = shops.join(products.select(F.col("shop_id").alias("id"), F.col("id").alias("product_id")), "id", "left")
    j = j.join(docs, j.product_id == docs.doc_id, "left")
    return j.select(F.col("id").alias("shop_id"), "product_id", "doc_id")


@register("shop_stages", B.with_ctes("stages") + """
SELECT shop_id, step_order, stage_name,
       lead(stage_name) OVER (PARTITION BY shop_id ORDER BY step_order) AS next_stage FROM stages""")
def shop_stages(spark, d):
    return D.stage_progression(B.stages(spark, d)).select("shop_id", "step_order", "stage_name", "next_stage")


@register("shop_customers", """
SELECT n.n_nationkey AS shop_id, c.c_custkey AS customer_id FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey""")
def shop_customers(spark, d):
    n = read_table(spark, d, "nation", "n_nationkey")
    c = read_table(spark, d, "customer", "c_custkey", "c_nationkey")
    return n.join(c, n.n_nationkey == c.c_nationkey).select(F.col("n_nationkey").alias("shop_id"),
                                                             F.col("c_custkey").alias("customer_id"))


@register("session_stage_messages", B.with_ctes("sessions", "messages_long") + """
SELECT m.session_id, m.msg_id, st.stage_name
FROM sessions s JOIN messages_long m ON m.session_id = s.id
LEFT JOIN (VALUES (1, 'greeting'), (2, 'need_discovery'), (3, 'solution_matching'), (4, 'price_discussion'),
                  (5, 'objection_handling'), (6, 'closing')) st(step_order, stage_name) ON st.step_order = s.current_step""")
def session_stage_messages(spark, d):
    s = B.sessions(spark, d)
    stage_names = spark.createDataFrame(list(enumerate(B.STAGE_NAMES, start=1)), "step_order int, stage_name string")
    m = B.messages_long(spark, d)
    j = s.join(F.broadcast(stage_names), s.current_step == stage_names.step_order, "left")
    return j.join(m, m.session_id == s.id).select(m.session_id, "msg_id", "stage_name")


# ---------------------------------------------------------------- stage progression per session (#39)
_STAGE_SQL = B.with_ctes("sessions") + """,
nodes AS (SELECT * FROM (VALUES (1, 'greeting'), (2, 'need_discovery'), (3, 'solution_matching'),
                  (4, 'price_discussion'), (5, 'objection_handling'), (6, 'closing')) t(step_order, stage_name)),
prog AS (SELECT *, lead(stage_name) OVER (ORDER BY step_order) AS next_stage FROM nodes),
lastev AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id),
s AS (SELECT se.id, se.current_step,
             CASE l.last_type WHEN 'purchase' THEN 'closing' WHEN 'click' THEN 'solution_matching'
                  WHEN 'view' THEN 'need_discovery' WHEN 'signup' THEN 'greeting' ELSE 'objection_handling' END
               AS proposed_stage
      FROM sessions se JOIN lastev l ON l.user_id = se.id)
SELECT s.id, p.stage_name AS current_node,
       array_to_string(list_filter([p.stage_name, p.next_stage], lambda x: x IS NOT NULL), ',') AS allowed_next_nodes,
       coalesce(list_contains(list_filter([p.stage_name, p.next_stage], lambda x: x IS NOT NULL), s.proposed_stage), false)
         AS move_valid
FROM s LEFT JOIN prog p ON p.step_order = s.current_step"""


@register("stage_progression", _STAGE_SQL)
def stage_progression(spark, d):
    prog = D.stage_progression(spark.createDataFrame(
        [("default", i, n) for i, n in enumerate(B.STAGE_NAMES, start=1)], "shop_id string, step_order int, stage_name string"))
    ev = read_table(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    last = ev.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    proposed = (F.when(F.col("last_type") == "purchase", "closing").when(F.col("last_type") == "click",
                "solution_matching").when(F.col("last_type") == "view", "need_discovery")
                .when(F.col("last_type") == "signup", "greeting").otherwise("objection_handling"))
    sess = B.sessions(spark, d).drop("user_id")
    s = sess.join(last, sess.id == last.user_id).select(
        F.col("id"), F.lit("default").alias("shop_id"), "current_step", proposed.alias("proposed_stage"))
    out = D.move_validity(s, F.broadcast(prog))
    return out.select("id", "current_node", F.array_join("allowed_next_nodes", ",").alias("allowed_next_nodes"),
                      "move_valid")


# ---------------------------------------------------------------- #25 merge analyses, #56 final response, #57 turns
@register("merge_turn_analyses", _ROUTED_SQL + """
SELECT event_id, session_id, intent_code, handoff_required, risk_level, task FROM routed""")
def merge_turn_analyses(spark, d):
    a = B.analyses(spark, d)
    intent = a.select("event_id", "session_id", "intent_code")
    handoff = D.handoff_decision(a).drop("session_id", "intent_code")
    merged = intent.join(handoff, "event_id")
    return D.task_routing(merged).select("event_id", "session_id", "intent_code", "handoff_required", "risk_level",
                                         "task")


def _final_sql():
    sales = PQ.parse_sql(PZ.SPECS["sales"])
    guard = PQ.parse_sql(PZ.SPECS["guardrail"])
    return _ROUTED_SQL + f""",
sales AS ({sales}),
guard AS ({guard})
SELECT r.event_id, r.task,
       CASE WHEN s.error IS NULL AND g.error IS NULL THEN
       CASE WHEN r.task = 'human_handle' THEN '{D.HANDOFF_NOTE.replace(chr(10), "' || chr(10) || '")}' ELSE '' END ||
       CASE WHEN coalesce(g.approved, true) THEN coalesce(nullif(g.modified_text, ''), s.response_text)
            ELSE '{D.SAFE_FALLBACK_TEXT}' END END AS final_text,
       coalesce('sales ' || s.error, 'guardrail ' || g.error) AS error
FROM routed r JOIN sales s ON s.event_id = r.event_id JOIN guard g ON g.event_id = r.event_id"""


def _final(spark, d):
    return final_from(read_table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value", "props"))


def final_from(ev):
    """Routing and final response of the turns of any events frame (a table or a micro-batch)."""
    routed = D.task_routing(D.handoff_decision(B.analyses_from(ev))).select(
        "event_id", "session_id", "ts", "task", "intent_code", "risk_level", "handoff_required", "handoff_reason")
    sales = PZ.parse_model_output(PQ.raw_outputs_from(ev, PZ.SPECS["sales"]), "sales")
    guard = PZ.parse_model_output(PQ.raw_outputs_from(ev, PZ.SPECS["guardrail"]), "guardrail")
    j = (routed.join(sales.select("event_id", "response_text", F.col("error").alias("_se")), "event_id")
         .join(guard.select("event_id", "approved", "modified_text", F.col("error").alias("_ge")), "event_id"))
    # a turn whose model output fails validation stays, with the reason and without a text
    j = j.withColumn("error", F.coalesce(F.concat(F.lit("sales "), F.col("_se")),
                                         F.concat(F.lit("guardrail "), F.col("_ge")))).drop("_se", "_ge")
    return j.withColumn("final_text", F.when(F.col("error").isNull(), D.final_response(
        F.col("approved"), F.col("modified_text"), F.col("response_text"), F.col("task"))))


@register("final_response", _final_sql())
def final_response(spark, d):
    return _final(spark, d).select("event_id", "task", "final_text", "error")


@register("turn_quarantine", "SELECT event_id, task, error FROM (" + _final_sql() + ") WHERE error IS NOT NULL")
def turn_quarantine(spark, d):
    """Turns whose sales or guardrail output failed validation, with the reason."""
    return _final(spark, d).select("event_id", "task", "error").where(F.col("error").isNotNull())


# ---------------------------------------------------------------- #57 turn results (flagship)
# The phase trace of a turn; "sales" phases run for both tasks, "human" ones
# for escalations only.  The result line carries the task.
_TRACE = [
    ("Phase 0: receive_input (user)", None),
    ("Phase 1: IntentAgent + AnalyseHandoffAgent (parallel)", None),
    ("Phase 1: OrchestratorAgent (task selection)", None),
    ("Phase 1 result: task=", "task"),
    ("Phase 2: Sales workflow", None),
    ("Phase 2.0: Load short memory", "sales"),
    ("Phase 2.1: PredictRequirementAgent", "sales"),
    ("Phase 2.2: ClassifyStepAgent", "sales"),
    ("Phase 2.3: ProfileAgent", "sales"),
    ("Phase 2.4: UpSalesCrossSalesAgent", "sales"),
    ("Phase 2.5: SalesAgent", "sales"),
    ("Phase 3: GuardrailAgent", "sales"),
    ("Phase 3: Escalation note (human_handle)", "human"),
    ("Phase 3: receive_input (assistant)", None),
]


def turn_results_frame(spark, d):
    """Per turn: intent, handoff, routing, tone, short-memory size, final text and the phase trace."""
    from parlance.operators import memory as M
    from parlance.plans.profile_queries import _history
    from parlance.operators import profile as P

    final = _final(spark, d)
    # size of the rolling short memory = min(position in the TTL segment, 20)
    mem = M._segment_frame(B.messages_long(spark, d), M.TTL_SECONDS, M.CHUNK_SECONDS).select(
        F.col("msg_id").alias("event_id"), F.least(F.col("pos"), F.lit(M.SHORT_MEMORY)).alias("short_memory_size"))
    # one row per session: the customer's profile and the session's stage
    profile = P.customer_label(P.priority_score(_history(spark, d))).select(
        F.col("customer_id").alias("session_id"), "priority_score", "customer_label")
    stage = stage_progression(spark, d).select(F.col("id").alias("session_id"), "current_node", "allowed_next_nodes")
    j = final.join(mem, "event_id").join(profile, "session_id", "left").join(stage, "session_id", "left")
    trace = F.array_compact(F.array(*[
        F.lit(t) if cond is None
        else F.concat(F.lit(t), F.col("task")) if cond == "task"
        else F.when(F.col("task").isin("sales_task", "human_handle"), F.lit(t)) if cond == "sales"
        else F.when(F.col("task") == "human_handle", F.lit(t)) for t, cond in _TRACE]))
    return j.select("event_id", "session_id", "intent_code", "handoff_required", "handoff_reason", "risk_level",
                    "task", D.tone_policy(F.col("risk_level")).alias("tone"), "short_memory_size", "final_text",
                    "error", "priority_score", "customer_label", "current_node", "allowed_next_nodes",
                    F.array_join(trace, " | ").alias("phase_trace"))


def _turns_sql():
    from parlance.operators import memory as M
    from parlance.plans.memory_queries import _seg_sql
    from parlance.plans.profile_queries import _label_sql, _priority_sql

    parts = []
    for t, cond in _TRACE:
        if cond is None:
            parts.append(f"'{t}'")
        elif cond == "task":
            parts.append(f"'{t}' || f.task")
        elif cond == "sales":
            parts.append(f"CASE WHEN f.task IN ('sales_task', 'human_handle') THEN '{t}' END")
        else:
            parts.append(f"CASE WHEN f.task = 'human_handle' THEN '{t}' END")
    trace = f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ' | ')"
    final_body = _final_sql()
    head, select = final_body.rsplit("\nSELECT r.event_id, r.task,", 1)
    final_cte = head + ",\nfinal AS (SELECT r.event_id, r.session_id, r.intent_code, r.handoff_required, " \
        "r.handoff_reason, r.risk_level, r.task," + select + ")"
    final_cte = final_cte.replace(B.with_ctes("analyses"),
                                  B.with_ctes("analyses", "messages_long") + "," + _seg_sql("messages_long", M.TTL_SECONDS), 1)
    return final_cte + f""",
mem AS (SELECT msg_id AS event_id, CAST(count(*) OVER (PARTITION BY session_id, seg_no ORDER BY ts, msg_id
               ROWS BETWEEN {19} PRECEDING AND CURRENT ROW) AS INTEGER) AS short_memory_size FROM seg)
SELECT f.event_id, f.session_id, f.intent_code, f.handoff_required, f.handoff_reason, f.risk_level, f.task,
       CASE WHEN f.risk_level IN ('medium', 'high') THEN 'consultative' ELSE 'professional_warm' END AS tone,
       m.short_memory_size, f.final_text, f.error, pr.priority_score, la.customer_label, st.current_node,
       st.allowed_next_nodes, {trace} AS phase_trace
FROM final f JOIN mem m ON f.event_id = m.event_id
LEFT JOIN ({_priority_sql(5, 10000000, 30)}) pr ON pr.customer_id = f.session_id
LEFT JOIN ({_label_sql()}) la ON la.customer_id = f.session_id
LEFT JOIN ({_STAGE_SQL}) st ON st.id = f.session_id"""


@register("turn_results", _turns_sql())
def turn_results(spark, d):
    return turn_results_frame(spark, d)
