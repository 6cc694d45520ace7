"""Deterministic decision rules as column expressions (#15-#17, #25, #39, #52, #53, #56).

Every rule is a ``when`` chain over columns of one turn, so it runs inside the
turn's row (no shuffle) and stays in whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Handoff thresholds.
FRUSTRATION_LIMIT = 0.7
ANGER_LIMIT = 0.5
EMOTIONS = ["frustration", "anger", "sadness", "joy", "fear", "neutral"]
FLAGS = ["legal", "medical", "financial_risk", "high_technical"]
ELEVATED_RISK = ["medium", "high"]
SALES_INTENTS = ["purchase_consultation", "product_inquiry", "booking"]
SIGNIFICANT_EMOTION = 0.1

# Texts of the final response.
SAFE_FALLBACK_TEXT = ("Mình chưa thể trả lời chắc chắn nội dung này ngay lúc này. "
                      "Mình sẽ chuyển cho nhân viên hỗ trợ tiếp nhé.")
HANDOFF_NOTE = "(Mình đã ghi nhận để nhân viên hỗ trợ thêm)\n\n"


def _any_flag() -> Column:
    return F.greatest(*[F.coalesce(F.col(f), F.lit(False)).cast("int") for f in FLAGS]) == 1


def handoff_decision(df: DataFrame) -> DataFrame:
    """#52: handoff required and the first rule that fired (our order of rules)."""
    reason = (F.when(F.col("frustration") > FRUSTRATION_LIMIT, F.lit("high frustration"))
              .when(F.col("anger") > ANGER_LIMIT, F.lit("high anger"))
              .when(F.coalesce(F.col("legal"), F.lit(False)), F.lit("legal concern"))
              .when(F.coalesce(F.col("medical"), F.lit(False)), F.lit("medical concern"))
              .when(F.coalesce(F.col("financial_risk"), F.lit(False)), F.lit("financial risk"))
              .when(F.coalesce(F.col("high_technical"), F.lit(False)), F.lit("high technical complexity"))
              .when(F.col("risk_level").isin(*ELEVATED_RISK), F.concat(F.lit("risk level "), F.col("risk_level")))
              .when(F.coalesce(F.col("human_request"), F.lit(False)), F.lit("explicit human request")))
    return df.withColumn("handoff_reason", reason).withColumn("handoff_required", reason.isNotNull())


def task_routing(df: DataFrame) -> DataFrame:
    """#53: ``human_handle`` / ``sales_task`` with the reason of the choice."""
    high = (F.col("frustration") > FRUSTRATION_LIMIT) | (F.col("anger") > ANGER_LIMIT)
    human = (F.col("handoff_required") | F.col("risk_level").isin(*ELEVATED_RISK) | _any_flag()
             | ((F.col("intent_code") == "complaint") & high))
    task = (F.when(human, F.lit("human_handle"))
            .when(F.col("intent_code").isin(*SALES_INTENTS), F.lit("sales_task"))
            .when(F.col("handoff_required"), F.lit("human_handle")).otherwise(F.lit("sales_task")))
    why = (F.when(human, F.lit("escalation rule"))
           .when(F.col("intent_code").isin(*SALES_INTENTS), F.lit("sales intent"))
           .otherwise(F.lit("fallback by handoff flag")))
    return df.withColumn("task", task).withColumn("task_reason", why)


def tone_policy(risk_level: Column) -> Column:
    """#56: consultative for elevated risk, else professional_warm."""
    return F.when(risk_level.isin(*ELEVATED_RISK), F.lit("consultative")).otherwise(F.lit("professional_warm"))


def final_response(approved: Column, modified_text: Column, original: Column, task: Column) -> Column:
    """#56: approved -> modified text when non-empty else original; rejected -> safe text; escalation note."""
    body = (F.when(F.coalesce(approved, F.lit(True)),
                   F.coalesce(F.nullif(modified_text, F.lit("")), original))
            .otherwise(F.lit(SAFE_FALLBACK_TEXT)))
    return F.when(task == "human_handle", F.concat(F.lit(HANDOFF_NOTE), body)).otherwise(body)


def significant_emotions(df: DataFrame, key_cols, threshold: float = SIGNIFICANT_EMOTION) -> DataFrame:
    """#16: one row per emotion with a score above ``threshold`` (an ``unpivot``)."""
    long = df.unpivot(list(key_cols), EMOTIONS, "emotion", "score")
    return long.where(F.col("score") > threshold)


def human_handoff_queue(turns: DataFrame) -> DataFrame:
    """#15: turns routed to ``human_handle`` with the session update payload as JSON."""
    payload = F.to_json(F.struct(
        F.col("task"), F.col("intent_code"), F.col("risk_level"), F.col("handoff_required"),
        F.struct(*[F.col(e) for e in EMOTIONS]).alias("emotion_score"),
        F.struct(*[F.col(f) for f in FLAGS]).alias("policy_flags")))
    return turns.where(F.col("task") == "human_handle").withColumn("session_update", payload)


def stage_progression(stages: DataFrame) -> DataFrame:
    """#39 (per shop): stages in step order with the next stage (immediate successor)."""
    w = Window.partitionBy("shop_id").orderBy("step_order")
    return stages.withColumn("next_stage", F.lead("stage_name").over(w))


def move_validity(sessions: DataFrame, progression: DataFrame) -> DataFrame:
    """#39 (per session): current node, allowed next nodes, validity of a proposed node.

    Allowed = stay or the immediate successor (the reference defines no edges).
    ``sessions`` has ``shop_id``, ``current_step`` and ``proposed_stage``.
    """
    cur = progression.select("shop_id", F.col("step_order").alias("current_step"),
                             F.col("stage_name").alias("current_node"), "next_stage")
    j = sessions.join(cur, ["shop_id", "current_step"], "left")
    allowed = F.array_compact(F.array(F.col("current_node"), F.col("next_stage")))
    return (j.withColumn("allowed_next_nodes", allowed)
            .withColumn("move_valid", F.coalesce(F.array_contains(allowed, F.col("proposed_stage")), F.lit(False))))
