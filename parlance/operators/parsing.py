"""Validation of stored model output (#58 ``parse_model_output``) with its 11 specs.

Semantics of the reference, per raw text:
1. if the stripped text starts with ``{`` the whole text must be one JSON value;
2. else the greedy first-``{``-to-last-``}`` span is parsed; none / failure -> fallback record;
3. missing fields get the spec's defaults (some specs overwrite ``user_id`` from input);
4. types and bounds are checked last; a violation is an error (ours: ``error`` column,
   quarantined by the caller), not a fallback.

Spark plan: all column expressions (one projection), so it is a map-only job.
Strict validity: ``json_array_length('[' || t || ']') = 1`` (trailing text fails like
Python's parser) and a non-null ``try_parse_json`` (single quotes are refused); field
presence, JSON kind and value come from a ``VARIANT`` of the object (``variant_get`` /
``schema_of_variant``).  As in Python, the last of duplicate keys counts (the session
setting ``spark.sql.variant.allowDuplicateKeys`` is switched on), and ``NaN`` and
``Infinity`` are numbers, which then fail the bounds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.text import stripped_starts_with

REQUIRED = "__required__"
RAW = "__raw__"


@dataclass(frozen=True)
class Ref:
    """A value taken from an input column."""
    column: str


@dataclass(frozen=True)
class Field:
    path: str                 # dotted JSON path, e.g. "emotion_score.anger"
    kind: str                 # str | float | int | bool | list | obj
    missing: object = REQUIRED  # default when the key is absent
    fallback: object = None   # value in the whole-record fallback
    nullable: bool = False
    lo: float | None = None
    hi: float | None = None
    empty_to_null: bool = False

    @property
    def out(self) -> str:
        return self.path.replace(".", "_")


@dataclass(frozen=True)
class Spec:
    name: str
    fields: tuple
    overwrite: dict = field(default_factory=dict)   # output column -> input column, always
    validate: bool = True                            # plain-dict specs skip type checks


_FLAGS = ("legal", "medical", "financial_risk", "high_technical")
_EMOTIONS = ("frustration", "anger", "sadness", "joy", "fear", "neutral")


def _nested_flags(from_input=False):
    given = {f: Ref(f"in_policy_flags_{f}") if from_input else False for f in _FLAGS}
    return [Field(f"policy_flags.{f}", "bool", missing=v, fallback=v) for f, v in given.items()]


def _nested_emotions(from_input=False):
    out = []
    for e in _EMOTIONS:
        fb = Ref(f"in_emotion_score_{e}") if from_input else (1.0 if e == "neutral" else 0.0)
        out.append(Field(f"emotion_score.{e}", "float", missing=fb if from_input else 0.0, fallback=fb, lo=0.0, hi=1.0))
    return out


# Fallback texts of the reference.
SALES_GREETING = "Xin chào! Tôi có thể giúp gì cho bạn?"
GUARDRAIL_FALLBACK_REASON = "Unable to parse guardrail response, flagging for review"
STEP_FALLBACK_REASON = "Failed to parse response, using current node"
ORCH_FALLBACK_REASON = "Fallback task selection"

SPECS: dict[str, Spec] = {
    "intent": Spec("intent", (
        Field("session_name", "str", missing="", fallback=Ref("session_id")),
        Field("clean_intent_text", "str", fallback=RAW),
        Field("intent_code", "str", fallback="unknown"),
        Field("confidence", "float", fallback=0.5, lo=0.0, hi=1.0),
    ), overwrite={"user_id": "user_id"}),
    "handoff": Spec("handoff", tuple(
        [Field("policy_flags", "obj_present", fallback=True)] + _nested_flags()
        + [Field("emotion_score", "obj_present", fallback=True)] + _nested_emotions()
        + [Field("handoff_required", "bool", fallback=False),
           Field("handoff_reason", "str", missing=None, fallback=None, nullable=True),
           Field("risk_level", "str", fallback="low"),
           Field("confidence", "float", fallback=0.5, lo=0.0, hi=1.0)]), overwrite={"user_id": "user_id"}),
    "orchestration": Spec("orchestration", (
        Field("task", "str", fallback=Ref("in_task_by_flag")),
        Field("clean_intent_text", "str", missing=Ref("in_clean_intent_text"), fallback=Ref("in_clean_intent_text")),
        Field("intent_code", "str", missing=Ref("in_intent_code"), fallback=Ref("in_intent_code")),
        Field("policy_flags", "obj_present", missing=True, fallback=True), *_nested_flags(from_input=True),
        Field("emotion_score", "obj_present", missing=True, fallback=True), *_nested_emotions(from_input=True),
        Field("handoff_required", "bool", missing=Ref("in_handoff_required"), fallback=Ref("in_handoff_required")),
        Field("handoff_reason", "str", missing=None, fallback=Ref("in_handoff_reason"), nullable=True),
        Field("risk_level", "str", missing=Ref("in_risk_level"), fallback=Ref("in_risk_level")),
        Field("task_reason", "str", missing=None, fallback=ORCH_FALLBACK_REASON, nullable=True),
    ), overwrite={"user_id": "user_id"}),
    "requirement": Spec("requirement", (
        Field("explicit_requirements", "list", missing=[], fallback=[]),
        Field("implicit_requirements", "list", missing=[], fallback=[]),
        Field("service_type", "str", missing="information", fallback="information"),
    )),
    "step": Spec("step", (
        Field("current_sales_node", "str", missing=Ref("current_node"), fallback=Ref("current_node")),
        Field("allowed_next_nodes", "list", missing=[], fallback=[]),
        Field("reason", "str", missing="", fallback=STEP_FALLBACK_REASON),
        Field("confidence", "float", missing=0.5, fallback=0.5, lo=0.0, hi=1.0),
    )),
    "profile": Spec("profile", (
        Field("customer_label", "str", missing=Ref("first_label"), fallback=Ref("first_label")),
        Field("confidence", "float", missing=0.5, fallback=0.5, lo=0.0, hi=1.0),
        Field("priority_score", "int", missing=Ref("rule_priority"), fallback=1, lo=1, hi=5),
    )),
    "upsell": Spec("upsell", (
        Field("selected_combo", "str", missing=None, fallback=None, nullable=True),
        Field("reason", "str", missing=None, fallback="Unable to parse response", nullable=True),
        Field("response_text", "str", missing="", fallback=""),
    )),
    "sales": Spec("sales", (
        Field("response_text", "str", missing=SALES_GREETING, fallback=SALES_GREETING),
        Field("next_expected_input", "str", missing="preference_clarification", fallback="preference_clarification"),
        Field("stay_in_sales_node", "bool", missing=True, fallback=True),
    )),
    "guardrail": Spec("guardrail", (
        Field("approved", "bool", missing=True, fallback=True),
        Field("modified_text", "str", missing=None, fallback=None, nullable=True, empty_to_null=True),
        Field("sales_doublecheck", "bool", missing=False, fallback=True),
        Field("reason_recheck", "str", missing=None, fallback=GUARDRAIL_FALLBACK_REASON, nullable=True),
    )),
    "user_info": Spec("user_info", (
        Field("name", "str", missing=None, fallback=None, nullable=True),
        Field("phone", "str", missing=None, fallback=None, nullable=True),
        Field("email", "str", missing=None, fallback=None, nullable=True),
        Field("preferences", "obj", missing=None, fallback="{}", nullable=True),
        Field("interests", "list", missing=None, fallback=[], nullable=True),
        Field("other_info", "obj", missing=None, fallback="{}", nullable=True),
    ), validate=False),
    "summary": Spec("summary", (
        Field("summary", "str", missing=None, fallback="No summary available", nullable=True),
        Field("tags", "list", missing=None, fallback=[], nullable=True),
        Field("key_topics", "list", missing=None, fallback=[], nullable=True),
    ), validate=False),
}

_SPARK_TYPES = {"str": T.StringType(), "float": T.DoubleType(), "int": T.LongType(), "bool": T.BooleanType(),
                "list": T.ArrayType(T.StringType()), "obj": T.StringType(), "obj_present": T.BooleanType()}

#: A bare NaN or Infinity as the value of a member or an element.
NON_FINITE = r"([:\[,]\s*)(NaN|-?Infinity)(?=\s*[,}\]])"

_LAX_TRUE = ["true", "t", "yes", "y", "on", "1"]
_LAX_FALSE = ["false", "f", "no", "n", "off", "0"]


def json_candidate(raw: Column) -> Column:
    """#49: the text the reference hands to its JSON parser, or null when there is none."""
    span = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(stripped_starts_with(raw, "{"), raw).otherwise(F.nullif(span, F.lit("")))


def _lit(v, kind):
    if isinstance(v, Ref):
        return F.col(v.column).cast(_SPARK_TYPES[kind])
    if v is None:
        return F.lit(None).cast(_SPARK_TYPES[kind])
    if kind == "list":
        return F.array(*[F.lit(x) for x in v]).cast(_SPARK_TYPES[kind])
    return F.lit(v).cast(_SPARK_TYPES[kind])


def _kind(s: Column) -> Column:
    """The JSON kind of a variant with this schema."""
    return (F.when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null")
            .when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").otherwise("number"))


def parse_model_output(df: DataFrame, spec: Spec | str, raw_col: str = "raw") -> DataFrame:
    """Apply one spec to ``raw_col``: typed fields, ``is_fallback`` and ``error`` columns."""
    spec = SPECS[spec] if isinstance(spec, str) else spec
    cand = json_candidate(F.col(raw_col))
    # strict check: exactly one JSON value (trailing text fails like Python's parser,
    # single quotes are refused); the value itself is read as a VARIANT
    # (json_array_length streams the tokens without building values; the variant parser
    # refuses single quotes)
    finite = F.regexp_replace("_cand", NON_FINITE, '$1"$2"')
    n_values = F.coalesce(*(F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) for c in (F.col("_cand"), finite)))
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    d = df.withColumn("_cand", cand).withColumn(
        "_v", F.coalesce(F.try_parse_json(F.col("_cand")), F.try_parse_json(finite)))
    ok = (F.col("_cand").isNotNull() & (n_values == 1)
          & F.col("_v").isNotNull() & stripped_starts_with("_cand", "{"))
    d = d.withColumn("is_fallback", ~F.coalesce(ok, F.lit(False)))
    errors = []
    outs = []
    # each field's sub-variant, its schema and JSON kind are computed once, in their own projections
    d = d.select("*", *[F.expr(f"variant_get(_v, '$.{f.path}')").alias(f"_s{i}") for i, f in enumerate(spec.fields)])
    d = d.select("*", *[F.schema_of_variant(F.col(f"_s{i}")).alias(f"_t{i}") for i, f in enumerate(spec.fields)])
    d = d.select("*", *[_kind(F.col(f"_t{i}")).alias(f"_k{i}") for i, f in enumerate(spec.fields)])
    for i, f in enumerate(spec.fields):
        sub, kind = F.col(f"_s{i}"), F.col(f"_k{i}")
        present = sub.isNotNull()
        text = F.try_variant_get(sub, "$", "string")
        if f.kind == "str":
            val, bad_type = text, kind != "string"
        elif f.kind == "float":
            val = F.when(kind == "number", F.try_variant_get(sub, "$", "double")) \
                   .when(kind == "string", text.try_cast("double"))
            bad_type = val.isNull() & (kind != "null")
        elif f.kind == "int":
            dv = F.when(kind == "number", F.try_variant_get(sub, "$", "double")) \
                  .when(kind == "string", text.try_cast("double"))
            val = F.when(dv == F.floor(dv), dv.cast("bigint"))
            bad_type = val.isNull() & (kind != "null")
        elif f.kind == "bool":
            lt = F.lower(text)
            val = (F.when(kind == "boolean", F.try_variant_get(sub, "$", "boolean"))
                   .when((kind != "null") & lt.isin(*_LAX_TRUE), F.lit(True))
                   .when((kind != "null") & lt.isin(*_LAX_FALSE), F.lit(False)))
            bad_type = val.isNull() & (kind != "null")
        elif f.kind == "list":
            val = F.when(kind == "array", F.try_variant_get(sub, "$", "array<string>"))
            # every element must be a string: numbers, nulls and nested values are refused
            strings = F.col(f"_t{i}").isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(val, lambda x: x.isNull())
            bad_type = ~F.coalesce(strings, F.lit(False)) & (kind != "null")
        elif f.kind == "obj":
            val = F.when(kind == "object", F.to_json(sub))
            bad_type = kind != "object"
        else:  # obj_present: a nested object that must exist
            val = F.when(kind == "object", F.lit(True))
            bad_type = kind != "object"
        missing_val = None if f.missing is REQUIRED else _lit(f.missing, f.kind)
        value = F.when(present, val).otherwise(missing_val if missing_val is not None else F.lit(None))
        if f.empty_to_null:
            value = F.nullif(value, F.lit(""))
        fb = _lit(f.fallback, f.kind) if f.fallback is not RAW else F.col(raw_col)
        outs.append(F.when(F.col("is_fallback"), fb).otherwise(value.cast(_SPARK_TYPES[f.kind])).alias(f.out))
        if spec.validate:
            reason = F.when(~present & F.lit(f.missing is REQUIRED), F.lit(f"{f.path}: missing"))
            reason = reason.when(present & (kind == "null") & F.lit(not f.nullable), F.lit(f"{f.path}: null"))
            reason = reason.when(present & (kind != "null") & bad_type, F.lit(f"{f.path}: type"))
            if f.lo is not None:
                reason = reason.when(present & ((val < f.lo) | (val > f.hi)), F.lit(f"{f.path}: range"))
            errors.append(F.when(~F.col("is_fallback"), reason))
    over = [F.col(src).alias(dst) for dst, src in spec.overwrite.items() if dst not in df.columns]
    err = F.coalesce(*errors) if errors else F.lit(None).cast("string")
    return d.select(*[c for c in df.columns], *over, *outs, "is_fallback", err.alias("error"))


# The closed domains that prompts state for fields of a model's answer.
DOMAINS = {
    "intent": {"intent_code": ["purchase_consultation", "product_inquiry", "complaint", "support_request",
                               "information_request", "booking", "cancellation", "feedback", "unknown"]},
    "handoff": {"risk_level": ["low", "medium", "high"]},
    "sales": {"next_expected_input": ["preference_clarification", "price_inquiry", "product_question", "objection",
                                      "agreement", "rejection"]},
}


def domain_warnings(parsed: DataFrame, spec_name: str) -> DataFrame:
    """Parsed records with ``warnings``: ``field: value`` for every value outside its domain.

    A record with a warning stays valid, as the domains are advice to the model and no part of the
    record's type; a null is no value."""
    found = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.concat(F.lit(f"{c}: "), F.col(c)))
             for c, values in DOMAINS[spec_name].items()]
    return parsed.withColumn("warnings", F.array_compact(F.array(*found)))
