"""Model-output validation queries (#58), one per spec, over raw outputs derived from events.

The raw texts are built identically in Spark and DuckDB from event columns, with
seven shapes by ``event_id % 7``: clean object, fenced object, prose around an
object, object followed by text, last field missing, last field null, no object.
The DuckDB oracle is generated from the same spec.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import parsing as PZ
from parlance.plans.registry import register
from parlance.sources import bindings as B
from parlance.sources.tables import read_table


# ------------------------------------------------------------- raw text recipe
def _value(f: PZ.Field):
    """(spark column thunk, sql text) of the JSON value text for a leaf field."""
    name = f.path.split(".")[-1]
    if f.kind == "str":
        return (lambda: F.concat(F.lit('"'), F.col("event_type"), F.lit("-" + name + '"')),
                f"'\"' || event_type || '-{name}\"'")
    if f.kind == "float":
        # hundredths from the integer part: no rounding ties between engines
        return (lambda: ((F.floor("value") % 120) / 100.0).cast("string"),
                "CAST((CAST(floor(value) AS BIGINT) % 120) / 100.0 AS VARCHAR)")
    if f.kind == "int":
        return (lambda: (F.col("event_id") % 7).cast("string"), "CAST(event_id % 7 AS VARCHAR)")
    if f.kind == "bool":
        return (lambda: F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"),
                "CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END")
    if f.kind == "list":
        return (lambda: F.concat(F.lit('["'), F.col("event_type"), F.lit('", "item-'),
                                 (F.col("event_id") % 5).cast("string"), F.lit('"]')),
                "'[\"' || event_type || '\", \"item-' || CAST(event_id % 5 AS VARCHAR) || '\"]'")
    if f.kind == "obj":
        return (lambda: F.concat(F.lit('{"k": '), (F.col("event_id") % 5).cast("string"), F.lit("}")),
                "'{\"k\": ' || CAST(event_id % 5 AS VARCHAR) || '}'")
    raise ValueError(f.kind)


def _text(t: str):
    return (lambda: F.lit(t)), "'" + t.replace("'", "''") + "'"


def _object(spec: PZ.Spec, drop_last=False, null_last=False):
    """Build the object text: top-level keys in spec order, nested objects from dotted paths.

    Returns (spark column thunk, sql text); Spark columns are only built when called.
    """
    tops: list[tuple[str, list]] = []
    for f in spec.fields:
        if f.kind == "obj_present":
            tops.append((f.path, []))
        elif "." in f.path:
            tops[-1][1].append(f)
        else:
            tops.append((f.path, [f]))
    if drop_last:
        tops = tops[:-1]
    pieces = [_text("{")]
    for i, (key, leaves) in enumerate(tops):
        last = i == len(tops) - 1
        pieces.append(_text(('' if i == 0 else ', ') + f'"{key}": '))
        if null_last and last:
            pieces.append(_text("null"))
        elif len(leaves) == 1 and leaves[0].path == key:
            pieces.append(_value(leaves[0]))
        else:
            pieces.append(_text("{"))
            for j, lf in enumerate(leaves):
                pieces.append(_text(('' if j == 0 else ', ') + f'"{lf.path.split(".")[-1]}": '))
                pieces.append(_value(lf))
            pieces.append(_text("}"))
    pieces.append(_text("}"))
    return (lambda: F.concat(*[c() for c, _ in pieces])), "(" + " || ".join(q for _, q in pieces) + ")"


def _raw_sql(spec: PZ.Spec) -> str:
    _, obj_q = _object(spec)
    _, miss_q = _object(spec, drop_last=True)
    _, null_q = _object(spec, null_last=True)
    return f"""CASE event_id % 7 WHEN 0 THEN {obj_q}
    WHEN 1 THEN '```json' || chr(10) || {obj_q} || chr(10) || '```'
    WHEN 2 THEN 'Result: ' || {obj_q} || ' done.'
    WHEN 3 THEN {obj_q} || ' trailing {{x}}'
    WHEN 4 THEN {miss_q} WHEN 5 THEN {null_q}
    ELSE 'no structured answer for ' || event_type END"""


def _raw_col(spec: PZ.Spec):
    obj_c = _object(spec)[0]()
    miss_c = _object(spec, drop_last=True)[0]()
    null_c = _object(spec, null_last=True)[0]()
    k = F.col("event_id") % 7
    return (F.when(k == 0, obj_c)
            .when(k == 1, F.concat(F.lit("```json\n"), obj_c, F.lit("\n```")))
            .when(k == 2, F.concat(F.lit("Result: "), obj_c, F.lit(" done.")))
            .when(k == 3, F.concat(obj_c, F.lit(" trailing {x}")))
            .when(k == 4, miss_c).when(k == 5, null_c)
            .otherwise(F.concat(F.lit("no structured answer for "), F.col("event_type"))))


# Input columns every spec may refer to (derived from the same event row); Spark side built lazily.
def _inputs():
    return [
        ("user_id", F.col("user_id").cast("string"), "CAST(user_id AS VARCHAR)"),
        ("session_id", F.concat(F.lit("s-"), F.col("user_id").cast("string")), "'s-' || CAST(user_id AS VARCHAR)"),
        ("in_task_by_flag", F.when(F.col("value") > 40, "human_handle").otherwise("sales_task"),
         "CASE WHEN value > 40 THEN 'human_handle' ELSE 'sales_task' END"),
        ("in_clean_intent_text", F.col("event_type"), "event_type"),
        ("in_intent_code", F.lit("product_inquiry"), "'product_inquiry'"),
        ("in_handoff_required", F.col("value") > 40, "value > 40"),
        ("in_handoff_reason", F.when(F.col("value") > 40, "high value"), "CASE WHEN value > 40 THEN 'high value' END"),
        ("in_risk_level", F.when(F.col("value") > 40, "medium").otherwise("low"),
         "CASE WHEN value > 40 THEN 'medium' ELSE 'low' END"),
        ("current_node", F.lit("greeting"), "'greeting'"),
        ("first_label", F.lit("VIP"), "'VIP'"),
        ("rule_priority", (F.col("event_id") % 3 + 1).cast("bigint"), "CAST(event_id % 3 + 1 AS BIGINT)"),
        *((f"in_policy_flags_{f}", F.col("event_id") % (i + 3) == 0, f"event_id % {i + 3} = 0")
          for i, f in enumerate(PZ._FLAGS)),
        *((f"in_emotion_score_{e}", (F.col("event_id") % (i + 2)) / 10.0, f"(event_id % {i + 2}) / 10.0")
          for i, e in enumerate(PZ._EMOTIONS)),
    ]


_INPUT_SQL = [
    ("user_id", "CAST(user_id AS VARCHAR)"),
    ("session_id", "'s-' || CAST(user_id AS VARCHAR)"),
    ("in_task_by_flag", "CASE WHEN value > 40 THEN 'human_handle' ELSE 'sales_task' END"),
    ("in_clean_intent_text", "event_type"),
    ("in_intent_code", "'product_inquiry'"),
    ("in_handoff_required", "value > 40"),
    ("in_handoff_reason", "CASE WHEN value > 40 THEN 'high value' END"),
    ("in_risk_level", "CASE WHEN value > 40 THEN 'medium' ELSE 'low' END"),
    ("current_node", "'greeting'"),
    ("first_label", "'VIP'"),
    ("rule_priority", "CAST(event_id % 3 + 1 AS BIGINT)"),
    *((f"in_policy_flags_{f}", f"event_id % {i + 3} = 0") for i, f in enumerate(PZ._FLAGS)),
    *((f"in_emotion_score_{e}", f"CAST((event_id % {i + 2}) / 10.0 AS DOUBLE)") for i, e in enumerate(PZ._EMOTIONS)),
]


def raw_outputs(spark, d, spec: PZ.Spec):
    return raw_outputs_from(read_table(spark, d, "events", "event_id", "user_id", "event_type", "value"), spec)


def raw_outputs_from(ev, spec: PZ.Spec):
    """The model-output binding over any events frame (a table or a micro-batch)."""
    raw_c = _raw_col(spec)
    return ev.select("event_id", *[c.alias(n) for n, c, _ in _inputs()], raw_c.alias("raw"))


def raw_outputs_sql(spec: PZ.Spec) -> str:
    raw_q = _raw_sql(spec)
    cols = ", ".join(f"{q} AS {n}" for n, q in _INPUT_SQL)
    return f"raw_outputs AS (SELECT event_id, {cols}, {raw_q} AS raw FROM events)"


# ------------------------------------------------------------- oracle SQL
_STRIP = r"regexp_replace(coalesce(raw, ''), '^\s+|\s+$', '', 'g')"
_SQL_TYPES = {"str": "VARCHAR", "float": "DOUBLE", "int": "BIGINT", "bool": "BOOLEAN", "list": "VARCHAR[]",
              "obj": "VARCHAR", "obj_present": "BOOLEAN"}


def _sql_lit(v, kind):
    if isinstance(v, PZ.Ref):
        return f"CAST({v.column} AS {_SQL_TYPES[kind]})"
    if v is None:
        return f"CAST(NULL AS {_SQL_TYPES[kind]})"
    if v is PZ.RAW:
        return "raw"
    if kind == "list":
        return "CAST([" + ", ".join(f"'{x}'" for x in v) + "] AS VARCHAR[])"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"CAST({v} AS {_SQL_TYPES[kind]})"


def parse_sql(spec: PZ.Spec) -> str:
    sel, errs = [], []
    for f in spec.fields:
        p = f"'$.{f.path}'"
        present = f"json_exists(jc, {p})"
        jt = f"json_type(jc, {p})"
        kind = (f"CASE {jt} WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' "
                f"WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END")
        text = f"json_extract_string(jc, {p})"
        if f.kind == "str":
            val = f"CASE WHEN {kind} = 'string' THEN {text} END"
            bad = f"({kind} <> 'string')"
        elif f.kind in ("float", "int"):
            dv = f"TRY_CAST({text} AS DOUBLE)"
            dv = f"CASE WHEN {kind} IN ('number', 'string') THEN {dv} END"
            val = dv if f.kind == "float" else f"CASE WHEN {dv} = floor({dv}) THEN CAST({dv} AS BIGINT) END"
            bad = f"({val} IS NULL AND {kind} <> 'null')"
        elif f.kind == "bool":
            lt = f"lower({text})"
            val = (f"CASE WHEN {kind} = 'boolean' THEN CAST({text} AS BOOLEAN) "
                   f"WHEN {kind} <> 'null' AND {lt} IN ({', '.join(repr(x) for x in PZ._LAX_TRUE)}) THEN true "
                   f"WHEN {kind} <> 'null' AND {lt} IN ({', '.join(repr(x) for x in PZ._LAX_FALSE)}) THEN false END")
            bad = f"({val} IS NULL AND {kind} <> 'null')"
        elif f.kind == "list":
            val = f"CASE WHEN {kind} = 'array' THEN CAST(json_extract(jc, {p}) AS VARCHAR[]) END"
            bad = f"({val} IS NULL AND {kind} <> 'null')"
        elif f.kind == "obj":
            val = f"CASE WHEN {kind} = 'object' THEN CAST(json_extract(jc, {p}) AS VARCHAR) END"
            bad = f"({kind} <> 'object')"
        else:
            val = f"CASE WHEN {kind} = 'object' THEN true END"
            bad = f"({kind} <> 'object')"
        miss = "NULL" if f.missing is PZ.REQUIRED else _sql_lit(f.missing, f.kind)
        value = f"CASE WHEN {present} THEN {val} ELSE {miss} END"
        if f.empty_to_null:
            value = f"nullif({value}, '')"
        fb = _sql_lit(f.fallback, f.kind)
        out = f"CASE WHEN is_fallback THEN {fb} ELSE CAST({value} AS {_SQL_TYPES[f.kind]}) END"
        if f.kind == "list":
            out = f"to_json({out})"
        sel.append(f"{out} AS {f.out}")
        if spec.validate:
            conds = []
            if f.missing is PZ.REQUIRED:
                conds.append(f"WHEN NOT {present} THEN '{f.path}: missing'")
            if not f.nullable:
                conds.append(f"WHEN {present} AND {kind} = 'null' THEN '{f.path}: null'")
            conds.append(f"WHEN {present} AND {kind} <> 'null' AND {bad} THEN '{f.path}: type'")
            if f.lo is not None:
                conds.append(f"WHEN {present} AND ({val} < {f.lo} OR {val} > {f.hi}) THEN '{f.path}: range'")
            errs.append(f"CASE WHEN NOT is_fallback THEN CASE {' '.join(conds)} END END")
    err = f"coalesce({', '.join(errs)})" if errs else "CAST(NULL AS VARCHAR)"
    inputs = ", ".join(n for n, _ in _INPUT_SQL)
    return f"""WITH {raw_outputs_sql(spec)},
c AS (SELECT *, CASE WHEN starts_with({_STRIP}, '{{') THEN raw
                     ELSE nullif(regexp_extract(coalesce(raw, ''), '(?s)\\{{.*\\}}', 0), '') END AS cand
      FROM raw_outputs),
v0 AS (SELECT *, NOT coalesce(CASE WHEN json_valid(cand) THEN starts_with(ltrim(cand), '{{') END, false) AS is_fallback
      FROM c),
v AS (SELECT *, CASE WHEN NOT is_fallback THEN cand END AS jc FROM v0)
SELECT event_id, {inputs}, raw, {', '.join(sel)}, is_fallback, {err} AS error FROM v"""


def _make(name: str):
    spec = PZ.SPECS[name]

    def build(spark, d):
        out = PZ.parse_model_output(raw_outputs(spark, d, spec), spec)
        for f in spec.fields:
            if f.kind == "list":
                out = out.withColumn(f.out, F.to_json(F.col(f.out)))
        return out

    build.__name__ = f"parse_{name}_output"
    register(f"parse_{name}_output", parse_sql(spec))(build)


for _name in PZ.SPECS:
    _make(_name)


# ------------------------------------------------------------- values outside their domains
def _warning_sql(name: str) -> str:
    parts = ", ".join(f"CASE WHEN {c} NOT IN ({', '.join(repr(v) for v in values)}) THEN '{c}: ' || {c} END"
                      for c, values in PZ.DOMAINS[name].items())
    return (f"SELECT event_id, '{name}' AS spec, unnest(list_filter([{parts}], lambda x: x IS NOT NULL)) AS warning "
            f"FROM ({parse_sql(PZ.SPECS[name])})")


@register("domain_warnings", "\nUNION ALL\n".join(_warning_sql(n) for n in PZ.DOMAINS))
def domain_warnings(spark, d):
    """Values of parsed answers that no prompt offers; the answers themselves stay."""
    out = None
    for name in PZ.DOMAINS:
        parsed = PZ.domain_warnings(PZ.parse_model_output(raw_outputs(spark, d, PZ.SPECS[name]), name), name)
        # an outer generator, as an inner one's filter on the list's size is pushed down to the events and
        # there repeats the whole parse for every use of it
        part = parsed.select("event_id", F.lit(name).alias("spec"), F.explode_outer("warnings").alias("warning")).where(
            F.col("warning").isNotNull())
        out = part if out is None else out.unionByName(part)
    return out
