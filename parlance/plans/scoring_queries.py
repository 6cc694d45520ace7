"""Rule-table scoring queries (#59-#60g) over conversations, questions and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import scoring as S
from parlance.plans import catalog_queries as CQ
from parlance.plans.registry import register
from parlance.sources import bindings as B
from parlance.sources.tables import read_table

_TOK = r"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) > 0)"


def _lit_list(terms) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def _hits(toks: str, terms) -> str:
    return f"len(list_filter({toks}, lambda t: list_contains({_lit_list(terms)}, t)))"


def _argmax_sql(scores: dict, fallback: str) -> tuple[str, str]:
    top = f"greatest({', '.join(scores.values())})"
    total = " + ".join(scores.values())
    chain = " ".join(f"WHEN {s} = {top} THEN '{n}'" for n, s in scores.items())
    label = f"CASE WHEN {top} > 0 THEN CASE {chain} END ELSE '{fallback}' END"
    share = f"CASE WHEN {top} > 0 THEN round({top} / ({total}), 6) END"
    return label, share


def _scores_sql(toks: str, rules: dict) -> dict:
    return {n: _hits(toks, terms) for n, terms in rules.items()}


# ------------------------------------------------------------------ #59
def _intent_sql():
    label, share = _argmax_sql(_scores_sql("toks", S.INTENT_RULES), S.FALLBACK_INTENT)
    return B.with_ctes("messages_short") + f""",
u AS (SELECT session_id, msg_id, {_TOK.format(x='content')} AS toks FROM messages_short WHERE role = 'user')
SELECT session_id, msg_id, {label} AS intent_code, coalesce({share}, {S.FALLBACK_CONFIDENCE}) AS confidence FROM u"""


@register("intent_scores", _intent_sql())
def intent_scores(spark, d):
    m = B.messages_short(spark, d).where(F.col("role") == "user")
    return S.intent_scores(m, "content").select("session_id", "msg_id", "intent_code", "confidence")


# ------------------------------------------------------------------ #60
def _emotion_sql():
    emo = _scores_sql("toks", S.EMOTION_RULES)
    flags = _scores_sql("toks", S.FLAG_RULES)
    cols = ",\n       ".join(f"CAST(least(1.0, {s} * {S.EMOTION_STEP}) AS DOUBLE) AS {n}" for n, s in emo.items())
    fcols = ",\n       ".join(f"{s} > 0 AS {n}" for n, s in flags.items())
    any_flag = " OR ".join(S.FLAG_RULES)
    return B.with_ctes("messages_short") + f""",
u AS (SELECT session_id, msg_id, {_TOK.format(x='content')} AS toks FROM messages_short WHERE role = 'user'),
e AS (SELECT session_id, msg_id,
       {cols},
       {fcols} FROM u)
SELECT *, 1.0 - greatest({', '.join(S.EMOTION_RULES)}) AS neutral,
       CASE WHEN greatest(frustration, anger) > 0.7 THEN 'high'
            WHEN greatest(frustration, anger) > 0.4 OR {any_flag} THEN 'medium' ELSE 'low' END AS risk_level
FROM e"""


@register("emotion_policy_scores", _emotion_sql())
def emotion_policy_scores(spark, d):
    m = B.messages_short(spark, d).where(F.col("role") == "user").select("session_id", "msg_id", "content")
    return S.emotion_policy_scores(m, "content").drop("content")


# ------------------------------------------------------------------ #60b
def _requirement_sql():
    vocab = _lit_list(S.REQUIREMENT_TERMS)
    implied = ", ".join(f"CASE WHEN list_has_any(seen, {_lit_list(trig)}) THEN '{n}' END"
                        for n, trig in S.IMPLIED_RULES.items())
    service, _ = _argmax_sql(_scores_sql("toks", S.SERVICE_RULES), "information")
    return B.with_ctes("messages_short") + f""",
t AS (SELECT session_id, msg_id, ts, {_TOK.format(x='content')} AS toks FROM messages_short),
h AS (SELECT *, list_distinct(list_filter(toks, lambda x: list_contains({vocab}, x))) AS hit FROM t),
h2 AS (SELECT *, list_distinct(flatten(coalesce(list(hit) OVER (PARTITION BY session_id ORDER BY ts, msg_id
                 ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING), []))) AS hist FROM h),
h3 AS (SELECT *, list_distinct(list_concat(hit, hist)) AS seen FROM h2)
SELECT session_id, msg_id, array_to_string(list_sort(hit), ',') AS explicit_requirements,
       array_to_string(list_sort(list_distinct(list_concat(list_filter(hist, lambda x: NOT list_contains(hit, x)),
           list_filter([{implied}], lambda x: x IS NOT NULL)))), ',') AS implicit_requirements,
       {service} AS service_type
FROM h3"""


@register("requirement_terms", _requirement_sql())
def requirement_terms(spark, d):
    out = S.requirement_terms(B.messages_short(spark, d))
    return out.select("session_id", "msg_id", F.array_join("explicit_requirements", ",").alias("explicit_requirements"),
                      F.array_join("implicit_requirements", ",").alias("implicit_requirements"), "service_type")


# ------------------------------------------------------------------ #60c
_SUCC = dict(zip(B.STAGE_NAMES[:-1], B.STAGE_NAMES[1:]))


def _stage_sql():
    node, conf = _argmax_sql(_scores_sql("toks", S.STAGE_RULES), B.STAGE_NAMES[0])
    succ = "CASE n " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _SUCC.items()) + " END"
    return B.with_ctes("messages_short") + f""",
t AS (SELECT session_id, msg_id, {_TOK.format(x='content')} AS toks FROM messages_short),
c AS (SELECT session_id, msg_id, {node} AS n, coalesce({conf}, {S.FALLBACK_CONFIDENCE}) AS confidence FROM t)
SELECT session_id, msg_id, n AS current_sales_node,
       array_to_string(list_filter([n, {succ}], lambda x: x IS NOT NULL), ',') AS allowed_next_nodes, confidence
FROM c"""


@register("stage_classification", _stage_sql())
def stage_classification(spark, d):
    out = S.stage_classification(B.messages_short(spark, d), B.STAGE_NAMES, _SUCC)
    return out.select("session_id", "msg_id", "current_sales_node",
                      F.array_join("allowed_next_nodes", ",").alias("allowed_next_nodes"), "confidence")


# ------------------------------------------------------------------ #60d
@register("combo_ranking", CQ._LISTING_SQL + f""",
qt AS (SELECT q_id, shop_id, lower(coalesce(text, '')) AS low, {_TOK.format(x='text')} AS toks FROM q),
sc AS (SELECT qt.q_id, c.combo_id, c.position, c.stock,
              CAST(instr(qt.low, c.token) > 0 AS INTEGER) AS explicit,
              len(list_intersect(string_split(c.token, ' '), qt.toks)) AS implicit
       FROM qt JOIN cands c ON qt.shop_id = c.shop_id),
best AS (SELECT q_id, arg_min(combo_id, (-explicit, -implicit, -stock, position)) AS best_combo FROM sc
         WHERE stock > 0 AND (explicit > 0 OR implicit > 0) GROUP BY q_id)
SELECT q.q_id, b.best_combo FROM q LEFT JOIN best b ON q.q_id = b.q_id""")
def combo_ranking(spark, d):
    return S.combo_ranking(B.product_questions(spark, d), CQ._candidates(spark, d)).select("q_id", "best_combo")


# ------------------------------------------------------------------ #60e
def _responses(spark, d):
    li = read_table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = B.products(spark, d)
    j = li.join(p, li.l_partkey == p.id)
    quoted = F.when(F.col("l_linenumber") % 3 == 0, F.col("price") + 1).otherwise(F.col("price")).cast("decimal(10,2)")
    resp = F.concat(F.lit("Giá "), F.col("name"), F.lit(" là "), quoted.cast("string"), F.lit(" đ"),
                    F.when(F.col("l_linenumber") == 7, F.lit(" miễn phí vận chuyển")).otherwise(F.lit("")))
    return j.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("q_id"),
                    resp.alias("response"), F.col("price").alias("catalog_price"),
                    F.col("stock_quantity").alias("stock"))


@register("response_claim_check", B.with_ctes("products") + f""",
r AS (SELECT concat_ws('-', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey) AS q_id,
             'Giá ' || p.name || ' là ' ||
             CAST(CAST(CASE WHEN l.l_linenumber % 3 = 0 THEN p.price + 1 ELSE p.price END AS DECIMAL(10,2)) AS VARCHAR)
             || ' đ' || CASE WHEN l.l_linenumber = 7 THEN ' miễn phí vận chuyển' ELSE '' END AS response,
             p.price AS catalog_price, p.stock_quantity AS stock
      FROM lineitem l JOIN products p ON l.l_partkey = p.id),
c AS (SELECT *, ({' OR '.join(f"instr(lower(response), '{b}') > 0" for b in S.BANNED_PHRASES)}) AS banned,
             list_transform(regexp_extract_all(response, '{S.PRICE_RE}', 1), lambda x: CAST(replace(
               CASE WHEN regexp_full_match(x, '[0-9]+([.,][0-9]{{3}})+') THEN regexp_replace(x, '[.,]', '', 'g') ELSE x END,
               ',', '.') AS DECIMAL(14,2))) AS quoted
      FROM r),
d AS (SELECT *, CASE WHEN banned THEN 'banned phrase' WHEN len(list_filter(quoted, lambda x: x <> catalog_price)) > 0 THEN 'price mismatch'
                     WHEN stock <= 0 THEN 'out of stock offered' END AS reason_recheck FROM c)
SELECT q_id, NOT banned AS approved, reason_recheck IS NOT NULL AND NOT banned AS sales_doublecheck, reason_recheck
FROM d""")
def response_claim_check(spark, d):
    return S.response_claim_check(_responses(spark, d)).select("q_id", "approved", "sales_doublecheck",
                                                               "reason_recheck")


# ------------------------------------------------------------------ #60f
@register("user_info_extract", f"""
WITH x AS (SELECT source, doc_id,
             nullif(regexp_extract(text, '{S.EMAIL_RE}', 0), '') AS email,
             nullif(regexp_extract(text, '{S.PHONE_RE}', 0), '') AS phone,
             nullif(regexp_extract(text, '{S.NAME_RE}', 1), '') AS name,
             list_distinct(list_filter({_TOK.format(x='text')}, lambda t: list_contains({_lit_list(S.INTEREST_TERMS)}, t))) AS ints
           FROM documents)
SELECT source, arg_max(name, doc_id) FILTER (WHERE name IS NOT NULL) AS name,
       arg_max(phone, doc_id) FILTER (WHERE phone IS NOT NULL) AS phone,
       arg_max(email, doc_id) FILTER (WHERE email IS NOT NULL) AS email,
       array_to_string(list_sort(list_distinct(flatten(list(ints)))), ',') AS interests
FROM x GROUP BY source""")
def user_info_extract(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "source", "text")
    out = S.user_info_extract(docs, "source", ["doc_id"])
    return out.select("source", "name", "phone", "email", F.array_join("interests", ",").alias("interests"))


# ------------------------------------------------------------------ #60g
@register("conversation_topics", B.with_ctes("messages_short") + f""",
toks AS (SELECT session_id, msg_id, unnest({_TOK.format(x='content')}) AS term FROM messages_short),
tf AS (SELECT session_id, term, count(*) AS tf FROM toks GROUP BY session_id, term),
n AS (SELECT count(DISTINCT session_id) AS n FROM messages_short),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
tfidf AS (SELECT tf.session_id, tf.term, round(tf.tf * ln(CAST(n.n AS DOUBLE) / dfs.df), 9) AS tfidf
          FROM tf JOIN dfs ON tf.term = dfs.term CROSS JOIN n),
tags AS (SELECT session_id, string_agg(term, ',' ORDER BY r) AS tags FROM (
           SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tfidf DESC, term) AS r FROM tfidf)
         WHERE r <= 5 GROUP BY session_id),
s0 AS (SELECT session_id, msg_id, ts, unnest(l) AS sentence, unnest(range(len(l))) AS spos
       FROM (SELECT *, regexp_extract_all(content, '[^.!?]+[.!?]*') AS l FROM messages_short)),
s1 AS (SELECT session_id, msg_id, ts, spos, regexp_replace(sentence, '^\\s+|\\s+$', '', 'g') AS sentence FROM s0),
s2 AS (SELECT session_id, msg_id, ts, spos, sentence, unnest({_TOK.format(x='sentence')}) AS term FROM s1
       WHERE length(sentence) > 0),
sc AS (SELECT s2.session_id, msg_id, ts, spos, sentence, round(sum(t.tfidf), 6) AS score
       FROM s2 JOIN tfidf t ON s2.session_id = t.session_id AND s2.term = t.term
       GROUP BY s2.session_id, msg_id, ts, spos, sentence),
best AS (SELECT session_id, string_agg(sentence, ' ' ORDER BY ts, msg_id, spos) AS summary FROM (
           SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, ts, msg_id, spos) AS r FROM sc)
         WHERE r <= 2 GROUP BY session_id)
SELECT tags.session_id, tags.tags, best.summary FROM tags LEFT JOIN best ON tags.session_id = best.session_id""")
def conversation_topics(spark, d):
    out = S.conversation_topics(B.messages_short(spark, d))
    return out.select("session_id", F.array_join("tags", ",").alias("tags"), "summary")
