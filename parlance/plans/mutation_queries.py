"""Keyed mutation queries (#6-#8, #12, #61-#65, #71) over tables derived from the driver data."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.ids import uuid5_dns
from parlance.operators import cascade as CD
from parlance.operators import mutations as X
from parlance.operators import parsing as PZ
from parlance.plans import memory_queries as MQ
from parlance.plans import parsing_queries as PQ
from parlance.plans.registry import register
from parlance.plans.sqlfn import canonical_uuid_sql, iso_sql, uuid5_sql
from parlance.sources import bindings as B
from parlance.sources.tables import read_table

NOW = B.EVENTS_AS_OF_EPOCH


# ------------------------------------------------------------------ #6 archive rows
@register("archive_append", MQ._SMALL_LONG + f"""
SELECT {uuid5_sql("'msg/' || CAST(session_id AS VARCHAR) || '/' || CAST(msg_id AS VARCHAR)")} AS id,
       {uuid5_sql("CAST(session_id AS VARCHAR)")} AS session_id, role, content,
       CAST(coalesce(tokens, 0) AS INTEGER) AS token_count, {iso_sql('ts')} AS created_at
FROM disp WHERE disposition = 'archived'""")
def archive_append(spark, d):
    arch = MQ._disp_small_long(spark, d).where(F.col("disposition") == "archived")
    return X.archive_rows(arch)


# ------------------------------------------------------------------ #7 replace partitions
def _new_catalog(spark, d):
    """Replacement catalogs: shops whose name ends in 3 re-list only their small parts, at double price."""
    p = B.products(spark, d)
    return (p.where(F.col("shop_id").endswith("3")).join(
        read_table(spark, d, "part", "p_partkey", "p_size").where(F.col("p_size") < 25),
        F.col("id") == F.col("p_partkey"), "left_semi")
        .withColumn("price", (F.col("price") * 2).cast("decimal(10,2)")))


@register("replace_partition", B.with_ctes("products") + """,
new_rows AS (SELECT p.id, p.shop_id, p.name, p.sku, p.stock_quantity, CAST(p.price * 2 AS DECIMAL(10,2)) AS price
             FROM products p JOIN part q ON p.id = q.p_partkey
             WHERE ends_with(p.shop_id, '3') AND q.p_size < 25)
SELECT id, shop_id, CAST(price AS DOUBLE) AS price FROM products
WHERE shop_id NOT IN (SELECT DISTINCT shop_id FROM new_rows)
UNION ALL SELECT id, shop_id, CAST(price AS DOUBLE) FROM new_rows""")
def replace_partition(spark, d):
    out = X.replace_partitions(B.products(spark, d), _new_catalog(spark, d))
    return out.select("id", "shop_id", F.col("price").cast("double").alias("price"))


@register("replace_partition_cleared", B.with_ctes("products") + """
SELECT id, shop_id, CAST(CASE WHEN ends_with(shop_id, '4') THEN price * 2 ELSE price END AS DOUBLE) AS price
FROM products WHERE NOT ends_with(shop_id, '2') AND (NOT ends_with(shop_id, '4') OR stock_quantity > 3)""")
def replace_partition_cleared(spark, d):
    """Shops whose name ends in 4 are listed anew, those in 2 have nothing any more."""
    p = B.products(spark, d)
    new = p.where(F.col("shop_id").endswith("4") & (F.col("stock_quantity") > 3)).withColumn(
        "price", (F.col("price") * 2).cast("decimal(10,2)"))
    asked = B.shops(spark, d).select(F.col("id").alias("shop_id")).where(
        F.col("shop_id").endswith("4") | F.col("shop_id").endswith("2"))
    out = X.replace_partitions(p, new, replaced=asked)
    return out.select("id", "shop_id", F.col("price").cast("double").alias("price"))


# ------------------------------------------------------------------ #8 insert if absent
@register("insert_if_absent", """
WITH existing AS (SELECT DISTINCT conv_id AS id, 'conversation' AS source FROM conversations),
incoming AS (SELECT DISTINCT user_id AS id, 'events' AS source FROM events)
SELECT * FROM existing UNION ALL
SELECT * FROM incoming WHERE id NOT IN (SELECT id FROM existing)""")
def insert_if_absent(spark, d):
    existing = read_table(spark, d, "conversations", "conv_id").select(
        F.col("conv_id").alias("id"), F.lit("conversation").alias("source")).distinct()
    incoming = read_table(spark, d, "events", "user_id").select(
        F.col("user_id").alias("id"), F.lit("events").alias("source"))
    return X.insert_if_absent(existing, incoming, ["id"])


# ------------------------------------------------------------------ #12 session lookup
def _session_uuid(c):
    return uuid5_dns(F.concat(F.lit("user/"), c.cast("string")))


@register("session_lookup", f"""
WITH s AS (SELECT DISTINCT user_id FROM events WHERE user_id % 5 <> 0),
sessions AS (SELECT {uuid5_sql("'user/' || CAST(user_id AS VARCHAR)")} AS id, user_id FROM s),
req AS (SELECT event_id, CASE event_id % 4
          WHEN 0 THEN {uuid5_sql("'user/' || CAST(user_id AS VARCHAR)")}
          WHEN 1 THEN upper({uuid5_sql("'user/' || CAST(user_id AS VARCHAR)")})
          WHEN 2 THEN '{{' || {uuid5_sql("'user/' || CAST(user_id AS VARCHAR)")} || '}}'
          ELSE 'user-' || CAST(user_id AS VARCHAR) END AS requested_id FROM events)
SELECT r.event_id, r.requested_id, s.user_id AS session_user_id
FROM req r LEFT JOIN sessions s ON {canonical_uuid_sql('r.requested_id')} = s.id""")
def session_lookup(spark, d):
    ev = read_table(spark, d, "events", "event_id", "user_id")
    sessions = (ev.select("user_id").where(F.col("user_id") % 5 != 0).distinct()
                .select(_session_uuid(F.col("user_id")).alias("id"), "user_id"))
    u = _session_uuid(F.col("user_id"))
    k = F.col("event_id") % 4
    req = ev.select("event_id", F.when(k == 0, u).when(k == 1, F.upper(u))
                    .when(k == 2, F.concat(F.lit("{"), u, F.lit("}")))
                    .otherwise(F.concat(F.lit("user-"), F.col("user_id").cast("string"))).alias("requested_id"))
    return X.session_lookup(req, sessions).select("event_id", "requested_id", "session_user_id")


# ------------------------------------------------------------------ #61 cascade delete
def _domain(spark, d):
    shops = B.shops(spark, d)
    products = B.products(spark, d)
    customers = read_table(spark, d, "customer", "c_custkey", "c_nationkey").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string"))
        .alias("shop_id"))
    stages = B.stages(spark, d).withColumn("stage_id", F.concat_ws("/", "shop_id", F.col("step_order").cast("string")))
    documents = read_table(spark, d, "documents", "doc_id").select(F.col("doc_id").alias("id"),
                                                                    F.col("doc_id").alias("product_id"))
    ev_users = read_table(spark, d, "events", "user_id").select("user_id").distinct()
    sessions = ev_users.select(
        F.col("user_id").alias("id"),
        F.when(F.col("user_id") % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string"), F.lit("/"),
                             (F.col("user_id") % 7).cast("string"))).alias("current_stage_id"))
    messages = B.messages_long(spark, d).select("session_id", "msg_id")
    return shops, products, customers, stages, documents, sessions, messages


def _cascade_inputs(spark, d):
    shops, products, customers, stages, documents, sessions, messages = _domain(spark, d)
    doomed_shops = shops.where(F.col("id").endswith("1"))
    doomed_sessions = sessions.where(F.col("id") % 4 == 0)
    return X.cascade_delete(shops, products, customers, stages, documents, sessions, messages,
                            doomed_shops, doomed_sessions)


@register("cascade_delete", B.with_ctes("products", "shops", "stages") + """,
ds AS (SELECT id AS shop_id FROM shops WHERE ends_with(id, '1')),
cust AS (SELECT c_custkey AS id, 'Brand#' || CAST(c_nationkey + 1 AS VARCHAR) AS shop_id FROM customer),
st AS (SELECT *, shop_id || '/' || CAST(step_order AS VARCHAR) AS stage_id FROM stages),
sess AS (SELECT DISTINCT user_id AS id,
                CASE WHEN user_id % 7 = 0 THEN NULL
                     ELSE 'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR) || '/' || CAST(user_id % 7 AS VARCHAR) END
                  AS current_stage_id FROM events),
dss AS (SELECT id FROM sess WHERE id % 4 = 0),
gone_products AS (SELECT id FROM products WHERE shop_id IN (SELECT shop_id FROM ds)),
gone_stages AS (SELECT stage_id FROM st WHERE shop_id IN (SELECT shop_id FROM ds))
SELECT 'shops' AS tbl, count(*) AS kept FROM shops WHERE id NOT IN (SELECT shop_id FROM ds)
UNION ALL SELECT 'products', count(*) FROM products WHERE shop_id NOT IN (SELECT shop_id FROM ds)
UNION ALL SELECT 'documents', count(*) FROM documents WHERE doc_id NOT IN (SELECT id FROM gone_products)
UNION ALL SELECT 'customers', count(*) FROM cust WHERE shop_id NOT IN (SELECT shop_id FROM ds)
UNION ALL SELECT 'stages', count(*) FROM st WHERE shop_id NOT IN (SELECT shop_id FROM ds)
UNION ALL SELECT 'sessions', count(*) FROM sess WHERE id NOT IN (SELECT id FROM dss)
UNION ALL SELECT 'sessions_with_stage', count(*) FROM sess WHERE id NOT IN (SELECT id FROM dss)
    AND current_stage_id IS NOT NULL AND current_stage_id NOT IN (SELECT stage_id FROM gone_stages)
UNION ALL SELECT 'messages', count(*) FROM events WHERE user_id NOT IN (SELECT id FROM dss)""")
def cascade_delete(spark, d):
    t = _cascade_inputs(spark, d)
    parts = [t[n].agg(F.count(F.lit(1)).alias("kept")).select(F.lit(n).alias("tbl"), "kept")
             for n in ["shops", "products", "documents", "customers", "stages", "sessions", "messages"]]
    parts.append(t["sessions"].where(F.col("current_stage_id").isNotNull())
                 .agg(F.count(F.lit(1)).alias("kept")).select(F.lit("sessions_with_stage").alias("tbl"), "kept"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _contract_tables(spark, d):
    """The domain tables by their contract names, each with an ``id``."""
    shops, products, customers, stages, documents, sessions, messages = _domain(spark, d)
    return {"shops": shops.select("id"), "products": products.select("id", "shop_id"), "customers": customers,
            "sales_pipelines": stages.select(F.col("stage_id").alias("id"), "shop_id"), "documents": documents,
            "sessions": sessions, "messages": messages.select(F.col("msg_id").alias("id"), "session_id")}


def _doomed(tables):
    return {"shops": tables["shops"].where(F.col("id").endswith("1")).select(F.col("id").alias("key")),
            "sessions": tables["sessions"].where(F.col("id") % 4 == 0).select(F.col("id").alias("key")),
            "documents": tables["documents"].where(F.col("id") % 10 == 3).select(F.col("id").alias("key"))}


_CASCADE_CTES = B.with_ctes("products", "shops", "stages") + """,
cust AS (SELECT c_custkey AS id, 'Brand#' || CAST(c_nationkey + 1 AS VARCHAR) AS shop_id FROM customer),
st AS (SELECT shop_id || '/' || CAST(step_order AS VARCHAR) AS id, shop_id FROM stages),
sess AS (SELECT DISTINCT user_id AS id,
                CASE WHEN user_id % 7 = 0 THEN NULL
                     ELSE 'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR) || '/' || CAST(user_id % 7 AS VARCHAR) END
                  AS stage FROM events)"""


@register("cascade_rows", _CASCADE_CTES + """
SELECT 'shops' AS tbl, id, CAST(NULL AS VARCHAR) AS ref, ends_with(id, '1') AS gone FROM shops
UNION ALL SELECT 'products', CAST(id AS VARCHAR), shop_id, ends_with(shop_id, '1') FROM products
UNION ALL SELECT 'customers', CAST(id AS VARCHAR), shop_id, ends_with(shop_id, '1') FROM cust
UNION ALL SELECT 'sales_pipelines', id, shop_id, ends_with(shop_id, '1') FROM st
UNION ALL SELECT 'documents', CAST(d.doc_id AS VARCHAR), CAST(d.doc_id AS VARCHAR),
  d.doc_id % 10 = 3 OR coalesce(ends_with(p.shop_id, '1'), false) FROM documents d LEFT JOIN products p ON p.id = d.doc_id
UNION ALL SELECT 'sessions', CAST(s.id AS VARCHAR),
  CASE WHEN coalesce(ends_with(st.shop_id, '1'), false) THEN NULL ELSE s.stage END, s.id % 4 = 0
  FROM sess s LEFT JOIN st ON st.id = s.stage
UNION ALL SELECT 'messages', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), user_id % 4 = 0 FROM events""")
def cascade_rows(spark, d):
    """#61 by the declared keys: every row of every table, whether it goes, and its reference afterwards."""
    tables = _contract_tables(spark, d)
    done, out = CD.cascade(tables, _doomed(tables)), None
    for name, rows in done.items():
        ref = next((F.col(k.column) for k in CD.FOREIGN_KEYS if k.child == name), F.lit(None))
        part = rows.select(F.lit(name).alias("tbl"), F.col("id").cast("string").alias("id"), ref.cast("string").alias("ref"),
                           F.col("_gone").alias("gone"))
        out = part if out is None else out.unionByName(part)
    return out


@register("fk_orphans_plain_delete", _CASCADE_CTES + """
SELECT 'products.shop_id' AS fk, shop_id AS child_key, count(*) AS n FROM products WHERE ends_with(shop_id, '1') GROUP BY ALL
UNION ALL SELECT 'customers.shop_id', shop_id, count(*) FROM cust
  WHERE ends_with(shop_id, '1') OR shop_id NOT IN (SELECT id FROM shops) GROUP BY ALL
UNION ALL SELECT 'sales_pipelines.shop_id', shop_id, count(*) FROM st WHERE ends_with(shop_id, '1') GROUP BY ALL
UNION ALL SELECT 'documents.product_id', CAST(doc_id AS VARCHAR), count(*) FROM documents
  WHERE doc_id % 10 <> 3 AND doc_id NOT IN (SELECT id FROM products) GROUP BY ALL
UNION ALL SELECT 'sessions.current_stage_id', stage, count(*) FROM sess
  WHERE id % 4 <> 0 AND stage IS NOT NULL AND stage NOT IN (SELECT id FROM st) GROUP BY ALL
UNION ALL SELECT 'messages.session_id', CAST(user_id AS VARCHAR), count(*) FROM events WHERE user_id % 4 = 0 GROUP BY ALL""")
def fk_orphans_plain_delete(spark, d):
    """#4: the references that break if the doomed rows go alone, without following the keys."""
    tables = _contract_tables(spark, d)
    alone = CD.kept(CD.cascade(tables, _doomed(tables), keys=[]))
    return CD.orphans(alone)


# ------------------------------------------------------------------ #62 upsert handoff reason
def _session_updates(spark, d):
    """Every event is a session update: reason (null when id % 3 = 0), stage, props as metadata."""
    ev = read_table(spark, d, "events", "event_id", "ts", "user_id", "props")
    return ev.select(
        F.col("user_id").alias("id"), B.epoch_seconds(F.col("ts")).alias("ts"), F.col("event_id").alias("msg_id"),
        F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("reason-"), F.col("event_id").cast("string"))).alias("handoff_reason"),
        F.when(F.col("event_id") % 2 == 0, F.lit(None).cast("bigint"))
         .otherwise(F.col("event_id") % 6 + 1).alias("current_stage_id"),
        F.col("props").alias("metadata"))


_UPDATES_SQL = """
upd AS (SELECT user_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS msg_id,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'reason-' || CAST(event_id AS VARCHAR) END AS handoff_reason,
               CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_id % 6 + 1 END AS current_stage_id,
               props AS metadata
        FROM events)"""


@register("upsert_handoff_reason", "WITH " + _UPDATES_SQL + """,
existing AS (SELECT DISTINCT conv_id AS id, conv_id AS user_id, 'initial' AS handoff_reason FROM conversations),
lastu AS (SELECT id, arg_max_null(handoff_reason, (ts, msg_id)) AS r FROM upd GROUP BY id)
SELECT coalesce(e.id, l.id) AS id, coalesce(e.user_id, l.id) AS user_id,
       CASE WHEN l.id IS NOT NULL THEN l.r ELSE e.handoff_reason END AS handoff_reason,
       e.id IS NULL AS was_inserted, l.id IS NOT NULL AS touched
FROM existing e FULL OUTER JOIN lastu l ON e.id = l.id""")
def upsert_handoff_reason(spark, d):
    existing = read_table(spark, d, "conversations", "conv_id").select(
        F.col("conv_id").alias("id"), F.col("conv_id").alias("user_id"),
        F.lit("initial").alias("handoff_reason")).distinct()
    upd = _session_updates(spark, d)
    out = X.upsert_handoff_reason(existing, upd)
    return out.select("id", "user_id", "handoff_reason", "was_inserted", "touched")


# ------------------------------------------------------------------ #63 update session
def _base_sessions(spark, d):
    ev = read_table(spark, d, "events", "user_id", "ts")
    return (ev.where(F.col("user_id") % 10 != 0).groupBy("user_id").agg(F.max("ts").alias("u"))
            .select(F.col("user_id").alias("id"), F.lit(None).cast("string").alias("handoff_reason"),
                    F.lit(None).cast("bigint").alias("current_stage_id"),
                    F.lit('{"origin": "seed", "k": -1}').alias("metadata"),
                    B.epoch_seconds(F.col("u")).alias("updated_at")))


_BASE_SQL = """
base AS (SELECT user_id AS id, CAST(NULL AS VARCHAR) AS handoff_reason, CAST(NULL AS BIGINT) AS current_stage_id,
                '{"origin": "seed", "k": -1}' AS metadata, CAST(floor(epoch(max(ts))) AS BIGINT) AS updated_at
         FROM events WHERE user_id % 10 <> 0 GROUP BY user_id)"""


@register("update_session", "WITH " + _UPDATES_SQL + "," + _BASE_SQL + f""",
red AS (SELECT id, arg_max(handoff_reason, (ts, msg_id)) FILTER (WHERE handoff_reason IS NOT NULL) AS r,
               arg_max(current_stage_id, (ts, msg_id)) FILTER (WHERE current_stage_id IS NOT NULL) AS st,
               arg_max(CAST(json_extract(metadata, '$.k') AS BIGINT), (ts, msg_id))
                 FILTER (WHERE json_exists(metadata, '$.k')) AS k
        FROM upd GROUP BY id)
SELECT b.id, coalesce(r.r, b.handoff_reason) AS handoff_reason, coalesce(r.st, b.current_stage_id) AS current_stage_id,
       coalesce(r.k, CAST(json_extract(b.metadata, '$.k') AS BIGINT)) AS meta_k,
       json_extract_string(b.metadata, '$.origin') AS meta_origin,
       CASE WHEN r.id IS NOT NULL THEN {NOW} ELSE b.updated_at END AS updated_at
FROM base b LEFT JOIN red r ON b.id = r.id""")
def update_session(spark, d):
    out, _ = X.update_session(_base_sessions(spark, d), _session_updates(spark, d), NOW)
    return out.select("id", "handoff_reason", "current_stage_id",
                      F.get_json_object("metadata", "$.k").cast("bigint").alias("meta_k"),
                      F.get_json_object("metadata", "$.origin").alias("meta_origin"), "updated_at")


@register("update_session_errors", "WITH " + _UPDATES_SQL + "," + _BASE_SQL + """
SELECT DISTINCT id, 'session not found' AS error FROM upd WHERE id NOT IN (SELECT id FROM base)""")
def update_session_errors(spark, d):
    _, errors = X.update_session(_base_sessions(spark, d), _session_updates(spark, d), NOW)
    return errors


# ------------------------------------------------------------------ #64 update session summary
@register("update_session_summary", "WITH " + _BASE_SQL + """,
m AS (SELECT user_id AS id, count(*) AS n, list(DISTINCT event_type ORDER BY event_type) AS types FROM events
      GROUP BY user_id)
SELECT b.id, b.handoff_reason,
       CASE WHEN m.id IS NOT NULL THEN 'session ' || CAST(b.id AS VARCHAR) || ': ' || CAST(m.n AS VARCHAR) || ' events'
            ELSE NULL END AS meta_summary,
       CASE WHEN m.n > 65 THEN array_to_string(m.types, ',') END AS meta_tags,
       json_extract_string(b.metadata, '$.origin') AS meta_origin
FROM base b LEFT JOIN m ON b.id = m.id""")
def update_session_summary(spark, d):
    ev = read_table(spark, d, "events", "user_id", "event_type")
    summ = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"),
                                     F.array_sort(F.collect_set("event_type")).alias("types"))
    summ = summ.select(F.col("user_id").alias("id"),
                       F.concat(F.lit("session "), F.col("user_id").cast("string"), F.lit(": "),
                                F.col("n").cast("string"), F.lit(" events")).alias("summary"),
                       F.when(F.col("n") > 65, F.col("types")).otherwise(F.array().cast("array<string>")).alias("tags"),
                       F.array().cast("array<string>").alias("key_topics"))
    out = X.update_session_summary(_base_sessions(spark, d), summ)
    return out.select("id", "handoff_reason", F.get_json_object("metadata", "$.summary").alias("meta_summary"),
                      F.array_join(F.from_json(F.get_json_object("metadata", "$.tags"), "array<string>"), ",")
                      .alias("meta_tags"),
                      F.get_json_object("metadata", "$.origin").alias("meta_origin"))


# ------------------------------------------------------------------ #65 merge customer info
@register("merge_customer_info", "WITH " + PQ.raw_outputs_sql(PZ.SPECS["user_info"]).replace(
    "raw_outputs AS", "ro AS", 1) + """,
c AS (SELECT *, CASE WHEN starts_with(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), '{') THEN raw
                     ELSE nullif(regexp_extract(raw, '(?s)\\{.*\\}', 0), '') END AS cand FROM ro),
v AS (SELECT event_id, CAST(user_id AS BIGINT) AS customer_id,
             CASE WHEN json_valid(cand) THEN cand END AS jc FROM c),
info AS (SELECT customer_id, event_id, json_extract_string(jc, '$.name') AS name,
                json_extract_string(jc, '$.phone') AS phone, json_extract_string(jc, '$.email') AS email,
                CAST(json_extract(jc, '$.preferences.k') AS BIGINT) AS pref_k
         FROM v WHERE jc IS NOT NULL),
applied AS (SELECT * FROM info WHERE coalesce(name, '') <> '' OR coalesce(phone, '') <> '' OR coalesce(email, '') <> ''),
red AS (SELECT customer_id, arg_max(name, event_id) FILTER (WHERE coalesce(name, '') <> '') AS name,
               arg_max(phone, event_id) FILTER (WHERE coalesce(phone, '') <> '') AS phone,
               arg_max(email, event_id) FILTER (WHERE coalesce(email, '') <> '') AS email,
               arg_max(pref_k, event_id) FILTER (WHERE pref_k IS NOT NULL) AS pref_k
        FROM applied GROUP BY customer_id)
SELECT c.c_custkey AS customer_id, coalesce(r.name, c.c_name) AS full_name, r.phone AS phone, r.email AS email,
       coalesce(r.pref_k, -1) AS pref_k, c.c_mktsegment AS pref_segment
FROM customer c LEFT JOIN red r ON c.c_custkey = r.customer_id""")
def merge_customer_info(spark, d):
    spec = PZ.SPECS["user_info"]
    parsed = PZ.parse_model_output(PQ.raw_outputs(spark, d, spec), spec).where(~F.col("is_fallback"))
    info = parsed.select(F.col("user_id").cast("bigint").alias("customer_id"), F.col("event_id").alias("ts"),
                         F.col("event_id").alias("msg_id"), "name", "phone", "email", "preferences")
    cust = read_table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("full_name"),
        F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("email"),
        F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.lit(-1).alias("k"))).alias("preferences"))
    out = X.merge_customer_info(cust, info)
    return out.select("customer_id", "full_name", "phone", "email",
                      F.get_json_object("preferences", "$.k").cast("bigint").alias("pref_k"),
                      F.get_json_object("preferences", "$.segment").alias("pref_segment"))


# ------------------------------------------------------------------ #71 vector delete
@register("vector_delete", """
SELECT vec_id AS id FROM embeddings
WHERE NOT coalesce(CAST(vec_id % 50 AS VARCHAR) = '7' AND CAST(label AS VARCHAR) = '3', false)""")
def vector_delete(spark, d):
    return X.vector_delete(B.vectors(spark, d), shop_id="3", product_id="7").select("id")


@register("vector_delete_by_shop", """
SELECT vec_id AS id FROM embeddings WHERE NOT coalesce(CAST(label AS VARCHAR) = '5', false)""")
def vector_delete_by_shop(spark, d):
    return X.vector_delete(B.vectors(spark, d), shop_id="5").select("id")



@register("vector_delete_by_doc", """
SELECT vec_id AS id, CASE WHEN vec_id % 9 <> 0 THEN CAST(vec_id % 40 AS VARCHAR) END AS doc_id FROM embeddings
WHERE NOT coalesce(CASE WHEN vec_id % 9 <> 0 THEN CAST(vec_id % 40 AS VARCHAR) END = '17', false)""")
def vector_delete_by_doc(spark, d):
    """All vectors of a document go; those without a document stay."""
    v = B.vectors(spark, d).select("id", F.when(F.col("id") % 9 != 0, (F.col("id") % 40).cast("string")).alias("doc_id"))
    return X.vector_delete(v, doc_id="17")
