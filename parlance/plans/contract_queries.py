"""Contract queries (#2-#5) on domain tables derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import contracts as K
from parlance.plans.registry import register
from parlance.plans.sqlfn import uuid5_sql
from parlance.sources import bindings as B
from parlance.sources.tables import DOMAIN_SCHEMAS, read_table

MAX_CONTENT = 1000   # message content length limit checked by the contract
MAX_SKU = 12         # sku length limit checked by the contract


@register("contract_violations", B.with_ctes("messages_short") + f"""
SELECT session_id, msg_id, rule FROM (
  SELECT session_id, msg_id, unnest(list_filter([
    CASE WHEN role IS NULL THEN 'role: not null' END,
    CASE WHEN role IS NOT NULL AND role NOT IN ('user', 'assistant', 'system', 'tool') THEN 'role: domain' END,
    CASE WHEN content IS NULL THEN 'content: not null' END,
    CASE WHEN length(content) > {MAX_CONTENT} THEN 'content: length <= {MAX_CONTENT}' END,
    CASE WHEN tokens < 0 THEN 'tokens: >= 0' END], lambda x: x IS NOT NULL)) AS rule
  FROM messages_short)""")
def contract_violations(spark, d):
    m = B.messages_short(spark, d)
    rules = [K.not_null("role"), K.in_domain("role", K.ROLES), K.not_null("content"),
             K.max_length("content", MAX_CONTENT), K.at_least("tokens", 0)]
    return K.contract_violations(m, ["session_id", "msg_id"], rules)


@register("contract_violations_products", B.with_ctes("products") + f"""
SELECT id, rule FROM (
  SELECT id, unnest(list_filter([
    CASE WHEN name IS NULL THEN 'name: not null' END,
    CASE WHEN price < 0 THEN 'price: >= 0' END,
    CASE WHEN stock_quantity < 0 THEN 'stock_quantity: >= 0' END,
    CASE WHEN length(sku) > {MAX_SKU} THEN 'sku: length <= {MAX_SKU}' END], lambda x: x IS NOT NULL)) AS rule
  FROM products)""")
def contract_violations_products(spark, d):
    p = B.products(spark, d)
    rules = [K.not_null("name"), K.at_least("price", 0), K.at_least("stock_quantity", 0), K.max_length("sku", MAX_SKU)]
    return K.contract_violations(p, ["id"], rules)


def _raw_messages(spark, d):
    """Events as message rows as a client sends them, with required values missing here and there."""
    ev = read_table(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    n = F.col("event_id")
    unless = lambda k, c: F.when(n % k != 0, c)
    return ev.select(
        "event_id", unless(7, F.concat(F.lit("m-"), n.cast("string"))).alias("id"),
        unless(29, F.col("user_id").cast("string")).alias("session_id"), unless(13, F.lit("user")).alias("role"),
        unless(11, F.col("event_type")).alias("content"), unless(5, F.unix_timestamp("ts")).alias("created_at"))


@register("contract_violations_schema", """
SELECT event_id, rule FROM (SELECT event_id, unnest(list_filter([
    CASE WHEN event_id % 7 = 0 THEN 'id: not null' END, CASE WHEN event_id % 29 = 0 THEN 'session_id: not null' END,
    CASE WHEN event_id % 13 = 0 THEN 'role: not null' END, CASE WHEN event_id % 11 = 0 THEN 'content: not null' END,
    CASE WHEN event_id % 5 = 0 THEN 'created_at: not null' END], lambda x: x IS NOT NULL)) AS rule FROM events)""")
def contract_violations_schema(spark, d):
    """#2 by the declared schema of the message table."""
    return K.contract_violations(_raw_messages(spark, d), ["event_id"], K.schema_rules(DOMAIN_SCHEMAS["messages"]))


@register("insert_defaults", f"""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN {uuid5_sql("'message/' || CAST(event_id AS VARCHAR)")}
                      ELSE 'm-' || CAST(event_id AS VARCHAR) END AS id,
       CASE WHEN event_id % 13 <> 0 THEN 'user' END AS role,
       CASE WHEN event_id % 5 = 0 THEN {B.EVENTS_AS_OF_EPOCH} ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS created_at
FROM events""")
def insert_defaults(spark, d):
    """#5: ids and times of new message rows that leave them out; a missing role has no default."""
    out = K.apply_insert_defaults(_raw_messages(spark, d), "messages", F.lit(B.EVENTS_AS_OF_EPOCH).cast("long"),
                                  F.concat(F.lit("message/"), F.col("event_id").cast("string")))
    return out.select("event_id", "id", "role", "created_at")


@register("insert_defaults_products", f"""
SELECT p_partkey AS part_id, CASE WHEN p_partkey % 4 = 0 THEN {uuid5_sql("'product/' || CAST(p_partkey AS VARCHAR)")}
                                  ELSE CAST(p_partkey AS VARCHAR) END AS id,
       CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END AS stock_quantity
FROM part""")
def insert_defaults_products(spark, d):
    p = read_table(spark, d, "part", "p_partkey", "p_size").select(
        F.col("p_partkey").alias("part_id"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey").cast("string")).alias("id"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("stock_quantity"))
    return K.apply_insert_defaults(p, "products", F.lit(0), F.concat(F.lit("product/"), F.col("part_id").cast("string")))


@register("unique_violations", B.with_ctes("products") + """
SELECT sku, count(*) AS n FROM products WHERE sku IS NOT NULL GROUP BY sku HAVING count(*) > 1""")
def unique_violations(spark, d):
    return K.unique_violations(B.products(spark, d), ["sku"])


@register("unique_violations_lineitem", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def unique_violations_lineitem(spark, d):
    return K.unique_violations(read_table(spark, d, "lineitem", "l_orderkey", "l_linenumber"),
                               ["l_orderkey", "l_linenumber"])


@register("fk_orphans", B.with_ctes("products", "shops", "stages", "sessions", "messages_short") + """
SELECT 'products.shop_id' AS fk, CAST(p.shop_id AS VARCHAR) AS child_key FROM products p
  WHERE p.shop_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM shops s WHERE s.id = p.shop_id)
UNION ALL
SELECT 'customers.shop_id', CAST(c.c_nationkey AS VARCHAR) FROM customer c
  WHERE c.c_nationkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c.c_nationkey)
UNION ALL
SELECT 'documents.product_id', CAST(d.doc_id AS VARCHAR) FROM documents d
  WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = d.doc_id)
UNION ALL
SELECT 'sales_pipelines.shop_id', CAST(st.shop_id AS VARCHAR) FROM stages st
  WHERE NOT EXISTS (SELECT 1 FROM shops s WHERE s.id = st.shop_id)
UNION ALL
SELECT 'sessions.current_stage_id', CAST(se.current_step AS VARCHAR) FROM sessions se
  WHERE se.current_step IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stages st WHERE st.step_order = se.current_step)
UNION ALL
SELECT 'messages.session_id', CAST(m.session_id AS VARCHAR) FROM messages_short m
  WHERE NOT EXISTS (SELECT 1 FROM sessions se WHERE se.id = m.session_id)""")
def fk_orphans(spark, d):
    shops, products, stages, sessions = B.shops(spark, d), B.products(spark, d), B.stages(spark, d), B.sessions(spark, d)
    parts = read_table(spark, d, "part", "p_partkey")
    out = K.fk_orphans(products, "shop_id", shops, "id", "products.shop_id")
    out = out.unionByName(K.fk_orphans(read_table(spark, d, "customer", "c_nationkey"), "c_nationkey",
                                       read_table(spark, d, "nation", "n_nationkey"), "n_nationkey",
                                       "customers.shop_id"))
    out = out.unionByName(K.fk_orphans(read_table(spark, d, "documents", "doc_id"), "doc_id", parts, "p_partkey",
                                       "documents.product_id"))
    out = out.unionByName(K.fk_orphans(stages, "shop_id", shops, "id", "sales_pipelines.shop_id"))
    out = out.unionByName(K.fk_orphans(sessions, "current_step", stages, "step_order", "sessions.current_stage_id"))
    out = out.unionByName(K.fk_orphans(B.messages_short(spark, d), "session_id", sessions, "id",
                                       "messages.session_id"))
    return out


@register("apply_defaults", """
SELECT doc_id, CAST(doc_id AS BIGINT) AS product_id, 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS file_name,
       coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL WHEN lang = 'de' THEN 'archived' ELSE 'active' END, 'active') AS status
FROM documents""")
def apply_defaults(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "lang")
    raw = docs.select("doc_id", F.col("doc_id").alias("product_id"),
                      F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
                      F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string"))
                       .when(F.col("lang") == "de", "archived").otherwise("active").alias("status"))
    return K.apply_defaults(raw, {"status": "active"})



# ------------------------------------------------------------------ #1 load tables
def _load_tables_sql():
    from parlance.sources.tables import DRIVER_SCHEMAS, DRIVER_TABLES
    return "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, {len(DRIVER_SCHEMAS[t].fields)} AS n_columns FROM {t}"
        for t in DRIVER_TABLES)


@register("load_tables", _load_tables_sql())
def load_tables(spark, d):
    """#1: every driver table read with its declared schema: rows and declared columns per table."""
    from parlance.sources.tables import load_tables as _load
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows",
                                                              F.lit(len(df.columns)).alias("n_columns"))
             for name, df in _load(spark, d).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("contract_violations_analyses", B.with_ctes("analyses") + """
SELECT event_id, rule FROM (
  SELECT event_id, unnest(list_filter([
    CASE WHEN frustration < 0 OR frustration > 1 THEN 'frustration: 0..1' END,
    CASE WHEN anger < 0 OR anger > 1 THEN 'anger: 0..1' END,
    CASE WHEN neutral < 0 OR neutral > 1 THEN 'neutral: 0..1' END,
    CASE WHEN risk_level IS NOT NULL AND risk_level NOT IN ('low', 'medium', 'high') THEN 'risk_level: domain' END,
    CASE WHEN intent_code IS NULL THEN 'intent_code: not null' END], lambda x: x IS NOT NULL)) AS rule
  FROM analyses)""")
def contract_violations_analyses(spark, d):
    a = B.analyses(spark, d)
    rules = [K.between("frustration", 0, 1), K.between("anger", 0, 1), K.between("neutral", 0, 1),
             K.in_domain("risk_level", ["low", "medium", "high"]), K.not_null("intent_code")]
    return K.contract_violations(a, ["event_id"], rules)
