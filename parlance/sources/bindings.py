"""Domain tables derived from the driver tables.

Each binding exists twice: as a Spark plan (``spark_*``) and as a DuckDB CTE
(``SQL[name]``) used by the SQL oracle.  Both are built from the same expressions,
so a query and its oracle read the same rows.  All work grows with the driver
tables; the only fixed rows are the six stage names of a sales pipeline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.sources.tables import read_table

# The default sales pipeline, in step order.
STAGE_NAMES = ["greeting", "need_discovery", "solution_matching",
               "price_discussion", "objection_handling", "closing"]

AS_OF_DATE = "2001-08-02"          # customers / purchases are profiled as of this day
EVENTS_AS_OF_EPOCH = 1706659200  # 2024-01-31 00:00:00 UTC, "now" for buffers built from events


def epoch_seconds(col) -> F.Column:
    """Integer epoch seconds of a timestamp_ntz column (time-zone independent)."""
    return F.unix_timestamp(col)


# ---------------------------------------------------------------- messages
def messages_short(spark: SparkSession, d: str) -> DataFrame:
    """conversations -> messages: session = conv_id, id = turn, ts = conv_id*86400 + turn*60."""
    cv = read_table(spark, d, "conversations")
    return cv.select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("msg_id"),
        (F.col("conv_id") * 86400 + F.col("turn") * 60).alias("ts"),
        F.col("role"),
        F.col("text").alias("content"),
        F.length("text").cast("bigint").alias("tokens"),
    )


def messages_long(spark: SparkSession, d: str) -> DataFrame:
    """events -> messages: session = user_id, id = event_id, role assistant for views."""
    ev = read_table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    return ev.select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("msg_id"),
        epoch_seconds(F.col("ts")).alias("ts"),
        F.when(F.col("event_type") == "view", F.lit("assistant")).otherwise(F.lit("user")).alias("role"),
        F.col("event_type").alias("content"),
        F.floor("value").cast("bigint").alias("tokens"),
    )


def context_updates(spark: SparkSession, d: str) -> DataFrame:
    """events -> context writes: field by event type, value = props, increment = floor(value) - 10."""
    return context_updates_from(read_table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value",
                                           "props"))


def context_updates_from(ev: DataFrame) -> DataFrame:
    """The context-update binding over any events frame (batch or stream)."""
    field = (F.when(F.col("event_type") == "click", "current_goal")
              .when(F.col("event_type") == "purchase", "extracted_entities")
              .when(F.col("event_type") == "view", "last_tool_used")
              .otherwise("user_mood"))
    return ev.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("msg_id"),
        epoch_seconds(F.col("ts")).alias("ts"), field.alias("field"), F.col("props").alias("value"),
        (F.floor("value") - 10).cast("bigint").alias("increment"))


def context_writes_from(ev: DataFrame) -> DataFrame:
    """Context updates as a client writes them: increments are text, of which some are no integer or
    missing, and some entities are no JSON object."""
    up, bad = context_updates_from(ev), F.col("msg_id")
    number = (F.when(bad % 13 == 0, F.lit("n/a")).when(bad % 17 == 0, F.lit(None).cast("string"))
              .when(bad % 19 == 0, F.concat(F.lit(" +"), F.abs("increment").cast("string"), F.lit(" ")))
              .otherwise(F.col("increment").cast("string")))
    value = (F.when((F.col("field") == "extracted_entities") & (bad % 5 == 0), F.lit("{broken"))
             .when((F.col("field") == "extracted_entities") & (bad % 7 == 0), F.lit("[1, 2]")).otherwise(F.col("value")))
    return up.withColumn("value", value).withColumn("increment", number)


def analyses(spark: SparkSession, d: str) -> DataFrame:
    """events -> per-turn analyses: emotion scores from value and type, flags from props.k, risk by value."""
    return analyses_from(read_table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value", "props"))


def analyses_from(ev: DataFrame, keep=()) -> DataFrame:
    """The analyses binding over any events frame (batch or stream); ``keep`` columns pass through."""
    ev = ev.withColumn("_k", F.get_json_object("props", "$.k").cast("int"))
    k, v, t = F.col("_k"), F.col("value"), F.col("event_type")
    emo = {
        "frustration": F.when(t == "error", F.least(F.lit(1.0), v / 50)).otherwise(F.least(F.lit(1.0), v / 400)),
        "anger": F.when(t == "error", F.least(F.lit(1.0), v / 80)).otherwise(F.lit(0.0)),
        "sadness": F.least(F.lit(1.0), k / 200),
        "joy": F.when(t == "purchase", F.least(F.lit(1.0), v / 100)).otherwise(F.lit(0.0)),
        "fear": F.when(t == "signup", F.least(F.lit(1.0), k / 150)).otherwise(F.lit(0.0)),
    }
    base = ev.select("event_id", *keep, F.col("user_id").alias("session_id"), epoch_seconds(F.col("ts")).alias("ts"),
                     t.alias("event_type"), *[c.cast("double").alias(n) for n, c in emo.items()],
                     (k % 17 == 0).alias("legal"), (k % 19 == 0).alias("medical"),
                     (k % 23 == 0).alias("financial_risk"), ((t == "error") & (k % 5 == 0)).alias("high_technical"),
                     F.when(v > 400, "high").when(v > 200, "medium").otherwise("low").alias("risk_level"),
                     ((t == "signup") & (k % 13 == 0)).alias("human_request"),
                     F.when(t == "purchase", "purchase_consultation").when(t == "view", "product_inquiry")
                      .when(t == "click", "information_request").when(t == "error", "complaint")
                      .otherwise("booking").alias("intent_code"))
    return base.withColumn("neutral", 1.0 - F.greatest(*[F.col(n) for n in emo]))


# ---------------------------------------------------------------- catalog
def products(spark: SparkSession, d: str) -> DataFrame:
    """part -> products of shop = brand; sku null / '' / 'brand-key' by key."""
    p = read_table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("shop_id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_partkey") % 7 == 0, F.lit(None).cast("string"))
         .when(F.col("p_partkey") % 11 == 0, F.lit(""))
         .otherwise(F.concat(F.col("p_brand"), F.lit("-"), F.col("p_partkey").cast("string"))).alias("sku"),
        (F.col("p_size") % 10).cast("int").alias("stock_quantity"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
    )


def shops(spark: SparkSession, d: str) -> DataFrame:
    """distinct brands are the shops."""
    return (read_table(spark, d, "part", "p_brand").distinct()
            .select(F.col("p_brand").alias("id"), F.col("p_brand").alias("name")))


def stages(spark: SparkSession, d: str) -> DataFrame:
    """Every shop gets the default six-stage pipeline; id = shop-local step."""
    names = F.array(*[F.lit(n) for n in STAGE_NAMES])
    return (shops(spark, d)
            .select(F.col("id").alias("shop_id"), F.posexplode(names).alias("pos", "stage_name"))
            .select("shop_id", (F.col("pos") + 1).cast("int").alias("step_order"), "stage_name"))


def product_questions(spark: SparkSession, d: str) -> DataFrame:
    """lineitem x part -> one question per line item, asked in the part's shop."""
    li = read_table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = read_table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type")
    j = li.join(p, li.l_partkey == p.p_partkey, "inner")
    return j.select(
        # (order, line, part, supplier) is the unique key of a line item in the driver data.
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("q_id"),
        F.col("p_brand").alias("shop_id"),
        F.col("p_partkey").alias("part_id"),
        F.when(F.col("l_linenumber") % 2 == 0,
               F.concat(F.lit("giá "), F.col("p_name"), F.lit(" bao nhiêu")))
         .otherwise(F.concat(F.lit("tư vấn "), F.col("p_type"))).alias("text"),
    )


# ---------------------------------------------------------------- customers
def customers(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey")


def purchases(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


# ---------------------------------------------------------------- sessions
def sessions(spark: SparkSession, d: str) -> DataFrame:
    """one session per events user; current stage step = user_id % 7 (0 -> none)."""
    ev = read_table(spark, d, "events", "user_id", "ts")
    s = ev.groupBy("user_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
    return s.select(
        F.col("user_id").alias("id"),
        F.col("user_id"),
        F.when(F.col("user_id") % 7 == 0, F.lit(None).cast("int"))
         .otherwise((F.col("user_id") % 7).cast("int")).alias("current_step"),
        epoch_seconds(F.col("created_at")).alias("created_at"),
        epoch_seconds(F.col("updated_at")).alias("updated_at"),
    )


# ---------------------------------------------------------------- vectors
def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("dense_vector"),
        F.col("label").cast("string").alias("shop_id"),
        F.col("vec_id").cast("string").alias("doc_id"),
        (F.col("vec_id") % 50).cast("string").alias("product_id"),
        F.concat(F.lit("item "), F.col("vec_id").cast("string"), F.lit(" of shop "), F.col("label").cast("string")).alias("text_content"),
        F.concat(F.lit('{"label": '), F.col("label").cast("string"), F.lit("}")).alias("metadata"),
    )


# ================================================================ SQL CTEs
SQL: dict[str, str] = {
    "messages_short": """messages_short AS (
  SELECT conv_id AS session_id, turn AS msg_id, conv_id * 86400 + turn * 60 AS ts, role,
         text AS content, CAST(length(text) AS BIGINT) AS tokens
  FROM conversations)""",
    "messages_long": """messages_long AS (
  SELECT user_id AS session_id, event_id AS msg_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
         CASE WHEN event_type = 'view' THEN 'assistant' ELSE 'user' END AS role,
         event_type AS content, CAST(floor(value) AS BIGINT) AS tokens
  FROM events)""",
    "context_updates": """context_updates AS (
  SELECT user_id AS session_id, event_id AS msg_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
         CASE event_type WHEN 'click' THEN 'current_goal' WHEN 'purchase' THEN 'extracted_entities'
              WHEN 'view' THEN 'last_tool_used' ELSE 'user_mood' END AS field,
         props AS value, CAST(floor(value) - 10 AS BIGINT) AS increment
  FROM events)""",
    "context_writes": """context_writes AS (
  SELECT session_id, msg_id, ts, field,
         CASE WHEN field = 'extracted_entities' AND msg_id % 5 = 0 THEN '{broken'
              WHEN field = 'extracted_entities' AND msg_id % 7 = 0 THEN '[1, 2]' ELSE value END AS value,
         CASE WHEN msg_id % 13 = 0 THEN 'n/a' WHEN msg_id % 17 = 0 THEN NULL
              WHEN msg_id % 19 = 0 THEN ' +' || CAST(abs(increment) AS VARCHAR) || ' '
              ELSE CAST(increment AS VARCHAR) END AS increment
  FROM context_updates)""",
    "analyses": """analyses AS (
  SELECT *, 1.0 - greatest(frustration, anger, sadness, joy, fear) AS neutral FROM (
  SELECT event_id, user_id AS session_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type,
         CAST(CASE WHEN event_type = 'error' THEN least(1.0, value / 50) ELSE least(1.0, value / 400) END AS DOUBLE) AS frustration,
         CAST(CASE WHEN event_type = 'error' THEN least(1.0, value / 80) ELSE 0.0 END AS DOUBLE) AS anger,
         CAST(least(1.0, CAST(json_extract(props, '$.k') AS INTEGER) / 200) AS DOUBLE) AS sadness,
         CAST(CASE WHEN event_type = 'purchase' THEN least(1.0, value / 100) ELSE 0.0 END AS DOUBLE) AS joy,
         CAST(CASE WHEN event_type = 'signup' THEN least(1.0, CAST(json_extract(props, '$.k') AS INTEGER) / 150) ELSE 0.0 END AS DOUBLE) AS fear,
         CAST(json_extract(props, '$.k') AS INTEGER) % 17 = 0 AS legal,
         CAST(json_extract(props, '$.k') AS INTEGER) % 19 = 0 AS medical,
         CAST(json_extract(props, '$.k') AS INTEGER) % 23 = 0 AS financial_risk,
         event_type = 'error' AND CAST(json_extract(props, '$.k') AS INTEGER) % 5 = 0 AS high_technical,
         CASE WHEN value > 400 THEN 'high' WHEN value > 200 THEN 'medium' ELSE 'low' END AS risk_level,
         event_type = 'signup' AND CAST(json_extract(props, '$.k') AS INTEGER) % 13 = 0 AS human_request,
         CASE event_type WHEN 'purchase' THEN 'purchase_consultation' WHEN 'view' THEN 'product_inquiry'
              WHEN 'click' THEN 'information_request' WHEN 'error' THEN 'complaint' ELSE 'booking' END AS intent_code
  FROM events))""",
    "products": """products AS (
  SELECT p_partkey AS id, p_brand AS shop_id, p_name AS name,
         CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN ''
              ELSE p_brand || '-' || CAST(p_partkey AS VARCHAR) END AS sku,
         CAST(p_size % 10 AS INTEGER) AS stock_quantity,
         CAST(p_retailprice AS DECIMAL(10,2)) AS price
  FROM part)""",
    "shops": """shops AS (SELECT DISTINCT p_brand AS id, p_brand AS name FROM part)""",
    "stages": """stages AS (
  SELECT s.id AS shop_id, CAST(n.step_order AS INTEGER) AS step_order, n.stage_name
  FROM shops s CROSS JOIN (VALUES (1, 'greeting'), (2, 'need_discovery'), (3, 'solution_matching'),
       (4, 'price_discussion'), (5, 'objection_handling'), (6, 'closing')) n(step_order, stage_name))""",
    "product_questions": """product_questions AS (
  SELECT concat_ws('-', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey) AS q_id, p.p_brand AS shop_id, p.p_partkey AS part_id,
         CASE WHEN l.l_linenumber % 2 = 0 THEN 'giá ' || p.p_name || ' bao nhiêu'
              ELSE 'tư vấn ' || p.p_type END AS text
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)""",
    "sessions": """sessions AS (
  SELECT user_id AS id, user_id,
         CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(user_id % 7 AS INTEGER) END AS current_step,
         CAST(floor(epoch(min(ts))) AS BIGINT) AS created_at,
         CAST(floor(epoch(max(ts))) AS BIGINT) AS updated_at
  FROM events GROUP BY user_id)""",
    "vectors": """vectors AS (
  SELECT vec_id AS id, embedding AS dense_vector, CAST(label AS VARCHAR) AS shop_id,
         CAST(vec_id AS VARCHAR) AS doc_id, CAST(vec_id % 50 AS VARCHAR) AS product_id,
         'item ' || CAST(vec_id AS VARCHAR) || ' of shop ' || CAST(label AS VARCHAR) AS text_content,
         '{"label": ' || CAST(label AS VARCHAR) || '}' AS metadata
  FROM embeddings)""",
}

# CTEs that need another CTE first.
SQL_DEPENDS = {"stages": ["shops"], "context_writes": ["context_updates"]}


def with_ctes(*names: str) -> str:
    """``WITH`` clause holding the named binding CTEs (and what they depend on)."""
    ordered: list[str] = []

    def add(n):
        for dep in SQL_DEPENDS.get(n, []):
            add(dep)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(SQL[n] for n in ordered) + "\n"
