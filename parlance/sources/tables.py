"""Readers for the driver tables and the relational contracts of the domain (#1).

Every reader names its columns so the parquet scan only reads what a plan uses
(``ReadSchema`` in ``explain``); filters applied afterwards are pushed into the
scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Declared schemas of the driver tables (read with the schema, no inference).
DRIVER_SCHEMAS: dict[str, T.StructType] = {
    "region": T.StructType([T.StructField("r_regionkey", T.IntegerType()),
                            T.StructField("r_name", T.StringType())]),
    "nation": T.StructType([T.StructField("n_nationkey", T.IntegerType()),
                            T.StructField("n_name", T.StringType()),
                            T.StructField("n_regionkey", T.IntegerType())]),
    "customer": T.StructType([T.StructField("c_custkey", T.LongType()),
                              T.StructField("c_name", T.StringType()),
                              T.StructField("c_nationkey", T.IntegerType()),
                              T.StructField("c_acctbal", T.DoubleType()),
                              T.StructField("c_mktsegment", T.StringType())]),
    "supplier": T.StructType([T.StructField("s_suppkey", T.LongType()),
                              T.StructField("s_name", T.StringType()),
                              T.StructField("s_nationkey", T.IntegerType()),
                              T.StructField("s_acctbal", T.DoubleType())]),
    "part": T.StructType([T.StructField("p_partkey", T.LongType()),
                          T.StructField("p_name", T.StringType()),
                          T.StructField("p_brand", T.StringType()),
                          T.StructField("p_type", T.StringType()),
                          T.StructField("p_size", T.IntegerType()),
                          T.StructField("p_retailprice", T.DoubleType())]),
    "orders": T.StructType([T.StructField("o_orderkey", T.LongType()),
                            T.StructField("o_custkey", T.LongType()),
                            T.StructField("o_orderstatus", T.StringType()),
                            T.StructField("o_totalprice", T.DoubleType()),
                            T.StructField("o_orderdate", T.TimestampNTZType()),
                            T.StructField("o_orderpriority", T.StringType())]),
    "lineitem": T.StructType([T.StructField("l_orderkey", T.LongType()),
                              T.StructField("l_partkey", T.LongType()),
                              T.StructField("l_suppkey", T.LongType()),
                              T.StructField("l_linenumber", T.IntegerType()),
                              T.StructField("l_quantity", T.DoubleType()),
                              T.StructField("l_extendedprice", T.DoubleType()),
                              T.StructField("l_discount", T.DoubleType()),
                              T.StructField("l_tax", T.DoubleType()),
                              T.StructField("l_returnflag", T.StringType()),
                              T.StructField("l_linestatus", T.StringType()),
                              T.StructField("l_shipdate", T.TimestampNTZType())]),
    "events": T.StructType([T.StructField("event_id", T.LongType()),
                            T.StructField("ts", T.TimestampNTZType()),
                            T.StructField("user_id", T.LongType()),
                            T.StructField("event_type", T.StringType()),
                            T.StructField("value", T.DoubleType()),
                            T.StructField("props", T.StringType())]),
    "documents": T.StructType([T.StructField("doc_id", T.LongType()),
                               T.StructField("text", T.StringType()),
                               T.StructField("lang", T.StringType()),
                               T.StructField("source", T.StringType()),
                               T.StructField("n_chars", T.LongType())]),
    "embeddings": T.StructType([T.StructField("vec_id", T.LongType()),
                                T.StructField("embedding", T.ArrayType(T.FloatType())),
                                T.StructField("label", T.IntegerType())]),
    "pages": T.StructType([T.StructField("page_id", T.LongType()),
                           T.StructField("url", T.StringType()),
                           T.StructField("html", T.StringType())]),
    "benchmark": T.StructType([T.StructField("item_id", T.LongType()),
                               T.StructField("text", T.StringType())]),
    "labels": T.StructType([T.StructField("doc_id", T.LongType()),
                            T.StructField("quality", T.IntegerType()),
                            T.StructField("toxic", T.IntegerType())]),
    "conversations": T.StructType([T.StructField("conv_id", T.LongType()),
                                   T.StructField("turn", T.LongType()),
                                   T.StructField("role", T.StringType()),
                                   T.StructField("text", T.StringType())]),
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one driver table with its declared schema, optionally pruned to ``columns``."""
    df = spark.read.schema(DRIVER_SCHEMAS[name]).parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def load_tables(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> dict[str, DataFrame]:
    """#1 ``load_tables``: every table read with its declared schema."""
    return {n: read_table(spark, sf_dir, n) for n in names}


# Relational contracts of the domain tables (§1.1).  Column -> (type, nullable, max_length).
DOMAIN_SCHEMAS: dict[str, T.StructType] = {
    "shops": T.StructType([
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("bot_config", T.StringType(), True),
        T.StructField("owner_id", T.StringType(), True)]),
    "products": T.StructType([
        T.StructField("id", T.StringType(), False),
        T.StructField("shop_id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("sku", T.StringType(), True),
        T.StructField("price", T.DecimalType(10, 2), False),
        T.StructField("stock_quantity", T.IntegerType(), False),
        T.StructField("specs", T.StringType(), True),
        T.StructField("description", T.StringType(), True),
        T.StructField("image_url", T.StringType(), True)]),
    "customers": T.StructType([
        T.StructField("id", T.StringType(), False),
        T.StructField("shop_id", T.StringType(), False),
        T.StructField("full_name", T.StringType(), False),
        T.StructField("phone", T.StringType(), True),
        T.StructField("email", T.StringType(), True),
        T.StructField("membership_tier", T.StringType(), True),
        T.StructField("preferences", T.StringType(), True),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False)]),
    "documents": T.StructType([
        T.StructField("id", T.StringType(), False),
        T.StructField("product_id", T.StringType(), False),
        T.StructField("file_name", T.StringType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("status", T.StringType(), True)]),
    "sales_pipelines": T.StructType([
        T.StructField("id", T.LongType(), False),
        T.StructField("shop_id", T.StringType(), False),
        T.StructField("stage_name", T.StringType(), False),
        T.StructField("step_order", T.IntegerType(), False),
        T.StructField("description", T.StringType(), True)]),
    "sessions": T.StructType([
        T.StructField("id", T.StringType(), False),
        T.StructField("user_id", T.StringType(), False),
        T.StructField("title", T.StringType(), True),
        T.StructField("handoff_reason", T.StringType(), True),
        T.StructField("current_stage_id", T.LongType(), True),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
        T.StructField("metadata", T.StringType(), True)]),
    "messages": T.StructType([
        T.StructField("id", T.StringType(), False),
        T.StructField("session_id", T.StringType(), False),
        T.StructField("role", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("tool_calls", T.StringType(), True),
        T.StructField("token_count", T.IntegerType(), True),
        T.StructField("created_at", T.TimestampType(), False)]),
}
