"""Retrieval queries: vector prep (#66), stats (#32), dense top-k (#67, #68), BM25 (#70), sparse top-k (#69)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import dense as D
from parlance.operators import retrieval as R
from parlance.plans.registry import register
from parlance.session import stored
from parlance.sources import bindings as B
from parlance.sources.tables import read_table

DIM = 64   # dimension of the driver embeddings (the reference collection uses 768)


def _records(spark, d):
    v = B.vectors(spark, d).drop("text_content", "metadata")
    return v.withColumn("doc_id", F.when(F.col("id") % 9 == 0, F.lit(None).cast("string")).otherwise(F.col("doc_id")))


@register("prepare_vectors", f"""
SELECT vec_id AS id, coalesce(len(embedding), -1) = {DIM} AS dim_ok,
       coalesce(CASE WHEN vec_id % 9 = 0 THEN NULL ELSE CAST(vec_id AS VARCHAR) END,
                'doc-' || substr(sha1(CAST(vec_id AS VARCHAR)), 1, 16)) AS doc_id,
       CAST(vec_id % 50 AS VARCHAR) AS product_id, CAST(label AS VARCHAR) AS shop_id, '{{}}' AS metadata
FROM embeddings""")
def prepare_vectors(spark, d):
    return R.prepare_vectors(_records(spark, d), DIM).select("id", "dim_ok", "doc_id", "product_id", "shop_id",
                                                             "metadata")


@register("prepare_vectors_text", f"""
SELECT vec_id AS id, CASE WHEN vec_id % 13 = 0 THEN false WHEN vec_id % 17 = 0 THEN false ELSE true END AS dim_ok,
       CASE WHEN vec_id % 11 = 0 THEN '' ELSE 'item ' || CAST(vec_id AS VARCHAR) || ' of shop ' || CAST(label AS VARCHAR) END
         AS text_content,
       CASE WHEN vec_id % 4 = 0 THEN '0' ELSE CAST(label AS VARCHAR) END AS shop_id,
       CASE WHEN vec_id % 3 = 0 THEN '{{}}' ELSE '{{"label": ' || CAST(label AS VARCHAR) || '}}' END AS metadata
FROM embeddings""")
def prepare_vectors_text(spark, d):
    """#66 with every default: texts, shops and metadata missing, vectors missing or of a wrong length."""
    no = lambda c, n: F.when(F.col("id") % n != 0, F.col(c))
    v = B.vectors(spark, d)
    cut = F.when(F.col("id") % 13 == 0, F.slice("dense_vector", 1, 7)).otherwise(no("dense_vector", 17))
    v = v.select("id", "doc_id", "product_id", cut.alias("dense_vector"), no("text_content", 11).alias("text_content"),
                 no("shop_id", 4).alias("shop_id"), no("metadata", 3).alias("metadata"))
    return R.prepare_vectors(v, DIM).select("id", "dim_ok", "text_content", "shop_id", "metadata")


@register("collection_stats", """
SELECT CAST(label AS VARCHAR) AS shop_id, count(*) AS n FROM embeddings GROUP BY label""")
def collection_stats(spark, d):
    return R.collection_stats(B.vectors(spark, d))


def centroid_queries(spark, d):
    """One query per shop: the mean embedding of the shop's vectors (derived from the whole table)."""
    e = read_table(spark, d, "embeddings", "embedding", "label")
    per_dim = (e.select("label", F.posexplode("embedding").alias("pos", "x"))
               .groupBy("label", "pos").agg(F.avg("x").alias("m")))
    return (per_dim.groupBy("label")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_c"))
            .select(F.col("label").cast("bigint").alias("query_id"), F.col("label").cast("string").alias("shop_id"),
                    F.transform("_c", lambda s: s["m"]).alias("query_vector")))


_CENTROID_SQL = """
cent0 AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
cent1 AS (SELECT label, pos, avg(x) AS m FROM cent0 GROUP BY label, pos),
queries AS (SELECT CAST(label AS BIGINT) AS query_id, CAST(label AS VARCHAR) AS shop_id,
                   list(m ORDER BY pos) AS query_vector FROM cent1 GROUP BY label)"""


@register("dense_top_k", B.with_ctes("vectors") + "," + _CENTROID_SQL + f""",
pairs AS (
  SELECT q.query_id, v.id, v.doc_id, v.product_id,
         round(list_reduce(list_transform(list_zip(q.query_vector, CAST(v.dense_vector AS DOUBLE[])),
                                    lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b), 9) AS distance
  FROM queries q JOIN vectors v ON q.shop_id = v.shop_id)
SELECT query_id, id, doc_id, product_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs)
WHERE rank <= {R.DEFAULT_K}""")
def dense_top_k(spark, d):
    out = D.dense_top_k(centroid_queries(spark, d), B.vectors(spark, d), R.DEFAULT_K, ("doc_id", "product_id"), in_shop=True)
    return out.select("query_id", "id", "doc_id", "product_id", F.round("distance", 6).alias("distance"), "rank")


def vector_queries(spark, d):
    """Every vector whose id is divisible by 50, as a query over the whole table."""
    return B.vectors(spark, d).filter("id % 50 = 0").select(F.col("id").alias("query_id"),
                                                            F.col("dense_vector").alias("query_vector"))


@register("dense_top_k_all", B.with_ctes("vectors") + f""",
pairs AS (
  SELECT q.id AS query_id, v.id, v.text_content, v.shop_id, v.metadata,
         round(list_reduce(list_transform(list_zip(CAST(q.dense_vector AS DOUBLE[]), CAST(v.dense_vector AS DOUBLE[])),
                                    lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b), 9) AS distance
  FROM vectors q, vectors v WHERE q.id % 50 = 0)
SELECT query_id, id, text_content, shop_id, metadata, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs)
WHERE rank <= {R.DEFAULT_K}""")
def dense_top_k_all(spark, d):
    """#67 without a shop, with the vector store's default output fields."""
    out = D.dense_top_k(vector_queries(spark, d), B.vectors(spark, d), R.DEFAULT_K)
    return out.select("query_id", "id", "text_content", "shop_id", "metadata", F.round("distance", 6).alias("distance"), "rank")


#: Share of the cells whose codes a query of the registered index search reads, and the vectors, found by
#: their codes, that it compares as a whole.
IVF_SHARE, IVF_RERANK = 0.6, 60


@register("dense_top_k_ivf")
def dense_top_k_ivf(spark, d):
    """#68: an index with as many cells as the root of the table's rows; a new one for each run."""
    vecs = B.vectors(spark, d)
    model = D.fit(vecs)
    out = D.search(D.build(vecs, model), vector_queries(spark, d), vecs, R.DEFAULT_K,
                   max(1, round(IVF_SHARE * len(model.centers))), IVF_RERANK, ("doc_id", "product_id"))
    return out.select("query_id", "id", "doc_id", "product_id", F.round("distance", 6).alias("distance"), "rank")


_TOKENS_SQL = r"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) > 0)"


def _bm25_sql():
    tok = _TOKENS_SQL.format(x="text")
    return f"""
toks AS (SELECT doc_id, {tok} AS t FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM (
         SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY doc_id, term),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm25 AS (SELECT tf.doc_id, tf.term,
                ln(1 + (stats.n - dfs.df + 0.5) / (dfs.df + 0.5)) * tf.tf * ({R.BM25_K1} + 1)
                / (tf.tf + {R.BM25_K1} * (1 - {R.BM25_B} + {R.BM25_B} * tf.dl / stats.avgdl)) AS weight
         FROM tf JOIN dfs ON tf.term = dfs.term CROSS JOIN stats)"""


def _postings(spark, d):
    return R.bm25_weights(read_table(spark, d, "documents", "doc_id", "text"))


@register("bm25_weights", "WITH " + _bm25_sql() + "\nSELECT doc_id, term, round(weight, 9) AS weight FROM bm25")
def bm25_weights(spark, d):
    return _postings(spark, d).select("doc_id", "term", F.round("weight", 9).alias("weight"))


def benchmark_query_terms(spark, d):
    tf = R.term_frequencies(read_table(spark, d, "benchmark", "item_id", "text"), "item_id", "text")
    return tf.select(F.col("doc_id").alias("query_id"), "term", F.col("tf").cast("double").alias("qweight"))


_QUERY_TERMS_SQL = f"""
qt AS (SELECT item_id AS query_id, term, CAST(count(*) AS DOUBLE) AS qweight FROM (
         SELECT item_id, unnest({_TOKENS_SQL.format(x='text')}) AS term FROM benchmark) GROUP BY item_id, term)"""


@register("sparse_top_k", "WITH " + _bm25_sql() + "," + _QUERY_TERMS_SQL + f""",
sc AS (SELECT qt.query_id, b.doc_id, round(sum(qt.qweight * b.weight), 9) AS score
       FROM qt JOIN bm25 b ON qt.term = b.term GROUP BY qt.query_id, b.doc_id)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)
WHERE rank <= {R.DEFAULT_K}""")
def sparse_top_k(spark, d):
    wanted = stored(benchmark_query_terms(spark, d), "query-terms")
    postings = R.bm25_weights(read_table(spark, d, "documents", "doc_id", "text"), only_terms=wanted)
    out = R.sparse_top_k(wanted, postings)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


#: The shops of the corpus are the documents' sources; each query searches the shop of its number.
SHOPS = 20


@register("sparse_top_k_shop", "WITH " + _bm25_sql() + "," + _QUERY_TERMS_SQL + f""",
sc AS (SELECT qt.query_id, d.source AS shop_id, b.doc_id, round(sum(qt.qweight * b.weight), 9) AS score
       FROM qt JOIN bm25 b ON qt.term = b.term JOIN documents d ON d.doc_id = b.doc_id
       WHERE d.source = 'src' || CAST(qt.query_id % {SHOPS} AS VARCHAR) GROUP BY qt.query_id, d.source, b.doc_id)
SELECT query_id, 'src' || CAST(query_id % {SHOPS} AS VARCHAR) AS shop_id, doc_id, round(score, 6) AS score,
       CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)
WHERE rank <= {R.DEFAULT_K}""")
def sparse_top_k_shop(spark, d):
    """#69 with the shop filter: weights are those of the whole corpus, documents those of the query's shop."""
    shop = F.concat(F.lit("src"), (F.col("query_id") % SHOPS).cast("string"))
    wanted = stored(benchmark_query_terms(spark, d).withColumn("shop_id", shop), "query-terms")
    docs = read_table(spark, d, "documents", "doc_id", "text", "source")
    postings = R.bm25_weights(docs, only_terms=wanted).join(docs.select("doc_id", F.col("source").alias("shop_id")), "doc_id")
    out = R.sparse_top_k(wanted, postings, within=("shop_id",))
    return out.select("query_id", shop.alias("shop_id"), "doc_id", F.round("score", 6).alias("score"), "rank")
