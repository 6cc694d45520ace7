"""Vector records, BM25 weights and collection counts (#32, #66, #70).

The searches are in ``dense.py`` (#67, #68) and ``sparse.py`` (#69); the latter takes BM25 posting rows
``(doc_id, term, weight)``, and a query as posting rows of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.sparse import sparse_top_k  # noqa: F401 - the search over these postings
from parlance.session import stored

# Default search parameters of the vector store.
DEFAULT_K = 10
NPROBE = 10
# BM25 parameters from the literature (Robertson et al.): k1 = 1.2, b = 0.75.
BM25_K1 = 1.2
BM25_B = 0.75

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def prepare_vectors(records: DataFrame, dim: int) -> DataFrame:
    """#66: defaults and dimension check for vector records.

    doc_id defaults to a generated id (a hash of the record id), product_id to
    '0', text_content to '', metadata to '{}', a missing sparse vector to an empty one; ``dim_ok``
    flags records whose dense vector has the wrong length.
    """
    cols = records.columns
    sparse = F.col("sparse_vector") if "sparse_vector" in cols else F.lit(None).cast("map<string,double>")
    meta = F.col("metadata") if "metadata" in cols else F.lit(None).cast("string")
    return records.select(
        "id", "dense_vector",
        (F.coalesce(F.size("dense_vector"), F.lit(-1)) == dim).alias("dim_ok"),
        F.coalesce(F.col("doc_id"), F.concat(F.lit("doc-"), F.sha1(F.col("id").cast("string")).substr(1, 16)))
        .alias("doc_id"),
        F.coalesce(F.col("product_id"), F.lit("0")).alias("product_id"),
        F.coalesce(F.col("shop_id"), F.lit("0")).alias("shop_id"),
        F.coalesce(F.col("text_content") if "text_content" in cols else F.lit(None).cast("string"),
                   F.lit("")).alias("text_content"),
        F.coalesce(meta, F.lit("{}")).alias("metadata"),
        F.coalesce(sparse, F.create_map().cast("map<string,double>")).alias("sparse_vector"))


def tokens(text: Column) -> Column:
    """Lower-cased word tokens of a whole text (letters and digits, any script)."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT), "")


def term_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, dl, term, tf)``: per-document term counts and the document length in tokens.

    Counting is an aggregate, summed in the tasks that read the texts before anything is shuffled."""
    cut = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("_toks"))
    words = cut.select("doc_id", F.size("_toks").alias("dl"), F.explode("_toks").alias("term"))
    return words.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


#: The mark of a document's own row among its terms, which hold letters and digits only.  It is spread
#: over this many keys, so that no join or count has a key that every document shares.
_MARK, _MARKS = "\u0000", 4096


def _counted(docs: DataFrame, id_col: str, text_col: str, only_terms: DataFrame | None) -> DataFrame:
    """Term counts as above, stored, with one marked row per document that carries its length."""
    mark = F.concat(F.lit(_MARK), F.pmod(F.xxhash64(F.col(id_col)), F.lit(_MARKS)).cast("string"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), mark.alias("_mark"))
    if only_terms is None:
        # every word is kept: whole texts are dealt by document, as they are less than their words with the
        # document's number in each row; the counts then need no further shuffle
        texts = texts.repartition("doc_id")
    cut = texts.select("doc_id", tokens(F.col("_text")).alias("_toks"), "_mark")
    words = cut.select("doc_id", F.size("_toks").alias("dl"), F.explode(F.array_append("_toks", F.col("_mark"))).alias("term"))
    if only_terms is not None:
        wanted = only_terms.select("term").distinct().withColumn("_wanted", F.lit(True))
        words = words.join(wanted, "term", "left").where(F.col("_wanted") | F.startswith("term", F.lit(_MARK)))
    return stored(words.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")), "term-counts")


#: Terms whose document frequencies go to every task; all others meet their rows in a shuffle.
SENT_TERMS = 500_000


def with_frequencies(tf: DataFrame, df: DataFrame, sent: int = SENT_TERMS) -> DataFrame:
    """``tf`` with each term's ``df`` (``term, df``; both stored, ``df`` the number of the term's rows in ``tf``).

    Few terms make up most rows.  The terms with more than a ``sent``-th of all rows are at most ``sent``, however
    large the table: their frequencies are broadcast, and only the rows of rarer terms are shuffled."""
    counts = df.agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("rows")).first()
    if counts["terms"] <= sent:
        return tf.join(F.broadcast(df), "term")
    often = F.broadcast(df.where(F.col("df") > counts["rows"] // sent))
    met = tf.join(often, "term", "left")
    rare = tf.join(often.select("term"), "term", "left_anti").join(df.where(F.col("df") <= counts["rows"] // sent), "term")
    return met.where(F.col("df").isNotNull()).unionByName(rare.select(*met.columns))


def bm25_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 k1: float = BM25_K1, b: float = BM25_B, only_terms: DataFrame | None = None) -> DataFrame:
    """#70: BM25 posting rows ``(doc_id, term, weight)``.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); weight = idf * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)).
    Texts are cut into terms once; N, avgdl, df and the postings read the stored counts.
    ``only_terms`` (a frame with ``term``) keeps the postings that a search needs before
    anything is shuffled; N, avgdl and df are those of the whole corpus.
    """
    counted = _counted(docs, id_col, text_col, only_terms)
    marked = F.startswith("term", F.lit(_MARK))
    stats = counted.where(marked).agg(F.sum("tf").alias("n"), F.sum(F.col("dl") * F.col("tf")).alias("total")).first()
    n, total = stats["n"] or 0, stats["total"] or 0
    avgdl = float(total) / n if total else 1.0
    tf = counted.where(~marked)
    df = stored(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "document-frequencies")
    j = with_frequencies(tf, df)
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl))
    return j.select("doc_id", "term", (idf * F.col("tf") * (k1 + 1) / norm).alias("weight"))


def collection_stats(vectors: DataFrame) -> DataFrame:
    """#32: row count per shop of a vector collection."""
    return vectors.groupBy("shop_id").agg(F.count(F.lit(1)).alias("n"))
