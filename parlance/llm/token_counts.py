"""Token counts through a digest cache.

The cache is a Parquet table of (content digest, tokenizer digest, count).  A run
digests the normalised content of every document, joins the digests to the stored
counts, encodes one copy of each distinct miss and appends the new counts.  The
tokenizer digest is that of the tokenizer file, so another version never meets the
counts of this one.

Normalising collapses each run of ASCII white space to one space and trims the ends,
which the tokenizer does not distinguish; letters are left as they are, because special
strings are matched in the raw text.

Defined results: a null text is the empty text (0 bytes, 0 tokens); every input row
gives one output row; a null id stays null; an empty table gives an empty result and
leaves the cache as it is; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import ASCII_SPACE, arrow_map, slices, stored
from parlance.llm.words import word_ids

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def file_digest(path: str) -> str:
    """Version digest of a tokenizer: SHA-256 of its file (a few MB)."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def content_digest(text: Column) -> Column:
    """SHA-256 of the normalised content."""
    return F.unhex(F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE + "+", " ")), 256))


def read_cache(spark: SparkSession, cache_dir: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per digest."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)
    except (AnalysisException, Py4JJavaError) as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    # an append that was repeated after a failure may have stored a digest twice
    return (cache.filter(F.col("tokenizer") == tokenizer)
            .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))


def encode_misses(docs: DataFrame, keys: DataFrame, cache: DataFrame, path: str) -> DataFrame:
    """``digest, n_tokens`` of every digest that the cache lacks.

    Copies are reduced to their digest before any text moves, so a text is encoded once
    however many copies it has; the shuffle of the digests is partially aggregated.
    """
    misses = (keys.groupBy("digest").agg(F.min("at").alias("at"))
              .join(cache.select("digest"), "digest", "left_anti"))
    texts = docs.join(misses, ["at", "digest"], "left_semi").select("digest", "text")

    def run(batches):
        tokenizer = word_ids(path)
        for part in slices(batches):
            counts = tokenizer.counts([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())],
                                             ["digest", "n_tokens"])

    return texts.transform(arrow_map, run, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, path: str, cache_dir: str, limit: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per document; appends misses to ``cache_dir``.

    ``path`` is the tokenizers file and ``cache_dir`` a folder that driver and executors
    share.  Rows without an id are keyed as -1 for the choice of the copy to encode.
    """
    spark = docs.sparkSession
    tokenizer = file_digest(path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(-1)).alias("at"), content_digest(F.col("text")).alias("digest"))
    keys = stored(rows.select("doc_id", "at", "digest",
                              F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")),
                  "token-count-keys")
    new = encode_misses(rows.select("at", "digest", "text"), keys, read_cache(spark, cache_dir, tokenizer), path)
    (new.select("digest", F.lit(tokenizer).alias("tokenizer"), "n_tokens")
     .write.mode("append").parquet(cache_dir))
    counts = read_cache(spark, cache_dir, tokenizer)
    return (keys.join(counts, "digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
