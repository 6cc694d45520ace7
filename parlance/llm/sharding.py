"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order; row i of a source with n rows gets
the fractional rank (i + 1/2) / n.  Sorted by fractional rank, the sources interleave in
proportion at every point, and cutting that order into equal runs gives shards that all
hold the mixture, with row counts at most one apart.

Both orders are exact positions without a global sort: rows are bucketed by the sort key
(hash range within the source, then fractional-rank range), counted per bucket, and
numbered inside the bucket.  No task orders a whole source.  Texts are read once, for
size and CRC, and never shuffled.

Defined results: a null text has size 1 and the CRC of the empty text; a null source is a
source of its own; rows that tie in everything are interchangeable; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import stored

#: Rows per bucket on average; bits of the bucket number at least and at most.  The result
#: doesn't depend on them.
BUCKET_ROWS, LEAST_BITS, MOST_BITS = 50_000, 8, 14


def _numbered(rows: DataFrame, group: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """Position (from 0) of each row within ``group`` when ``bucket`` ascends with ``order``."""
    sums = rows.groupBy(*group, bucket).agg(F.count("*").alias("_n"))
    before = sums.select(*group, bucket, (F.sum("_n").over(
        Window.partitionBy(*group).orderBy(bucket)) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order))
    return (rows.withColumn("_local", local).join(before, [*group, bucket])
            .withColumn(out, F.col("_before") + F.col("_local") - 1).drop("_local", "_before"))


def shard(docs: DataFrame, shards: int = 16, seed: int = 17, id_col: str = "doc_id",
          text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` and the source of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = stored(docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("")).alias("stratum"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32")), "shard-rows")
    sizes = slim.groupBy("stratum").agg(F.count("*").alias("of"))
    total = sizes.agg(F.coalesce(F.sum("of"), F.lit(0)).alias("n")).first()["n"]
    bits = min(MOST_BITS, max(LEAST_BITS, (total // BUCKET_ROWS).bit_length()))
    buckets = 1 << bits

    # the top bits of the hash ascend with the hash
    by_key = slim.withColumn("range", F.shiftright("key", 64 - bits))
    tie = [F.col("key"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = _numbered(by_key, ["stratum"], "range", tie, "rank").join(sizes, "stratum")
    fraction = ranked.withColumn("fraction", (F.col("rank") + F.lit(0.5)) / F.col("of"))

    placed = _numbered(
        fraction.withColumn("whole", F.lit(0)).withColumn("part", F.floor(F.col("fraction") * buckets).cast("int")),
        ["whole"], "part", [F.col("fraction"), F.col("stratum"), *tie], "position")
    # run s of the order holds the positions in [floor(s*n/k), floor((s+1)*n/k))
    n, k = F.lit(max(total, 1)), F.lit(shards)
    number = F.floor(((F.col("position") + 1) * k - 1) / n)
    return placed.withColumn("shard", number.cast("int")).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("position") - F.floor(F.col("shard").cast("long") * n / k)).cast("long").alias("slot"),
        F.when(F.col("stratum") != "", F.expr("substring(stratum, 2)")).alias("source"))
