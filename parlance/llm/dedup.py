"""Exact deduplication over an extendible-hash index, on DataFrame functions only.

1. Every text gets a 64-bit hash.  The directory starts with few bits; buckets that hold
   more than ``capacity`` entries split by one more bit until none is overfull, or the bits are those at
   which even a quarter of a bucket is left on average (``deepest``: the directory doubles with the table).
   All depths are counted at once over the table of leaves.
2. Rows are grouped by hash and bytes: copies are pre-aggregated in the tasks that read
   them, and different texts of one hash stay apart because their bytes differ.
3. The groups become index entries on shared files, dealt to owner tasks by ranges of the
   directory; entries of one hash form a chain.
4. Every row finds its bucket in the directory, and there the chain of its hash; along the chain
   length and SHA-256 tell which entry is its own.  (SHA-256 stands for the bytes that step 2 compared.)

Defined results: a null text equals the empty text; of equal texts the largest id stays,
and of rows that repeat that id one stays; a group without any id has a null ``keep_id``
and keeps one row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import stored

#: Directory bits at first, and bits beyond those that a table of full buckets has on average.
START_DEPTH, SPARE = 4, 4
#: Rows (after collapsing copies) that a bucket holds before it splits.
CAPACITY = 10_000


def deepest(entries: int, capacity: int) -> int:
    """The most bits that a directory of so many entries may have."""
    return min(62, max(START_DEPTH, max(0, -(-entries // capacity) - 1).bit_length()) + SPARE)


def _leaf(key: str | Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth)


def directory(keys: DataFrame, capacity: int = CAPACITY, depth: int | None = None) -> DataFrame:
    """``leaf, depth, bucket``: the bucket of every leaf (of ``depth`` bits) that holds entries.

    A leaf's depth is the least one whose bucket is not overfull.  ``bucket`` is the first
    leaf of the bucket, so buckets ascend with the hash.
    """
    last = depth if depth is not None else deepest(keys.count(), capacity)
    leaves = keys.groupBy(_leaf("hash", last).alias("leaf")).agg(F.count("*").alias("n"))
    depths = leaves.withColumn("depth", F.explode(F.sequence(F.lit(START_DEPTH), F.lit(last))))
    deep = depths.withColumn("bucket", F.expr(f"shiftleft(shiftright(leaf, {last} - depth), {last} - depth)"))
    fits = deep.groupBy("depth", "bucket").agg(F.sum("n").alias("held")).filter(
        (F.col("held") <= capacity) | (F.col("depth") == last))
    return (deep.join(fits.select("depth", "bucket"), ["depth", "bucket"])
            .groupBy("leaf").agg(F.min(F.struct("depth", "bucket")).alias("at"))
            .select("leaf", "at.depth", "at.bucket"))


def index(texts: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, int]:
    """The index of a frame ``doc_id, hash, text``, written by owner tasks to shared files: its entries
    ``bucket, depth, hash, chain, n_bytes, sha, keep_id, group_size``, its directory, and the bits of a leaf."""
    groups = stored(
        texts.groupBy("hash", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("hash", F.octet_length("text").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha"),
                "keep_id", "group_size"), "dedup-groups")
    last = deepest(groups.count(), capacity)
    # a few rows per bucket of ``capacity`` entries, written: a join with it is planned by its size
    leaves = stored(directory(groups, capacity, last), "dedup-directory")
    dealt = groups.withColumn("leaf", _leaf("hash", last)).join(leaves, "leaf")
    chain = F.row_number().over(Window.partitionBy("bucket", "hash").orderBy("n_bytes", "sha"))
    entries = dealt.select("bucket", "depth", "hash", chain.alias("chain"), "n_bytes", "sha", "keep_id", "group_size")
    return stored(entries.repartitionByRange("bucket", "hash").sortWithinPartitions("bucket", "hash", "chain"),
                  "dedup-index"), leaves, last


def looked_up(keys: DataFrame, entries: DataFrame, leaves: DataFrame, last: int) -> DataFrame:
    """Keys ``doc_id, hash, n_bytes, sha`` with their entry: by bucket, then along the chain of the hash."""
    placed = keys.withColumn("leaf", _leaf("hash", last)).join(leaves.select("leaf", "bucket"), "leaf")
    chain = entries.select("bucket", "hash", F.col("n_bytes").alias("_n"), F.col("sha").alias("_sha"), "keep_id", "group_size")
    return placed.join(chain, ["bucket", "hash"]).filter(
        (F.col("n_bytes") == F.col("_n")) & (F.col("sha") == F.col("_sha"))).drop("leaf", "bucket", "_n", "_sha")


def exact_groups(docs: DataFrame, capacity: int = CAPACITY,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    keys = stored(rows.select("doc_id", "hash", F.octet_length("text").alias("n_bytes"),
                              F.unhex(F.sha2("text", 256)).alias("sha")), "dedup-keys")
    found = looked_up(keys, *index(rows, capacity))
    found = found.withColumn("stays", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # rows that repeat the id that stays: one of them; other rows are spread by their id
    turn = F.row_number().over(Window.partitionBy(
        "doc_id", F.when(F.col("stays"), F.col("sha")), F.when(~F.col("stays"), F.col("hash")),
    ).orderBy("n_bytes"))
    return found.select("doc_id", "keep_id", "group_size", (F.col("stays") & (turn == 1)).alias("kept"),
                        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    The rows that stay are found by the index; a row that repeats id and text is dropped
    by its other columns' order, so exactly one stays.
    """
    def fresh(name: str) -> str:
        while name in docs.columns:
            name += "_"
        return name

    # one key for the join and for the choice among repeated rows, so texts are dealt once
    same, sha, turn = fresh("_same"), fresh("_sha"), fresh("_turn")
    kept = exact_groups(docs, capacity).filter("kept").select(
        F.xxhash64("doc_id", "text_sha256").alias(same), F.col("text_sha256").alias(sha))
    keyed = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn(same, F.xxhash64("doc_id", sha))
    rest = F.to_json(F.struct(*(c for c in docs.columns if c not in ("doc_id", "text"))), {"ignoreNullFields": "false"})
    first = F.row_number().over(Window.partitionBy(same, sha).orderBy(
        rest if set(docs.columns) - {"doc_id", "text"} else F.lit(0)))
    return (keyed.join(kept, [same, sha], "left_semi").withColumn(turn, first)
            .filter(F.col(turn) == 1).select(*docs.columns))
