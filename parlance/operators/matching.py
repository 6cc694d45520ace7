"""Texts against many names of their shop: substring hits and word overlap (#22, #60d).

*Substring hits.*  Every name is filed under one of its grams (``GRAM`` characters, or the whole name if it
is shorter): the one that the fewest names of the shop hold.  A text holds at most as many
grams as characters, each met once, so a text is compared with the few names filed under its grams.
Names that share a prefix, or all but a number, are still told apart by their rarest gram.  The pairing is an
equi-join on (shop, gram), which also spreads a hot shop.

*Word overlap.*  A word that most names of a shop hold would pair every text with every name.  So
a shop's names are cut into slices and its texts into parts of bounded size, both by hash; one
task holds a slice and streams a part's texts over its word lists, and hands on one row per text: the best name
of the slice.  No pair of text and name becomes a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.session import ship_package, stored

#: Characters of a gram.
GRAM = 4
#: Names of a slice and texts of a part, on average.
SLICE_NAMES, PART_TEXTS = 20_000, 50_000


def _grams(text: str, length) -> F.Column:
    """The distinct substrings of a column with this many characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - length + 1),
                                        lambda i: F.substring(F.col(text), i, F.lit(length))))


def signatures(names: DataFrame) -> DataFrame:
    """``shop_id, token, gram``: the gram that each distinct name is filed under."""
    each = names.select("shop_id", "token").where(F.length("token") > 0).distinct()
    grams = each.select("shop_id", "token", F.explode(
        F.when(F.length("token") >= GRAM, _grams("token", GRAM)).otherwise(F.array("token"))).alias("gram"))
    held = grams.groupBy("shop_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    return (grams.join(held, ["shop_id", "gram"]).groupBy("shop_id", "token")
            .agg(F.min(F.struct("n", "gram")).alias("rarest")).select("shop_id", "token", "rarest.gram"))


def name_hits(hays: DataFrame, names: DataFrame) -> DataFrame:
    """``shop_id, _hay, token`` for every name that occurs in a text of its shop."""
    filed = stored(signatures(names), "name-signatures")
    # at most GRAM rows: the lengths of grams, of which only the last is usual
    lengths = sorted(r["n"] for r in filed.select(F.length("gram").alias("n")).distinct().collect())
    texts = hays.where(F.length("_hay") > 0)
    if not lengths:
        return texts.select("shop_id", "_hay", F.lit(None).cast("string").alias("token")).limit(0)
    grams = F.flatten(F.array(*[F.when(F.length("_hay") >= n, _grams("_hay", n)).otherwise(
        F.array().cast("array<string>")) for n in lengths]))
    met = texts.select("shop_id", "_hay", F.explode(grams).alias("gram")).join(filed, ["shop_id", "gram"])
    return met.where(F.instr("_hay", F.col("token")) > 0).select("shop_id", "_hay", "token")


class WordLists:
    """For every word the names of a slice that hold it, the best name first."""

    def __init__(self, names: list[list[str]]):
        lists: dict[str, list[int]] = {}
        for at, words in enumerate(names):
            for word in set(words):
                lists.setdefault(word, []).append(at)
        self.lists = {word: np.array(at) for word, at in lists.items()}

    def best(self, words: list[str]) -> tuple[int, int] | None:
        """How many words the best name shares with a text, and its number; of equal names the earlier."""
        met = [self.lists[w] for w in set(words) if w in self.lists]
        if not met:
            return None
        if len(met) == 1:
            return 1, int(met[0][0])
        shared = np.bincount(np.concatenate(met))
        at = int(shared.argmax())
        return int(shared[at]), at


def _overlap(key, texts: pa.Table, names: pa.Table) -> pa.Table:
    """The best name of a slice for each text of a part."""
    held = names.column("names").chunk(0).values if names.num_rows else None
    lists = WordLists(held.field("words").to_pylist() if names.num_rows else [])
    found = [lists.best(words) for words in texts.column("words").to_pylist()]
    rows = pa.array([i for i, f in enumerate(found) if f], pa.int64())
    best = pa.array([f[1] for f in found if f], pa.int64())
    return pa.table({
        "shop_id": texts.column("shop_id").take(rows), "_hay": texts.column("_hay").take(rows),
        "shared": pa.array([f[0] for f in found if f], pa.int32()),
        "best": held.field("best").take(best) if names.num_rows else pa.nulls(0)})


def best_overlap(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``shop_id, _hay, shared, best``: for each text the name of its shop that shares the most words.

    ``texts``: ``shop_id, _hay, words``, texts distinct in a shop; ``names``: ``shop_id, token, best, words``, where
    the least ``best`` (a struct) goes first among equals.  Texts that share no word have no row."""
    sizes = (names.groupBy("shop_id").agg(F.ceil(F.count(F.lit(1)) / SLICE_NAMES).cast("int").alias("slices"))
             .join(texts.groupBy("shop_id").agg(F.ceil(F.count(F.lit(1)) / PART_TEXTS).cast("int").alias("parts")), "shop_id"))
    sizes = stored(sizes, "match-sizes")
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = texts.join(sizes, "shop_id").select(
        "shop_id", "_hay", "words", dealt("_hay", "parts").alias("part"), every("slices").alias("slice"))
    right = (names.join(sizes, "shop_id").withColumn("slice", dealt("token", "slices")).groupBy("shop_id", "slice", "parts")
             .agg(F.sort_array(F.collect_list(F.struct("best", "words"))).alias("names"))
             .select("shop_id", "slice", "names", every("parts").alias("part")))
    key = ["shop_id", "slice", "part"]
    ship_package(texts.sparkSession)
    schema = T.StructType([texts.schema["shop_id"], texts.schema["_hay"], T.StructField("shared", T.IntegerType()),
                           names.schema["best"]])
    each = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_overlap, schema)
    top = each.groupBy("shop_id", "_hay").agg(F.min(F.struct((-F.col("shared")).alias("less"), "best")).alias("top"))
    return top.select("shop_id", "_hay", (-F.col("top.less")).alias("shared"), F.col("top.best").alias("best"))
