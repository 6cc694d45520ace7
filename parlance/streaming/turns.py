"""The per-turn rules on a stream, joined with tables that change while it runs (#75).

Each micro-batch is an ordinary DataFrame, so the rules are those of the batch queries.  The static sides
(profiles, rule tables) are given as functions and read anew for every micro-batch: a
profile or a rule that changes holds from the next one on.  Each micro-batch writes a partition of its own
number, which a batch that runs again replaces.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.text import contains_any, normalize
from parlance.operators import catalog, scoring
from parlance.session import ensure_checkpoint_dir

#: Rules of a table, at most: they are compiled into the expressions of a micro-batch.
MOST_RULES = 10_000
RULES = "kind string, label string, place int, term string"


def rule_rows(spark: SparkSession, **kinds: dict[str, list[str]]) -> DataFrame:
    """Rule tables ``label -> terms`` as rows ``kind, label, place, term``; ``place`` is the label's."""
    return spark.createDataFrame([(kind, label, at, term) for kind, rules in kinds.items()
                                  for at, (label, terms) in enumerate(rules.items()) for term in terms], RULES)


def read_rules(rows: DataFrame) -> dict[str, dict[str, list[str]]]:
    """The tables of rule rows, labels in their order.  A table of more than ``MOST_RULES`` rows is refused."""
    held = rows.limit(MOST_RULES + 1).collect()
    if len(held) > MOST_RULES:
        raise ValueError(f"a rule table holds at most {MOST_RULES} rules")
    out: dict[str, dict[str, list[str]]] = {}
    for r in sorted(held, key=lambda r: (r["kind"], r["place"], r["label"], r["term"])):
        out.setdefault(r["kind"], {}).setdefault(r["label"], []).append(r["term"])
    return out


def text_rules(messages: DataFrame, rules: dict, text_col: str = "content") -> DataFrame:
    """#51, #59 and #60 of messages by the given rule tables (``intent``, ``emotion``, ``flag``, ``price``)."""
    scored = scoring.intent_scores(messages, text_col, rules["intent"])
    scored = scoring.emotion_policy_scores(scored, text_col, rules["emotion"], rules["flag"])
    prices = [t for terms in rules.get("price", {"price": catalog.PRICE_KEYWORDS}).values() for t in terms]
    return scored.withColumn("price_intent", contains_any(normalize(F.col(text_col)), prices))


def run_batches(stream: DataFrame, name: str, rules: Callable[[DataFrame], DataFrame], schema: T.StructType,
                checkpoint_root: str | None = None) -> DataFrame:
    """Apply ``rules`` to every micro-batch of what is available; the table that they write."""
    spark = stream.sparkSession
    root = os.path.join(checkpoint_root or ensure_checkpoint_dir(spark), name)
    out = os.path.join(root, "out")

    def write(batch: DataFrame, number: int) -> None:
        (rules(batch).withColumn("batch_id", F.lit(number)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out))

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", os.path.join(root, "checkpoint"))
     .trigger(availableNow=True).start().awaitTermination())
    whole = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(whole).parquet(out).drop("batch_id")
