"""Exact ranks of many rows without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import stored

#: Bits that ``monotonically_increasing_id`` gives to the row within its partition.
_WITHIN = 33


def ranked(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``rows`` with their position (from 1) in ``order``; ties get different positions.

    Rows are dealt to ranges of the order and numbered there while they are written once;
    the rows of earlier ranges are added from one count per range (as many rows as shuffle
    partitions), so nothing is collected and no task holds more than a range.
    """
    at, before = "_at", "_before"
    while {at, before} & set(rows.columns):
        at, before = at + "_", before + "_"
    dealt = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn(at, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(F.col(at), _WITHIN)
    counts = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # one row per shuffle partition
    sums = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias(before))
    return (dealt.join(F.broadcast(sums), part == F.col("part"))
            .withColumn(out, F.col(before) + F.expr(f"`{at}` & {(1 << _WITHIN) - 1}L") + 1)
            .drop("part", at, before))
