"""Chained summaries (#38, #60g): every summary of a session carries the terms of the one before.

A summary is the ``keep`` best terms of a session's archive at a trigger.  A term scores ``WEIGHT`` times its count
in the trigger's own messages, plus half (rounded down) of what it scored in the previous summary, if
it was kept there: what is no longer said fades.

Term counts per trigger are an ordinary aggregate.  The fold needs a session's triggers in order and nothing else: the
counts are dealt by session, ordered by trigger inside the partition, and streamed past a state of
``keep`` terms and one trigger's counts, so a session of any length needs no more memory than a short one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.retrieval import tokens
from parlance.session import arrow_map

#: Terms of a summary, and what one mention counts.
KEEP, WEIGHT = 5, 2
OUTPUT = "session_id long, archived_total long, place int, terms array<struct<term: string, score: long>>"


def window_terms(inputs: DataFrame) -> DataFrame:
    """``session_id, archived_total, term, n``: term counts of each trigger's messages (``summary_input``)."""
    said = inputs.select("session_id", "archived_total", F.explode("messages").alias("m"))
    words = said.select("session_id", "archived_total", F.explode(tokens(F.col("m.content"))).alias("term"))
    return words.groupBy("session_id", "archived_total", "term").agg(F.count(F.lit(1)).alias("n"))


def next_summary(previous: list[tuple[str, int]], counts: dict[str, int], keep: int = KEEP) -> list[tuple[str, int]]:
    """The best terms after one more trigger, best first; of equal scores the lesser term."""
    score = {t: s // 2 for t, s in previous}
    for term, n in counts.items():
        score[term] = score.get(term, 0) + WEIGHT * n
    return sorted(((t, s) for t, s in score.items() if s > 0), key=lambda x: (-x[1], x[0]))[:keep]


def _fold(keep: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        session, trigger, place, summary, counts, done = None, None, 0, [], {}, []

        def close():
            nonlocal summary, place, counts
            summary, place, counts = next_summary(summary, counts, keep), place + 1, {}
            done.append((session, trigger, place, [{"term": t, "score": s} for t, s in summary]))

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done), (
                pa.int64(), pa.int64(), pa.int32(),
                pa.list_(pa.struct([pa.field("term", pa.string()), pa.field("score", pa.int64())]))))]
            done.clear()
            return pa.record_batch(columns, names=["session_id", "archived_total", "place", "terms"])

        for batch in batches:
            for s, t, term, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (s, t) != (session, trigger):
                    if trigger is not None:
                        close()
                    if s != session:
                        summary, place = [], 0
                    session, trigger = s, t
                if term is not None:
                    counts[term] = n
            if done:
                yield out()
        if trigger is not None:
            close()
            yield out()
    return run


def chained_summaries(inputs: DataFrame, keep: int = KEEP) -> DataFrame:
    """``session_id, archived_total, place, terms`` of every trigger: its place in the session's chain and its
    summary's terms.  A trigger whose messages hold no term carries the previous ones on."""
    every = inputs.select("session_id", "archived_total").withColumns(
        {"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long")})
    rows = window_terms(inputs).unionByName(every)
    dealt = rows.repartition("session_id").sortWithinPartitions("session_id", "archived_total")
    return arrow_map(dealt.select("session_id", "archived_total", "term", "n"), _fold(keep), OUTPUT)
