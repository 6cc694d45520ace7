"""Chained summaries against a fold in Python."""

import random
from collections import Counter

import pyarrow as pa

from parlance.operators import summaries as SU


def brute(rows, keep):
    """{(session, total): terms} from rows (session, total, [content])."""
    out, previous, place = {}, {}, Counter()
    for session, total, contents in sorted(rows, key=lambda r: (r[0], r[1])):
        counts = Counter(w for c in contents for w in (c or "").lower().replace(",", " ").split())
        score = {t: s // 2 for t, s in previous.get(session, [])}
        for t, n in counts.items():
            score[t] = score.get(t, 0) + 2 * n
        place[session] += 1
        previous[session] = sorted(((t, s) for t, s in score.items() if s), key=lambda x: (-x[1], x[0]))[:keep]
        out[session, total] = (place[session], previous[session])
    return out


def data(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    return [(s, 10 * i + 3, [" ".join(rng.choices(words, k=rng.choice([0, 1, 4]))) for _ in range(rng.choice([1, 5]))])
            for s in range(7) for i in range(rng.choice([1, 2, 25]))] + [(50, 5, [None, ""]), (50, 9, ["A a, b"]), (50, 12, [""])]


def test_every_summary_equals_the_fold(spark):
    rows = data()
    inputs = spark.createDataFrame([(s, t, [(c,) for c in cs]) for s, t, cs in rows],
                                   "session_id long, archived_total long, messages array<struct<content: string>>").repartition(5)
    for keep in (5, 2):
        got = {(r.session_id, r.archived_total): (r.place, [tuple(x) for x in r.terms])
               for r in SU.chained_summaries(inputs, keep).collect()}
        assert got == brute(rows, keep)
    carried = brute(rows, 5)[50, 12]
    assert carried == (3, [("a", 2), ("b", 1)])  # nothing is said: the terms before fade
    assert SU.chained_summaries(inputs.limit(0)).count() == 0


def test_the_stream_of_counts_may_be_cut_anywhere():
    rows = [(s, t, w, n) for s in (1, 2) for t in (10, 20, 30) for w, n in (("a", t // 10), ("b", s), (None, 0))]
    names = ["session_id", "archived_total", "term", "n"]
    whole = pa.record_batch([pa.array(c) for c in zip(*rows)], names=names)
    want = pa.Table.from_batches(SU._fold(5)(iter([whole]))).to_pylist()
    assert len(want) == 6
    for size in (1, 2, 7):
        cut = [whole.slice(at, size) for at in range(0, len(rows), size)]
        assert pa.Table.from_batches(SU._fold(5)(iter(cut))).to_pylist() == want


def test_words_of_a_sentence_do_not_carry_its_text(spark):
    from parlance.operators import scoring as S

    said = spark.createDataFrame([(1, 1, 10, "Red lamp. Blue chair!"), (1, 2, 20, "Red chair."), (2, 1, 5, "Green lamp."),
                                  (2, 1, 5, "Green lamp."), (3, 1, 5, None)], "session_id long, msg_id long, ts long, content string")
    out = S.conversation_topics(said, 2, 1)
    got = {r.session_id: (r.tags, r.summary) for r in out.collect()}
    assert got == {1: (["chair", "red"], "Red chair."), 2: (["green", "lamp"], "Green lamp.")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any(", sentence#" in line and "tfidf#" in line for line in plan.splitlines())
