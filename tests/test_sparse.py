"""Sparse top-k: whole results against brute force, and what the blocks skip."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from parlance.operators import sparse as S


def brute(queries, postings, k, within=False):
    """{(query, document, score, rank)} of rows (query, shop, term, qweight) and (document, shop, term, weight)."""
    weight = defaultdict(float)
    for doc, shop, term, w in postings:
        if None not in (doc, term, w):
            weight[doc, shop if within else None, term] += w
    asked = defaultdict(float)
    for query, shop, term, q in queries:
        if None not in (query, term, q):
            asked[query, shop if within else None, term] += q
    by_term = defaultdict(list)
    for (doc, shop, term), w in weight.items():
        by_term[shop, term].append((doc, w))
    score = defaultdict(float)
    for (query, shop, term), q in asked.items():
        for doc, w in by_term[shop, term]:
            score[query, doc] += q * w
    best = defaultdict(list)
    for (query, doc), s in score.items():
        best[query].append((-round(s, 9), doc))
    return Counter((q, d, round(-s, 6) + 0.0, at + 1) for q, rows in best.items() for at, (s, d) in enumerate(sorted(rows)[:k]))


def check(spark, queries, postings, k=10, within=False):
    q = spark.createDataFrame(queries, "query_id long, shop string, term string, qweight double")
    p = spark.createDataFrame(postings, "doc_id long, shop string, term string, weight double").repartition(5)
    out = S.sparse_top_k(q, p, k, ("shop",) if within else ())
    assert out.columns == ["query_id", "doc_id", "score", "rank"]
    got = Counter((r.query_id, r.doc_id, round(r.score, 6) + 0.0, r["rank"]) for r in out.collect())
    assert got == brute(queries, postings, k, within)


def corpus(docs=500, terms=40, seed=1, low=0.1):
    rng = random.Random(seed)
    return [(d, f"s{d % 3}", f"t{t}", rng.uniform(low, 3) * math.log(2 + t)) for d in range(docs)
            for t in range(terms) if rng.random() < 1 / (1 + t / 6)]


def queries(n=20, terms=45, seed=2, low=0.5):
    rng = random.Random(seed)
    return [(i, f"s{i % 4}", f"t{t}", rng.uniform(low, 2)) for i in range(n) for t in rng.sample(range(terms), rng.choice([1, 3, 20]))]


@pytest.mark.parametrize("within", [False, True])
def test_whole_result_equals_brute_force(spark, within):
    check(spark, queries(), corpus(), within=within)


def test_small_slices_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_TERMS", 25)
    check(spark, queries(), corpus(200), k=3)
    rows = corpus(300)
    held = sorted((d, t, w) for d, _, t, w in rows)
    import pyarrow as pa
    monkeypatch.setattr(S, "SLICE", 100)
    batches = [pa.record_batch([pa.array(c) for c in zip(*held[at:at + 64])], names=["doc_id", "term", "weight"])
               for at in range(0, len(held), 64)]
    vocabulary = pa.array(sorted({t for _, t, _ in held}))
    slices = list(S._slices(batches, vocabulary))
    assert len(slices) > 10
    ids = [i for s in slices for i in s.ids.tolist()]
    assert len(ids) == len(set(ids)) and set(ids) == {d for d, _, _ in held}  # a document lies in one slice
    assert sum(len(o) for s in slices for o, _ in s.by_doc.values()) == len(held)


def test_any_sign_repeats_nulls_and_ties(spark):
    check(spark, queries(low=-2), corpus(150, low=-3))
    rows = [(d, "s", "a", 1.0) for d in range(50)] + [(7, "s", "a", 1.0), (None, "s", "a", 9.0), (3, "s", None, 9.0),
                                                     (4, "s", "a", None), (5, "s", "b", 0.0)]
    check(spark, [(1, "s", "a", 1.0), (1, "s", "a", 0.5), (2, "s", "b", 1.0), (3, "s", None, 1.0), (None, "s", "a", 1.0),
                  (4, "s", "a", None), (5, "s", "unheard of", 1.0)], rows, k=4)


def test_empty_sides(spark):
    check(spark, queries(), [])
    check(spark, [], corpus(20))


def test_blocks_are_skipped_and_nothing_is_lost():
    """Many documents share the common terms; the rare ones decide."""
    rng = np.random.default_rng(4)
    docs = 20_000
    parts = [(np.arange(docs), np.full(docs, t), rng.uniform(0.1, 0.5, docs)) for t in range(6)]
    for t in range(6, 12):
        held = rng.choice(docs, 300, replace=False)
        parts.append((held, np.full(300, t), rng.uniform(2, 9, 300)))
    ids, terms, weights = (np.concatenate(x) for x in zip(*parts))
    postings = S.Postings(ids, terms, weights)
    query = [(t, 1.0) for t in range(12)]
    near, read = S.met(postings, query, 10, -np.inf)
    assert read < len(ids) / 4 and len(near) < docs / 20
    every = postings.exact(np.arange(docs), query)
    order = np.lexsort((np.arange(docs), -every))[:10]
    assert set(order) <= set(near)
    for t, (ords, w) in postings.by_impact.items():
        assert (np.diff(w) <= 0).all() and len(ords) == (terms == t).sum()


def test_rows_between_stages_do_not_grow_with_queries_times_documents(spark):
    """A third of the documents hold every query's term; a task still hands on k rows per query."""
    postings = spark.range(30_000).selectExpr("id AS doc_id", "'hot' AS term", "1.0 + id % 97 AS weight")
    asked = spark.range(40).selectExpr("id AS query_id", "'hot' AS term", "1.0D AS qweight")
    out = S.sparse_top_k(asked, postings, 5)
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "CartesianProduct" not in plan
    assert out.count() == 200
