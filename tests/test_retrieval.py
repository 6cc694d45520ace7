"""Retrieval: exact top-k vs brute force, IVF recall floor, BM25 vs a Python model."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.operators import dense as D
from parlance.operators import retrieval as R
from parlance.plans import retrieval_queries as RQ
from parlance.sources import bindings as B

from conftest import SF_CHECK


def test_dense_top_k_brute_force(spark):
    vecs = B.vectors(spark, SF_CHECK)
    q = RQ.centroid_queries(spark, SF_CHECK)
    got = {(r.query_id, r.rank): r.id for r in D.dense_top_k(q, vecs, 5, (), in_shop=True).collect()}
    pv = [(r.id, r.shop_id, np.array(r.dense_vector, dtype=np.float64)) for r in vecs.collect()]
    for r in q.collect():
        qv = np.array(r.query_vector)
        cand = sorted((round(float(((v - qv) ** 2).sum()), 9), i) for i, s, v in pv if s == r.shop_id)
        for k in range(5):
            assert got[(r.query_id, k + 1)] == cand[k][1]


def test_bm25_python_model(spark):
    docs = [(1, "the cat sat on the mat"), (2, "the dog"), (3, "Cats and dogs, the end!"), (4, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.term): r.weight for r in R.bm25_weights(df).collect()}
    toks = {d: [t for t in __import__("re").split(r"[^\w]+", x.lower()) if t] for d, x in docs}
    n, avgdl = len(docs), sum(len(t) for t in toks.values()) / len(docs)
    dfreq = {}
    for t in toks.values():
        for w in set(t):
            dfreq[w] = dfreq.get(w, 0) + 1
    for d, t in toks.items():
        for w in set(t):
            tf = t.count(w)
            idf = math.log(1 + (n - dfreq[w] + 0.5) / (dfreq[w] + 0.5))
            want = idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(t) / avgdl))
            assert abs(got[(d, w)] - want) < 1e-9
    qt = spark.createDataFrame([(1, "cat", 1.0), (1, "the", 1.0)], "query_id long, term string, qweight double")
    top = R.sparse_top_k(qt, R.bm25_weights(df), k=2).orderBy("rank").collect()
    assert top[0].doc_id == 1
    only = R.bm25_weights(df, only_terms=qt.select("term"))
    assert {(r.doc_id, r.term): r.weight for r in only.collect()} == {k: v for k, v in got.items() if k[1] in ("cat", "the")}


def brute(queries, vectors, k):
    """{(query, id, distance, rank)} of {id: vector} on both sides."""
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids])
    out = set()
    for q, v in queries.items():
        far = ((x - np.array(v)) ** 2).sum(1).round(9)
        order = np.lexsort((ids, far))[:k]
        out |= {(q, int(ids[i]), round(float(far[i]), 6), n + 1) for n, i in enumerate(order)}
    return out


def rows_of(df):
    return {(r.query_id, r.id, round(r.distance, 6), r["rank"]) for r in df.collect()}


def random_frames(spark, n=700, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).round(2)
    x[n // 2:n // 2 + 40] = x[0]  # copies, which tie
    vectors = {i: v.tolist() for i, v in enumerate(x)}
    queries = {i: x[i].tolist() for i in range(0, n, 29)} | {9000: rng.normal(size=dim).tolist()}
    v = spark.createDataFrame([(i, v, f"s{i % 3}", f"text {i}") for i, v in vectors.items()],
                              "id long, dense_vector array<double>, shop_id string, text_content string").repartition(5)
    q = spark.createDataFrame([(i, v, f"s{i % 4}") for i, v in queries.items()],
                              "query_id long, query_vector array<double>, shop_id string")
    return vectors, queries, v, q


def test_exact_search_equals_brute_force(spark, monkeypatch):
    vectors, queries, v, q = random_frames(spark)
    want = brute(queries, vectors, 7)
    out = D.dense_top_k(q, v, 7, ("text_content", "shop_id"))
    assert rows_of(out) == want
    assert all(r.text_content == f"text {r.id}" and r.shop_id == f"s{r.id % 3}" for r in out.collect())
    in_shop = set().union(*(brute({i: x}, {j: y for j, y in vectors.items() if j % 3 == i % 4}, 7) for i, x in queries.items()
                            if i % 4 < 3))
    assert rows_of(D.dense_top_k(q, v, 7, (), in_shop=True)) == in_shop
    monkeypatch.setattr(D, "CHUNK_QUERIES", 6)  # several chunks
    assert rows_of(D.dense_top_k(q, v, 7, ())) == want


def test_exact_search_takes_small_blocks(monkeypatch):
    """The task's loop, with blocks of three vectors."""
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(50, 4)), rng.normal(size=(6, 4))
    monkeypatch.setattr(D, "PAIRS", 18)
    batch = pa.record_batch([pa.array(np.arange(50)), pa.array(x.tolist())], names=["id", "dense_vector"])
    queries = pa.table({"query_id": pa.array(np.arange(6)), "query_vector": pa.array(q.tolist())})
    out = pa.Table.from_batches(D._scan(queries, 4, 5, False, [])(iter([batch.slice(0, 20), batch.slice(20)])))
    got = {(r["query_id"], r["id"]) for r in out.to_pylist()}
    assert got == {(i, int(n)) for i in range(6) for n in ((x - q[i]) ** 2).sum(1).argsort()[:5]}


def test_odd_vectors_and_empty_sides(spark):
    schema = "id long, dense_vector array<double>, shop_id string"
    v = spark.createDataFrame([(1, [0.0, 1.0], "a"), (2, None, "a"), (3, [1.0], "a"), (4, [0.0, 1.0], None),
                               (5, [float("nan"), 0.0], "a")], schema)
    q = spark.createDataFrame([(1, [0.0, 1.0], "a"), (2, None, "a"), (3, [5.0, 1.0], None)],
                              "query_id long, query_vector array<double>, shop_id string")
    assert rows_of(D.dense_top_k(q, v, 2, ())) == {(1, 1, 0.0, 1), (1, 4, 0.0, 2), (3, 1, 25.0, 1), (3, 4, 25.0, 2)}
    assert {(r.query_id, r.id) for r in D.dense_top_k(q, v, 9, (), in_shop=True).collect()} == {(1, 1)}
    assert D.dense_top_k(q, v.limit(0), 3, ()).count() == 0 == D.dense_top_k(q.limit(0), v, 3, ()).count()


def test_index_with_every_cell_probed_is_exact_and_can_be_extended(spark, tmp_path):
    vectors, queries, v, q = random_frames(spark)
    model = D.fit(v, nlist=9, parts=3)
    path = D.build(v.where("id < 400"), model, str(tmp_path / "index"))
    part = {i: x for i, x in vectors.items() if i < 400}
    assert rows_of(D.search(path, q, v, 7, 9, 400, ())) == brute(queries, part, 7)
    D.add(path, v.where("id >= 400"))
    assert rows_of(D.search(path, q, v, 7, 9, 700, ())) == brute(queries, vectors, 7)
    held = spark.read.parquet(f"{path}/blocks").collect()
    assert sorted(i for r in held for i in r.ids) == sorted(vectors)
    x = {i: np.array(y) for i, y in vectors.items()}
    for r in held:
        assert all(((x[i] - model.centers) ** 2).sum(1).argmin() == r.cell for i in r.ids)


def test_code_distances_are_those_of_the_codewords(spark):
    _, _, v, _ = random_frames(spark, n=300)
    model = D.fit(v, nlist=5, parts=4)
    x = np.array([r.dense_vector for r in v.collect()])
    cells = model.cells(x)
    codes = model.codes(x, cells)
    near = model.centers[cells] + model.words[np.arange(4), codes].reshape(len(x), -1)
    for c in range(5):
        table = model.tables(x[:3], c)
        own = np.flatnonzero(cells == c)
        assert np.allclose(table[:, np.arange(4), codes[own]].sum(-1), ((x[:3, None] - near[None, own]) ** 2).sum(-1))
    assert ((x - near) ** 2).sum() < 0.2 * ((x - x.mean(0)) ** 2).sum()


def test_tasks_of_an_index_search_grow_with_its_pairs(spark, tmp_path, monkeypatch):
    _, _, v, _ = random_frames(spark, n=300)
    v = v.union(v.limit(1).withColumn("id", F.explode(F.sequence(F.lit(1000), F.lit(1199)))).select(*v.columns)).cache()
    queries = v.select(F.col("id").alias("query_id"), F.col("dense_vector").alias("query_vector"))
    path = D.build(v, D.fit(v, nlist=5, parts=4), str(tmp_path / "index"))
    whole = sorted(map(tuple, D.candidates(path, queries, 3, 20).collect()))
    # the nearest by code: distances from the codewords, of equal ones the lower id
    model, rows = D.load(spark, path), v.orderBy("id").collect()
    x, ids = np.array([r.dense_vector for r in rows]), np.array([r.id for r in rows])
    cells = model.cells(x)
    near = model.centers[cells] + model.words[np.arange(4), model.codes(x, cells)].reshape(len(x), -1)
    far = ((x[:, None] - near[None]) ** 2).sum(-1)
    probed = np.argsort(((x[:, None] - model.centers[None]) ** 2).sum(-1), axis=1, kind="stable")[:, :3]
    far[~(cells[None, :, None] == probed[:, None]).any(-1)] = np.inf
    assert whole == sorted((int(q), int(i)) for q, f in zip(ids, far) for i in ids[np.lexsort((ids, f))[:20]])
    monkeypatch.setattr(D, "TASK_PAIRS", 25_000)
    dealt = D.candidates(path, queries, 3, 20)
    assert "RoundRobinPartitioning(10)" in dealt._jdf.queryExecution().toString()
    assert sorted(map(tuple, dealt.collect())) == whole


def test_registered_index_compares_at_most_a_fifth_as_whole_vectors(spark):
    n = B.vectors(spark, SF_CHECK).count()
    assert RQ.IVF_RERANK <= n / 5


@pytest.mark.parametrize("sf_dir", [SF_CHECK, "/root/testdata/sf0.1"])
def test_registered_ivf_query_finds_nine_of_ten_neighbours(spark, sf_dir):
    """The registered query, with its own cells, probes and queries, against brute force."""
    rows = B.vectors(spark, sf_dir).select("id", "dense_vector").collect()
    ids, x = np.array([r.id for r in rows]), np.array([r.dense_vector for r in rows], np.float64)
    exact = {(int(i), int(n)) for i, v in zip(ids, x) if i % 50 == 0
             for n in ids[np.lexsort((ids, ((x - v) ** 2).sum(1).round(9)))[:10]]}
    got = {(r.query_id, r.id) for r in RQ.dense_top_k_ivf(spark, sf_dir).collect()}
    assert {q for q, _ in got} == {q for q, _ in exact}
    assert len(got & exact) / len(exact) >= 0.9


def test_document_frequencies_meet_their_rows_in_two_ways(spark):
    rows = [(d, 5, t, 1) for t, n in (("a", 50), ("b", 20), ("c", 3), ("d", 1), ("é", 1)) for d in range(n)]
    tf = spark.createDataFrame(rows, "doc_id long, dl int, term string, tf long")
    df = tf.groupBy("term").count().withColumnRenamed("count", "df")
    whole = sorted(map(tuple, tf.join(df, "term").select("doc_id", "term", "df").collect()))
    for sent in (1, 2, 3, 5):
        got = R.with_frequencies(tf, df, sent).select("doc_id", "term", "df")
        assert sorted(map(tuple, got.collect())) == whole
    plan = R.with_frequencies(tf, df, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "Union" in plan
