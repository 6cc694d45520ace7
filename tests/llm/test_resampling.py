"""Importance resampling against brute force: weights, scores, the draw and edge rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from parlance.llm import resampling as R
from parlance.llm.common import documents
from parlance.sources.tables import read_table

from conftest import SF_SMALL


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def feats(text, n):
    w = words(text)
    return [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n=1, percent=10, least=20, seed=2024):
    """{row number: (doc_id, n_features, weight, score, eligible)} and how many are drawn."""
    at = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(at(f) for _, t in docs for f in feats(t, n))
    t = Counter(at(f) for x in target for f in feats(x, n))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for i, text in docs:
        f = feats(text, n)
        w = sum(gain(at(x)) for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))),
                    len(words(text)) >= least))
    return out, percent * sum(x[4] for x in out) // 100


def check(spark, docs, target, **options):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, _at string, rank int")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = R.resample(frame.repartition(5), goal, **options).collect()
    want, drawn = brute(docs, target, **options)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(x[:4] for x in want)
    best = sorted((x for x in want if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))[:drawn]
    ranks = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranks] == list(range(1, drawn + 1))
    assert [(r.doc_id, r.score) for r in ranks] == [(x[0], x[3]) for x in best]
    return got


def corpus(rows=400):
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "é1", "Ünder", "x-y", "日本", "the", "of", "42"]
    return [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 19, 20, 60])))) for i in range(rows)]


@pytest.mark.parametrize("n", [1, 2])
def test_whole_result_equals_brute_force(spark, n):
    check(spark, corpus(), ["alpha beta alpha", "the é1", None, ""], n=n)


def test_edge_rows(spark):
    docs = corpus(60) + [(None, "a " * 30), (None, None), (7, "a " * 30), (7, "a " * 30), (900, ""), (901, "A_b[c]d`e{f"),
                         (902, "long word " * 40_000), (-5, "the " * 25)]
    check(spark, docs, ["the a long"], percent=50)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.resample(none, none.select("text")).count() == 0
    check(spark, corpus(50), [])


def test_planes_give_the_exact_product():
    rng = np.random.default_rng(3)
    for low, high in ((-9000, 9000), (0, 5), (-7, 0), (0, 1)):
        gain = rng.integers(low, high, R.BUCKETS).tolist()
        counts = (rng.integers(0, 2_000_000, (7, R.BUCKETS)) * (rng.random((7, R.BUCKETS)) < 0.01)).astype(np.int32)
        counts[3] = 0
        assert (R.weights(counts, *R.gain_planes(gain)) == counts.astype(np.int64) @ np.array(gain)).all()


def test_documents_of_the_driver(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark, SF_SMALL, "doc_id", "text").collect()]
    target = [r.text for r in read_table(spark, SF_SMALL, "benchmark", "text").collect()]
    check(spark, docs, target)
