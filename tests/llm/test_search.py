"""Ranked lexical search against brute force, the pair bounds and edge rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from parlance.llm import search as S
from parlance.llm.common import documents
from parlance.sources.tables import read_table

from conftest import SF_SMALL


def terms(text):
    raw = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in raw]


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, want in asked.items():
        scores = []
        for i, c in counts:
            m = 100 - 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (
                1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in want if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, at + 1, i, -s) for at, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return Counter(out)


def check(spark, docs, items, k=50, **options):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, item_id string")
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    got = S.rank(frame.repartition(4), asked, k, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == brute(docs, items, k)


def corpus(rows=600, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "of", "é", "日本"]
    weights = [1 / (i + 1) for i in range(60)] + [4, 3, 1, 0.2]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 4, 30, 200])))) for i in range(rows)]


def questions(rows=25):
    rng = random.Random(9)
    return [(i, " ".join(rng.sample([f"W{j}" for j in range(70)] + ["the", "of", "é"], rng.choice([1, 2, 7, 30]))))
            for i in range(rows)]


def test_whole_result_equals_brute_force(spark):
    check(spark, corpus(), questions())


def test_small_blocks_chunks_and_k(spark):
    check(spark, corpus(300), questions(12), k=3, block=16, chunk_terms=20)


def test_edge_rows(spark):
    docs = corpus(80) + [(None, "w1 w2"), (None, None), (5, "w1 w2"), (5, "w1 w2"), (900, ""), (901, "A_b[c]"),
                         (902, "w3 the " * 60_000), (-1, "w1 w2"), (903, "?!")]
    items = [(1, "w1 w2 w2"), (1, "the"), (1, "w1"), (None, "w3"), (2, None), (3, ""), (4, "unheard of it"), (5, "A b")]
    check(spark, docs, items, k=5)


def test_equal_scores_go_by_id(spark):
    check(spark, [(i, "same text here") for i in range(200, 0, -1)] + [(300, "other")], [(1, "text same")], k=7, block=32)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert S.rank(none, items).count() == 0
    assert S.rank(spark.createDataFrame([(1, "w1")], "doc_id long, text string"), items.limit(0)).count() == 0


def test_documents_of_the_driver(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark, SF_SMALL, "doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in read_table(spark, SF_SMALL, "benchmark", "item_id", "text").collect()]
    check(spark, docs, items)


def _blocks(spark, pairs=True):
    docs = spark.createDataFrame(corpus(3000, 7), "doc_id long, text string").coalesce(1)
    items = [sorted(set(terms(t))) for _, t in questions()]
    vocabulary = {t.encode(): i for i, t in enumerate(sorted({t for x in items for t in x}))}
    wanted = [[vocabulary[t.encode()] for t in x] for x in items]
    index, weight, numbers = S.build_index(docs, vocabulary, wanted, block=500)
    rows = index.toArrow().to_batches()
    return [S.Block(c) for c in S._arrays(rows)], wanted, weight, numbers


def test_intersection_lists_hold_the_joint_maxima(spark):
    blocks, wanted, weight, numbers = _blocks(spark)
    seen = 0
    for block in blocks:
        for (a, b), number in numbers.items():
            x, y = (dict(zip(block.lists[t][0].tolist(), block.lists[t][1].tolist())) if t in block.lists else {}
                    for t in (a, b))
            both = sorted(set(x) & set(y))
            if not both:
                assert number not in block.pairs
                continue
            seen += 1
            docs, most = block.pairs[number]
            assert docs.tolist() == both and most == max(x[d] + y[d] for d in both)
    assert seen > 100


def test_pair_bounds_skip_more_than_single_bounds(spark):
    blocks, wanted, weight, numbers = _blocks(spark)
    work = {"pairs": 0, "single": 0, "all": 0}
    for own in wanted:
        for block in blocks:
            order, pairs = S.plan(own, weight, numbers)
            docs, scores, n = S.search_block(block, order, pairs, 5, 1)
            work["pairs"] += n
            docs1, scores1, n = S.search_block(block, order, [], 5, 1)
            work["single"] += n
            work["all"] += sum(len(block.lists[t][0]) for t in own if t in block.lists)
            assert np.sort(scores)[-5:].tolist() == np.sort(scores1)[-5:].tolist()
    assert work["pairs"] < work["single"] < work["all"]


def test_a_rest_is_cut_at_least_cost():
    unit = lambda *most: S.Unit([(None, None, m) for m in most])
    singles = [unit(m) for m in (9, 8, 7, 6, 5)]
    pairs = [S.Unit([(None, None, 9), (None, None, 8)], None, 16), unit(8, 7), unit(7, 6), unit(6, 5)]
    rest, paired = S.combined(singles, pairs)
    best = lambda i: 0 if i >= 5 else min([singles[i].bound + best(i + 1)] + (
        [pairs[i].bound + best(i + 2)] if i < 4 else []))
    assert rest[:5] == [best(i) for i in range(5)] and paired[1] and not paired[0]
