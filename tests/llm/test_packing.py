"""Packing: every id in one piece, sequences gapless and within the limit, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from parlance.llm import packing as K

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def check(docs, rows, limit):
    left = defaultdict(list)
    for r in rows:
        left[r.doc_id].append(r)
    texts = defaultdict(list)
    for i, t in docs:
        texts[i].append(t)
    for i, own in texts.items():
        ids = np.array(LIBRARY.encode(own[0] or "", add_special_tokens=False).ids + [1], "<u4")
        pieces = sorted(left[i], key=lambda r: r.start)
        assert all(r.doc_tokens == len(ids) for r in pieces)
        assert sorted((r.start, r.length) for r in pieces) == sorted(
            c for c in K.cuts(len(ids), limit) for _ in own)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in pieces)
        assert sum(r.length for r in pieces) == len(ids) * len(own)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
    return len(sequences)


def test_pieces_and_sequences(spark):
    rng = random.Random(1)
    docs = [(i, " ".join("word" for _ in range(rng.choice([1, 5, 100, 700, 1500, 2047, 2048, 5000])))) for i in range(300)]
    docs += [(300, None), (301, ""), (5, docs[5][1]), (302, docs[7][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, length string").repartition(5)
    rows = K.pack(df, PATH).collect()
    n = check(docs, rows, K.LIMIT)
    assert sum(r.length for r in rows) / (n * K.LIMIT) > 0.97


def test_plan_holds_exactly_the_counts():
    sizes, rng = K.grid(), np.random.default_rng(2)
    for scale in (0, 1, 30):
        counts = rng.integers(0, 40, len(sizes)) * scale
        held = np.zeros(len(sizes), int)
        for copies, pattern in K.plan(sizes, counts, K.LIMIT):
            assert sum(sizes[t] * a for t, a in pattern.items()) <= K.LIMIT
            for t, a in pattern.items():
                held[t] += copies * a
        assert (held == counts).all()
    bound = (counts * sizes).sum() / K.LIMIT
    assert sum(c for c, _ in K.plan(sizes, counts, K.LIMIT)) <= 1.01 * bound + 2


def test_knapsack_is_optimal():
    sizes, values = np.array([3, 5, 7]), np.array([0.3, 0.6, 0.75])
    best, _ = K.knapsack(sizes, values, 20)
    for c in range(21):
        assert abs(best[c] - max(0.3 * a + 0.6 * b + 0.75 * d for a in range(8) for b in range(5) for d in range(4)
                                 if 3 * a + 5 * b + 7 * d <= c)) < 1e-9


def test_grid_holds_every_cut():
    sizes = set(K.grid().tolist())
    assert all(n in sizes for total in range(1, 5000) for _, n in K.cuts(total))


def test_empty_table(spark):
    assert K.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
