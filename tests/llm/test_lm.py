"""LM scoring: counts and base score against brute force, lattice likelihood by enumeration."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from parlance.llm import lm as M

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return M.lattice(PATH)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def enumerated(model, word, logp):
    """Sum over all segmentations, one by one."""
    p = {piece: math.exp(logp[i]) for i, piece in enumerate(model.pieces)}

    def paths(at):
        if at == len(word):
            return 1.0
        return sum(p[word[at:end]] * paths(end) for end in range(at + 1, len(word) + 1) if word[at:end] in p)

    return math.log(paths(0))


@pytest.mark.parametrize("word", [b"the", b"x", "été".encode(), b"$$$", bytes([0x96, 0xFF]), b"tionth"])
def test_forward_sums_all_segmentations(model, word):
    own = M.marked(word)
    assert abs(model.forward([own], model.first)[0][0] - enumerated(model, own, model.first)) < 1e-9


def test_long_words_and_batches_agree(model):
    rng = random.Random(2)
    own = [M.marked("".join(rng.choice("theaionst") for _ in range(n)).encode()) for n in (1, 5, 30, 60, 61, 62, 63, 64, 90)]
    together = model.forward(own, model.first)[0]
    assert np.allclose(together, [model.forward([w], model.first)[0][0] for w in own])
    wide = M.WIDE
    try:
        M.WIDE = 4
        assert np.allclose(together, model.forward(own, model.first)[0])
    finally:
        M.WIDE = wide


def test_expected_counts_are_the_gradient(model):
    own, weights = [M.marked(b"theat"), M.marked(b"onion")], np.array([2.0, 1.0])
    _, counts = model.forward(own, model.first, weights)
    piece = model.pieces.index(b"on")
    eps = 1e-5
    up, down = model.first.copy(), model.first.copy()
    up[piece] += eps
    down[piece] -= eps
    slope = (model.forward(own, up)[0] - model.forward(own, down)[0]) @ weights / (2 * eps)
    assert abs(slope - counts[piece]) < 1e-4


def rows():
    rng = random.Random(9)
    vocab = ["the", "The", "tion", "of", "etat", "né", "and", "$$"] + [f"w{i}" for i in range(40)]
    out = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 9, 60])))) for i in range(120)]
    return out + [(200, None), (201, "\x1c a\x0bb"), (7, out[7][1]), (None, "the of"), (202, "neverseen" * 20)]


def brute(data, folds):
    counts = Counter()
    for (_, text), out in zip(data, folds):
        if not out:
            counts.update([*words(text), None])
    n, v = sum(counts.values()), len(counts)
    result = []
    for (doc, text), out in zip(data, folds):
        own = [*words(text), None]
        result.append((doc, out, len(own), sum(counts[w] > 0 for w in own), n,
                       sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)))
    return result


def test_counts_and_base_score(spark):
    data = rows()
    folds = [zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0 for i, _ in data]
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in data], "doc_id long, text string, score double").repartition(4)
    out = M.score(docs, PATH, passes=1).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out), key=key)
    for a, b in zip(got, sorted(brute(data, folds), key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-8
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)


def test_word_probabilities_sum_to_at_most_one(spark, model):
    """All one- and two-letter words and the end, as single-word texts, share one."""
    docs = spark.createDataFrame([(i, "a b ab the") for i in range(1, 30)], "doc_id long, text string")
    letters = [chr(c) for c in range(33, 127) if not 65 <= c <= 90]
    probes = [(10_000 + i, w) for i, w in enumerate([*letters, *(a + b for a in letters for b in letters)])]
    folds = [(i, w) for i, w in probes if zlib.crc32(str(i).encode()) % 10 == 0]
    out = M.score(docs.unionByName(spark.createDataFrame(folds + [(2000 + k, None) for k in range(40)
                                                                  if zlib.crc32(str(2000 + k).encode()) % 10 == 0],
                                                         "doc_id long, text string")), PATH)
    score = {r.doc_id: r.score for r in out.collect()}
    end = next(s for i, s in score.items() if i >= 2000 and i < 2040)
    total = sum(10 ** (score[i] - end) for i, _ in folds)
    assert 0 < total < 1 - 10 ** end + 1e-9


def test_small_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(1)
    one = sorted(M.score(docs, PATH, passes=0).collect(), key=str)
    few = M.blocks(docs, "doc_id", "text").count()
    assert few == 1 and len(one) == len(rows())


def test_registered_passes_re_estimate_twice(spark, model):
    """Two forward-backward passes over the distinct training words, one by one."""
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    known = sorted({w for i, t in rows() for w in words(t) if zlib.crc32(str(i if i is not None else "").encode()) % 10})
    logp = model.first
    for _ in range(2):
        counts = sum(model.forward([M.marked(w)], logp, np.ones(1))[1] for w in known) + M.FLOOR
        logp = np.log(counts / counts.sum())
    got = M.train(spark.createDataFrame([(w,) for w in known], "word binary"), PATH)
    assert np.allclose(got, logp)
    key = lambda r: (str(r.doc_id), r.n_tokens, r.base_score)
    default, two, one = ([r.score for r in sorted(M.score(docs, PATH, **k).collect(), key=key)]
                         for k in ({}, {"passes": 2}, {"passes": 1}))
    assert np.allclose(default, two) and not np.allclose(default, one)


def test_nothing_to_learn_from_and_empty_tables(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    docs = spark.createDataFrame([(held, "some words")], "doc_id long, text string")
    r = M.score(docs, PATH).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.score < 0
    assert M.score(docs.limit(0), PATH).count() == 0
