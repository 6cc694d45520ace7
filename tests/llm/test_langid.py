"""Language ID: held-out accuracy, mixed texts, scripts, edge rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import langid as L
from parlance.llm.common import documents

from conftest import SF_CHECK

LATIN = {"en": ["the", "and", "with", "thing", "other", "would"], "de": ["und", "nicht", "schule", "über", "heit", "auch"]}
GREEK = ["και", "είναι", "λόγος", "θέλω"]


def corpus():
    rng = random.Random(4)
    out, i = [], 0
    for lang, words in [*LATIN.items(), ("el", GREEK)]:
        for _ in range(60):
            out.append((i, " ".join(rng.choice(words) for _ in range(30)), lang))
            i += 1
    return out


@pytest.fixture(scope="module")
def model(spark):
    return L.train(spark.createDataFrame(corpus(), "doc long, text string, lang string"))


def test_held_out_accuracy_on_documents(spark):
    docs = documents(spark, SF_CHECK, "doc_id", "text", "lang")
    out = {r.doc_id: r for r in L.identify(docs).collect()}
    known = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in out if out[i].held_out]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in out)
    assert sum(out[i].lang_pred == known[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values())


def test_mixed_text_is_labelled_in_spans(model):
    text = " ".join(LATIN["en"] * 4 + LATIN["de"] * 6)
    preds, scores, spans = L.Labeller(model).label([text])
    assert preds == ["de"] and abs(scores[0] - 0.6) < 0.05
    assert [(s["lang"], s["n_words"]) for s in spans[0]] == [("en", 24), ("de", 36)]


def test_scripts_narrow_the_candidates(model):
    words = ["θ", "üx", "漢字", "я", "𠀀", "ア", "한"]
    assert [L.SCRIPTS[i] for i in L.Grams(words).scripts] == ["Greek", "Latin", "Han", "Cyrillic", "Han", "Kana", "Hangul"]
    preds, _, _ = L.Labeller(model).label(["αβγδ θθθ", "ψυχή"])
    assert preds == ["el", "el"]


def test_rows_without_letters_and_nulls(spark, model):
    rows = [(1, None, "en"), (2, "", None), (3, "123 ... !!", "de"), (None, "the and with", "x"), (5, "the and", None),
            (5, "the and", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = L.label(df, model).collect()
    assert [(r.doc_id, r.lang_pred) for r in sorted(out, key=lambda r: (r.doc_id is None, r.doc_id or 0))] == [
        (1, "und"), (2, "und"), (3, "und"), (5, "en"), (5, "en"), (None, "en")]
    assert all(r.score == 0 for r in out if r.lang_pred == "und")


def test_nothing_to_learn_from_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.identify(rows).collect()] == ["und"]
    assert L.identify(rows.limit(0)).count() == 0
    assert L.language_filter(rows).count() == 0


def test_labels_and_ids_are_no_inputs(spark, model):
    a = spark.createDataFrame([(1, "nicht schule the", "en")], "doc_id long, text string, lang string")
    b = spark.createDataFrame([(9, "nicht schule the", "de")], "doc_id long, text string, lang string")
    one, two = L.label(a, model).first(), L.label(b, model).first()
    assert (one.lang_pred, one.score, one.spans) == (two.lang_pred, two.score, two.spans)


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 0, 5, 1])
    scores = rng.normal(0, 5, (sizes.sum(), 2)).astype(np.float32)
    labels, at = L.viterbi(scores, sizes, 4.0), 0
    for n in sizes:
        own = scores[at:at + n]
        paths = [[(m >> i) & 1 for i in range(n)] for m in range(1 << n)]
        value = lambda p: sum(own[i, x] for i, x in enumerate(p)) - 4.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert abs(value(labels[at:at + n].tolist()) - max(map(value, paths))) < 1e-4
        at += n


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    words = ["a", "the", "über", "thethe", "漢", "x" * 500]
    together, at = L.Grams(words), [0, 0, 0]
    for i, word in enumerate(words):
        alone = L.Grams([word])
        for k, ((all_of, sizes), (own, n)) in enumerate(zip(together.kinds(), alone.kinds())):
            assert sizes[i] == n[0] == len(own)
            assert (all_of[at[k]:at[k] + n[0]] == own).all()
            at[k] += n[0]


def test_the_sample_is_the_least_hashed_ids_of_each_language(spark, monkeypatch):
    """One language holds most rows; ranges of few and of many bits give the same sample."""
    rows = [(i, "big" if i % 10 else f"l{i % 3}", f"text {i}") for i in range(4000)]
    docs = spark.createDataFrame(rows + [(None, "big", "no id"), (5000, None, "x"), (5001, "big", None)],
                                 "doc long, lang string, text string").repartition(6)
    keyed = [(r.lang, r.key, r.text) for r in docs.select(
        "lang", "text", F.xxhash64("doc").alias("key"), L._fold(F.col("doc")).alias("fold")).where(
        f"fold <> {L.HELD_OUT} and lang is not null and text is not null").collect()]
    want = sorted((lang, t) for lang in {x[0] for x in keyed}
                  for _, _, t in sorted((x for x in keyed if x[0] == lang), key=lambda x: x[1])[:50])
    for bits in (2, 8, 16):
        monkeypatch.setattr(L, "RANGE_BITS", bits)
        assert sorted(map(tuple, L.sample(docs, per_lang=50).collect())) == want


def test_too_many_languages_are_refused(spark):
    docs = spark.createDataFrame([(i, f"l{i}", "a text") for i in range(40)], "doc long, lang string, text string")
    with pytest.raises(ValueError, match="more than 5 languages"):
        L.sample(docs, langs=5)
    assert L.sample(docs, langs=40).select("lang").distinct().count() == sum(
        1 for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2)
