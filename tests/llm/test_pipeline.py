"""The corpus pipeline against a brute-force version, stage by stage, and on edge rows."""

import re
from collections import defaultdict

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from parlance.llm import langid, packing, quality
from parlance.llm.common import documents, stored

from conftest import SF_SMALL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = documents(spark, SF_SMALL), {}
    out["documents"] = docs
    for name, stage in C.STAGES:
        docs = stored(stage(spark, docs, SF_SMALL), "test-pipeline")
        out[name] = docs
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stage_names_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["quality_rules", "language_id", "exact_dedup", "ngram_jaccard", "packing"]
    for name, _ in C.STAGES[:-1]:
        assert stages[name].columns == COLUMNS
    assert C.ORACLE_SQL is None


def test_filters_keep_what_their_operators_keep(stages):
    kept = {r.doc_id for r in quality.verdicts(stages["documents"]).collect() if r.kept}
    assert set(rows(stages["quality_rules"])) == kept
    labels = {r.doc_id: r for r in langid.identify(stages["quality_rules"]).collect()}
    assert set(rows(stages["language_id"])) == {
        i for i, r in labels.items() if r.lang_pred != "und" and r.score >= 0.5}


def test_copies_go_by_brute_force(stages):
    groups = defaultdict(list)
    for i, r in rows(stages["language_id"]).items():
        groups[r.text].append(i)
    assert set(rows(stages["exact_dedup"])) == {max(g) for g in groups.values()}
    left = rows(stages["exact_dedup"])
    root = {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {i: shingles(r.text) for i, r in left.items()}
    for i in left:
        for j in left:
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert set(rows(stages["ngram_jaccard"])) == {find(i) for i in left}


def test_packing_holds_every_id(stages):
    library = Tokenizer.from_file(P.path(C.WORD_TOKENIZER))
    want = []
    for i, r in rows(stages["ngram_jaccard"]).items():
        total = len(library.encode(r.text, add_special_tokens=False).ids) + 1
        want += [(i, a, n) for a, n in packing.cuts(total)]
    assert sorted((r.doc_id, r.start, r.length) for r in stages["packing"].collect()) == sorted(want)


def test_edge_rows_and_extra_columns(spark):
    text = " ".join(f"the thing{c} and other{c} word" for c in "abcdefghijklmnopqrst")
    data = [(1, text, "en", "s", 1, "k"), (2, text, "en", "s", 1, None), (2, text, "en", "s", 1, None),
            (None, text + " more", None, None, None, "z"), (3, None, "en", None, None, None), (4, "", None, "s", 0, "q")]
    docs = spark.createDataFrame(data * 1, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, stage in C.STAGES:
        docs = stored(stage(spark, docs, SF_SMALL), "test-edge")
    assert docs.count() > 0


def test_empty_table(spark):
    docs = documents(spark, SF_SMALL).limit(0)
    for name, stage in C.STAGES:
        docs = stored(stage(spark, docs, SF_SMALL), "test-empty")
        assert docs.count() == 0


def test_language_stage_without_labels_keeps_texts_with_letters(spark):
    """No row teaches a language, so no row can be judged."""
    data = [(1, "words without a label"), (2, "文字"), (3, "123 ... !!"), (4, None), (5, ""), (None, "no id")]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in data],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(C.STAGES)["language_id"](spark, docs, SF_SMALL)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text) for r in out.collect()} == {data[0], data[1], data[5]}
