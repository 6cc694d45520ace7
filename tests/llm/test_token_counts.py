"""Token counts against the tokenizers library, and reuse of the digest cache."""

import tempfile

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parlance.llm import token_counts as C
from parlance.llm.words import word_ids

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def n(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30), max_size=5))
def test_words_give_the_ids_of_the_whole_text(texts):
    assert word_ids(PATH).counts(texts) == [n(t) for t in texts]


@pytest.mark.parametrize("text", ["a<|endoftext|>b <|startoftext|>", "Don't STOP", "x" * 5000, "é é ́x",
                                  "a b c\x1cd", "ΑΣ Σ ΑΣ", "12 34.5%", " \t\n "])
def test_single_texts(text):
    assert word_ids(PATH).counts([text]) == [n(text)]


def test_counts_cache_and_versions(spark):
    folder = tempfile.mkdtemp(prefix="counts-") + "/cache"
    rows = [(1, "one two  three", "a"), (2, "one two three", "b"), (2, "one two three", "b"), (3, None, None),
            (None, "w " * 2049, "c"), (None, None, "d"), (7, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    want = sorted((str(i), len((t or "").encode()), n(t), n(t) > 2048) for i, t, _ in rows)
    for _ in range(2):
        out = C.count_tokens(docs, PATH, folder).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in out) == want
    # copies, white space and null share their entries, and the second run added none
    assert spark.read.parquet(folder).count() == 3
    tokenizer = C.file_digest(PATH)
    assert C.read_cache(spark, folder, tokenizer).count() == 3
    assert C.read_cache(spark, folder, "another version").count() == 0
    # a stored count is used without encoding
    more = docs.limit(0).unionByName(spark.createDataFrame([(9, "four", "")], docs.schema))
    more.select(C.content_digest(more["text"]).alias("digest")).selectExpr(
        "digest", f"'{tokenizer}' as tokenizer", "77L as n_tokens").write.mode("append").parquet(folder)
    assert C.count_tokens(more, PATH, folder).first().n_tokens == 77


def test_empty_table(spark):
    folder = tempfile.mkdtemp(prefix="counts-") + "/cache"
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert C.count_tokens(docs, PATH, folder).count() == 0
