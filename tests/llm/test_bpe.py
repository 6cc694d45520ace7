"""Byte-level BPE against the tiktoken library, and its exact round trip."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from parlance.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    return ["", " ", "  a  b ", "\n\n x\ty\r\n", "don't we'll I'M", "aaaaaaaaaa", "ababababab" * 9, "été über ñandú",
            "日本語のテキスト", "👩‍👩‍👧 ok", "a\x1c b", "a  b c", "x" * 300, "ab" * 400,
            "".join(rng.choice("etaoinshr") for _ in range(6000)),
            "<|endoftext|> special", "é combining", "1234567 8.9", "tail ", "\x00\x01"]


def test_encode_equals_the_library(library):
    enc = bpe.encoder(PATH, P.PATTERN)
    for text, ids in zip(texts(), enc.encode_texts(texts())):
        assert ids == library.encode_ordinary(text), text[:40]
        assert enc.decode(ids).decode() == text


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(many=st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), max_size=6))
def test_encode_equals_the_library_on_any_text(library, many):
    assert bpe.encoder(PATH, P.PATTERN).encode_texts(many) == [library.encode_ordinary(t) for t in many]


def test_long_rows_merge_as_short_ones():
    enc = bpe.encoder(PATH, P.PATTERN)
    rng = random.Random(3)
    for n in (2, 3, 7, 40, 250):
        piece = "".join(rng.choice("aab e") for _ in range(n)).encode()
        ids = enc.byte_id[np.frombuffer(piece, np.uint8)]
        matrix = bpe.merge_matrix(ids[None, :].copy(), enc.pairs)[0]
        assert bpe.merge_long(ids, enc.pairs).tolist() == matrix[matrix >= 0].tolist()


def test_rows_nulls_repeats_and_other_columns(spark, library):
    rows = [(1, "some text", "x"), (1, "some text", "y"), (None, "b", None), (3, None, "z"), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.encode_digests(docs, PATH, P.PATTERN).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(i), len(e := library.encode_ordinary(t or "")), sha(" ".join(map(str, e)).encode()),
                   sha((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == want
    ids = bpe.encode(docs, PATH, P.PATTERN)
    assert sorted(bytes(r["data"]) for r in bpe.decode(ids, PATH, P.PATTERN).collect()) == sorted(
        (t or "").encode() for _, t, _ in rows)
    assert bpe.encode_digests(docs.limit(0), PATH, P.PATTERN).count() == 0
