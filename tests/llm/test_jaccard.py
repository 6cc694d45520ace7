"""N-gram Jaccard join against brute force over all pairs."""

import random
import re

import pytest

from parlance.llm import jaccard as J
from parlance.llm.common import documents

from conftest import SF_SMALL


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets}


def check(spark, rows, parts=6):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string").repartition(parts)
    out = J.linked_components(docs).collect()
    assert len(out) == len(rows)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id is not None}
    assert got == brute(rows)
    assert all(r.component_id is None for r in out if r.doc_id is None)
    return out


def families(seed, families=8, copies=14, passage=True):
    """Near copies with growing edits (so links and near misses), short texts, shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(55)]
    rows, i = [], 0
    for _ in range(families):
        base = [word() for _ in range(rng.choice([6, 12, 40, 120, 400]))]
        for c in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                own[rng.randrange(len(own))] = word()
            if c % 4 == 1:
                own = own[:max(1, int(len(own) * rng.uniform(0.6, 1)))]
            if c % 5 == 2:
                own += [word() for _ in range(int(len(own) * rng.uniform(0, 0.3)))]
            if passage and c % 3 == 0:
                own += common
            text = " ".join(own)
            rows.append((i * 7 % 10_007, text.upper() if c % 6 == 5 else text.replace(" ", "\t", 1)))
            i += 1
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_families_of_near_copies(spark, seed):
    check(spark, families(seed))


def test_one_large_group_and_a_common_passage(spark):
    rows = families(11, families=1, copies=260)
    rows += [(20_000 + i, f"only{i} " * 3 + " ".join(f"p{k}" for k in range(60))) for i in range(120)]
    rows += [(30_000 + i, rows[0][1]) for i in range(200)]
    check(spark, rows)


def test_chain_of_links(spark):
    words = [f"w{i}" for i in range(160)]
    rows = [(500 - k, " ".join(words[k * 4:k * 4 + 60])) for k in range(25)]
    out = check(spark, rows)
    assert len({r.component_id for r in out}) == 1


def test_documents_of_the_driver(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF_SMALL, "doc_id", "text").collect()]
    check(spark, rows)


def test_nulls_repeats_and_short_texts(spark):
    check(spark, [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a"), (6, "a"), (7, "b c d e f"),
                  (8, "b c d e f"), (None, "a b"), (None, None)])
    assert J.linked_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_document_of_each_component_stays(spark):
    rows = families(5)
    docs = spark.createDataFrame(rows + [(None, "z")], "doc_id long, text string")
    stay = {r.doc_id for r in J.drop_near_copies(docs).collect()}
    assert stay == {c for _, _, c in brute(rows)} | {None}


def test_prefix_arithmetic(spark):
    sizes = spark.createDataFrame([(n,) for n in range(1, 3000)], "n int")
    got = sizes.select("n", J._least_overlap(sizes["n"]).alias("a"), J._demand(sizes["n"]).alias("d")).collect()
    for r in got:
        assert r.a == J.least_overlap(r.n) and r.d == J.matches(J.least_overlap(r.n))
        assert 1 <= J.matches(r.n) <= J.prefix(r.n) <= r.n


def near_misses(count, words=300, edits=6, seed=1):
    """Documents that each differ from one text in places of their own: hardly any two link."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for i in range(count):
        own = list(base)
        for at in rng.sample(range(words), edits):
            own[at] = f"x{i}-{at}"
        rows.append((i, " ".join(own)))
    return rows


def test_a_large_group_of_near_misses(spark):
    check(spark, near_misses(220) + [(1000 + i, t) for i, t in near_misses(60, edits=3, seed=2)])


def test_rows_between_stages_grow_with_the_documents(spark, monkeypatch):
    """Every table that the join writes, for groups of 300, 600 and 1200 near misses."""
    held = {}
    keep = J.stored

    def counted(df, label):
        out = keep(df, label)
        held[label] = max(held.get(label, 0), out.count())
        return out

    monkeypatch.setattr(J, "stored", counted)
    grown = []
    for count in (300, 600, 1200):
        held.clear()
        rows = near_misses(count)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        out = {r.doc_id: r.component_id for r in J.linked_components(docs).collect()}
        grown.append({**held, "rows": len(out)})
        if count == 300:
            assert {(i, c) for i, c in out.items()} == {(i, c) for i, _, c in brute(rows)}
    for label in set(grown[0]) & set(grown[2]):
        assert grown[2][label] <= 4.6 * max(grown[0][label], 300), (label, grown)


def test_blocks_smaller_than_a_group_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_DOCS", 7)
    monkeypatch.setattr(J, "COLUMNS", 13)
    check(spark, families(3, families=3, copies=40) + [(50_000 + i, t) for i, t in near_misses(60, words=90, edits=2)])


def test_overlaps_of_sets():
    import numpy as np
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(30)]
    got = J.overlaps(sets[:12], sets[12:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[12:]] for a in sets[:12]]
    assert J.overlaps([], sets).shape == (0, 30) and J.overlaps(sets[:2], [np.zeros(0, np.uint64)]).tolist() == [[0], [0]]
