"""Texts against names: whole results against brute force, and the work when names are alike."""

import random
from collections import Counter

from pyspark.sql import functions as F

from parlance.operators import matching as M
from parlance.operators import scoring as S


def frames(spark, texts, names):
    return (spark.createDataFrame(texts, "shop_id string, _hay string").repartition(4),
            spark.createDataFrame(names, "shop_id string, token string").repartition(3))


def hits(spark, texts, names):
    return Counter(tuple(r) for r in M.name_hits(*frames(spark, texts, names)).collect())


def brute(texts, names):
    return Counter((s, h, t) for s, h in set(texts) for n, t in set(names) if n == s and t and t in h)


def test_hits_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc é") for _ in range(n))
    names = [(rng.choice("xyz"), word(rng.choice([1, 2, 3, 4, 5, 9]))) for _ in range(150)]
    texts = list({(rng.choice("xyzw"), word(rng.choice([0, 1, 3, 4, 30, 200]))) for _ in range(200)})
    assert hits(spark, texts, names) == brute(texts, names)
    long_only = [(s, t) for s, t in names if len(t) >= 4]
    assert hits(spark, texts, long_only) == brute(texts, long_only)
    assert hits(spark, texts, []) == Counter() == hits(spark, [], names)


def test_names_that_share_a_prefix_are_filed_apart(spark):
    """Work is counted as the rows of the join: texts of the shared prefix must not meet every name."""
    def met(n):
        names = [("s", f"premium cotton shirt no {i:05d} model") for i in range(n)]
        texts = [("s", f"is the premium cotton shirt no {i * 7 % n:05d} model in stock? premium cotton shirt") for i in range(200)]
        h, k = frames(spark, texts, names)
        assert M.name_hits(h, k).count() == 200
        filed = M.signatures(k)
        assert filed.groupBy("gram").count().agg(F.max("count")).first()[0] <= max(2, n // 10)
        grams = h.select(F.explode(M._grams("_hay", M.GRAM)).alias("gram"))
        return grams.join(filed, "gram").count()

    one, four = met(1000), met(4000)
    # every name has a number of its own; a text's pairs grow with the names that share four digits only
    assert one <= 200 * 60 and four <= 4.5 * one


def py_ranking(text, names):
    """Best name by (said, shared words, stock, order) of rows (token, stock, order, combo)."""
    said = set(__import__("re").findall(r"\w+", text))
    scored = [(-(t in text), -len(set(t.split(" ")) & said), -stock, order, combo) for t, stock, order, combo in names
              if stock > 0]
    scored = [x for x in scored if x[0] or x[1]]
    return min(scored)[-1] if scored else None


def test_ranking_equals_brute_force_over_slices_and_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "SLICE_NAMES", 7)
    monkeypatch.setattr(M, "PART_TEXTS", 11)
    rng = random.Random(5)
    vocabulary = ["red", "blue", "shirt", "cap", "wool", "long", "new", "basic"]
    names = sorted({" ".join(["basic", *rng.sample(vocabulary, rng.choice([1, 2, 3]))]) for _ in range(60)})
    rows = [("s", i, n, rng.choice([0, 1, 1, 2]), f"c{i}") for i, n in enumerate(names)]
    candidates = spark.createDataFrame(rows, "shop_id string, seq int, name string, stock int, combo_id string").select(
        "shop_id", F.struct("seq", "name", F.col("seq").cast("long").alias("id")).alias("rank"), "combo_id",
        F.array("name").alias("products"), "stock")
    texts = [" ".join(rng.sample(vocabulary + ["please", "the"], rng.choice([1, 2, 4]))) for _ in range(120)] + ["", "nothing"]
    qs = spark.createDataFrame([(i, "s" if i % 9 else "other", t) for i, t in enumerate(texts)],
                               "q_id long, shop_id string, text string")
    got = {r.q_id: r.best_combo for r in S.combo_ranking(qs, candidates).collect()}
    held = [(n, stock, i, c) for _, i, n, stock, c in rows]
    assert got == {i: py_ranking(t, held) if i % 9 else None for i, t in enumerate(texts)}


def test_a_word_of_every_name_makes_no_pairs(spark):
    names = spark.range(3000).selectExpr("'s' AS shop_id", "concat('basic ', id) AS token", "struct(id) AS best",
                                         "array('basic', string(id)) AS words")
    texts = spark.range(2000).selectExpr("'s' AS shop_id", "concat('a basic text ', id) AS _hay",
                                         "array('a', 'basic', 'text', string(id + 2000)) AS words")
    out = M.best_overlap(texts, names).collect()
    assert len(out) == 2000
    for r in out:
        number = int(r._hay.split()[-1]) + 2000
        assert (r.shared, r.best.id) == ((2, number) if number < 3000 else (1, 0))
