"""Combo matching against a brute-force Python model on a hand-written fixture."""

from parlance.operators import catalog as C


def py_norm(s):
    return (s or "").strip().lower()


def brute(message, combos):
    hay = " ".join([py_norm(message)])
    if not hay.strip():
        return None
    for c in combos:
        for p in c[1]:
            tok = py_norm(p).replace("_", " ")
            if tok and tok in hay:
                return c[0]
    for c in combos:
        name = " ".join([py_norm(c[0])] + [py_norm(p) for p in c[1]])
        for kws in C.KEYWORD_GROUPS.values():
            if any(k in hay for k in kws) and any(k in name for k in kws):
                return c[0]
    return None


PRODUCTS = [  # id, shop, name, sku, stock, price
    (1, "s1", "Áo Thun Basic", "AT-1", 5, 199000.0), (2, "s1", "ao_so_mi", "", 0, 349000.0),
    (3, "s1", "Hoodie Đen", None, 2, 499000.0), (4, "s1", "Quần Jean", "QJ-4", 1, 399000.0),
    (5, "s2", "blue bolt", "B-5", 3, 10.0), (6, "s2", "bolt", "B-6", 3, 11.0),
]
QUESTIONS = [
    ("q1", "s1", "  GIÁ áo thun basic bao nhiêu?"), ("q2", "s1", "ao so mi con khong"),
    ("q3", "s1", "có áo hoodie không"), ("q4", "s1", "tee shirt price"), ("q5", "s2", "price of the blue bolt"),
    ("q6", "s2", "bolts"), ("q7", "s1", "   "), ("q8", "s3", "giá áo thun"), ("q9", "s1", "quần jean giá"),
]


def test_match_against_brute_force(spark):
    prods = spark.createDataFrame(PRODUCTS, "id long, shop_id string, name string, sku string, "
                                            "stock_quantity int, price double")
    shops = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "id string")
    cands = C.combo_candidates(prods, shops)
    qs = spark.createDataFrame(QUESTIONS, "q_id string, shop_id string, text string")
    got = {r.q_id: (r.name_match.combo_id if r.name_match else None,
                    r.keyword_match.combo_id if r.keyword_match else None, r.price_intent)
           for r in C.match_combos(qs, cands).collect()}
    cand_rows = sorted(cands.collect(), key=lambda r: (r.shop_id, r.rank.seq, r.rank.name, r.rank.id or 0))
    for qid, shop, text in QUESTIONS:
        combos = [(c.combo_id, list(c.products)) for c in cand_rows if c.shop_id == shop]
        name, kw, price = got[qid]
        assert (name or kw) == brute(text, combos), qid
        assert price == any(k in py_norm(text) for k in C.PRICE_KEYWORDS)
    # the shop without products falls back to the demo combos
    demo = [r.combo_id for r in cand_rows if r.shop_id == "s3"]
    assert demo == ["DEMO-01", "DEMO-02", "DEMO-03"]


def test_listing_top_50_by_name_then_id(spark):
    rows = [(i, "s", f"n{i % 7}", None, 1, 1.0) for i in range(120)]
    prods = spark.createDataFrame(rows, "id long, shop_id string, name string, sku string, stock_quantity int, "
                                        "price double")
    got = [(r.name, r.id) for r in C.catalog_listing(prods).orderBy("position").collect()]
    assert got == sorted((f"n{i % 7}", i) for i in range(120))[:50]


def test_selected_lookup_takes_the_first_in_catalog_order(spark):
    prods = spark.createDataFrame([(1, "s", "b", "A", 1, 1.0), (2, "s", "a", "A", 1, 2.0), (3, "s", "c", "B", 1, 3.0)],
                                  "id long, shop_id string, name string, sku string, stock_quantity int, price double")
    sel = spark.createDataFrame([("q1", "s", "A"), ("q2", "s", "Z")], "q_id string, shop_id string, "
                                                                      "selected_combo string")
    got = {r.q_id: (r.sel_rank and r.sel_rank.id, r.sel_price)
           for r in C.selected_combo_lookup(sel, C.combo_candidates(prods)).collect()}
    assert got == {"q1": (2, 2.0), "q2": (None, None)}


def test_matching_searches_beyond_the_listing_limit(spark):
    rows = [(i, "s", f"n{i:04d}", f"sku{i}", 1, 1.0) for i in range(300)]
    prods = spark.createDataFrame(rows, "id long, shop_id string, name string, sku string, stock_quantity int, "
                                        "price double")
    qs = spark.createDataFrame([("q", "s", "giá n0299 bao nhiêu", ["x"]), ("r", "s", "giá", ["cái N0123"])],
                               "q_id string, shop_id string, text string, wants array<string>")
    got = {r.q_id: r.name_match and r.name_match.combo_id
           for r in C.match_combos(qs, C.combo_candidates(prods), extra_cols=("wants",)).collect()}
    assert got == {"q": "sku299", "r": "sku123"}
