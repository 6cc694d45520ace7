"""Catalog queries: listing (#10), candidates (#11), lookup and matching (#21-#24), price intent (#51)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import catalog as C
from parlance.plans.registry import register
from parlance.sources import bindings as B

_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _norm_sql(x: str) -> str:
    return "lower(" + _STRIP.format(x=f"coalesce({x}, '')") + ")"


def _contains_any_sql(x: str, kws) -> str:
    return "(" + " OR ".join(f"instr({x}, '{k}') > 0" for k in kws) + ")"


_LISTING_SQL = B.with_ctes("products", "shops") + f""",
listing AS (
  SELECT shop_id, CAST(row_number() OVER (PARTITION BY shop_id ORDER BY name, id) AS INTEGER) AS position,
         id, name, sku, CAST(price AS DOUBLE) AS price, stock_quantity
  FROM products QUALIFY position <= {C.LISTING_LIMIT}),
cands AS (
  SELECT shop_id, row_number() OVER (PARTITION BY shop_id ORDER BY name, id) AS position, id, coalesce(nullif(sku, ''), CAST(id AS VARCHAR)) AS combo_id, name,
         CAST(stock_quantity AS INTEGER) AS stock, CAST(price AS DOUBLE) AS price,
         replace({_norm_sql('name')}, '_', ' ') AS token,
         {_norm_sql("coalesce(nullif(sku, ''), CAST(id AS VARCHAR))")} || ' ' || {_norm_sql('name')} AS combo_name
  FROM products),
q AS (
  SELECT q_id, shop_id, part_id, text, {_norm_sql('text')} AS hay FROM product_questions)
"""
_LISTING_SQL = _LISTING_SQL.replace("WITH ", "WITH " + B.SQL["product_questions"] + ",\n", 1)


def _listing(spark, d):
    return C.catalog_listing(B.products(spark, d))


def _candidates(spark, d):
    return C.combo_candidates(B.products(spark, d))


@register("catalog_listing", _LISTING_SQL + "SELECT * FROM listing")
def catalog_listing(spark, d):
    return _listing(spark, d)


_DEMO_SQL = ", ".join(f"('{c}', '[\"{n}\"]', {s}, {p})" for c, n, s, p in C.DEMO_COMBOS)


@register("combo_candidates", _LISTING_SQL + f"""
SELECT shop_id, combo_id, CAST(to_json([name]) AS VARCHAR) AS products, stock, price, false AS is_demo FROM cands
UNION ALL SELECT n.n_name, d.combo_id, d.products, CAST(d.stock AS INTEGER), CAST(d.price AS DOUBLE), true
FROM nation n, (VALUES {_DEMO_SQL}) d(combo_id, products, stock, price)""")
def combo_candidates(spark, d):
    """The catalog's shops, and the nations as shops that have no product yet."""
    from parlance.sources.tables import read_table

    shops = B.shops(spark, d).select("id").union(read_table(spark, d, "nation", "n_name"))
    return C.combo_candidates(B.products(spark, d), shops).withColumn("products", F.to_json("products")).drop("rank")


#: Keyword groups of the queries: the fixed ones, and two whose words occur in the driver data.
GROUPS = C.KEYWORD_GROUPS | {"widgets": ["promo", "widget"], "bolts": ["economy", "bolt"]}


def _matched(spark, d):
    return C.match_combos(B.product_questions(spark, d), _candidates(spark, d), keyword_groups=GROUPS)


_NAME_SQL = """
name_hits AS (
  SELECT q.q_id, arg_min(c.combo_id, c.position) AS name_combo
  FROM q JOIN cands c ON q.shop_id = c.shop_id AND length(c.token) > 0 AND instr(q.hay, c.token) > 0
  WHERE length(""" + _STRIP.format(x="q.hay") + """) > 0
  GROUP BY q.q_id)"""



def _kw_sql():
    conds = " OR ".join(
        f"({_contains_any_sql('q.hay', kws)} AND {_contains_any_sql('c.combo_name', kws)})"
        for kws in GROUPS.values())
    return f"""
kw_hits AS (
  SELECT q.q_id, arg_min(c.combo_id, c.position) AS keyword_combo
  FROM q JOIN cands c ON q.shop_id = c.shop_id AND ({conds})
  WHERE length({_STRIP.format(x='q.hay')}) > 0
  GROUP BY q.q_id)"""


@register("combo_name_match", _LISTING_SQL + "," + _NAME_SQL + """
SELECT q.q_id, n.name_combo FROM q LEFT JOIN name_hits n ON q.q_id = n.q_id""")
def combo_name_match(spark, d):
    return _matched(spark, d).select("q_id", F.col("name_match.combo_id").alias("name_combo"))


@register("combo_keyword_match", _LISTING_SQL + "," + _NAME_SQL + "," + _kw_sql() + """
SELECT q.q_id, CASE WHEN n.name_combo IS NULL THEN k.keyword_combo END AS keyword_combo
FROM q LEFT JOIN name_hits n ON q.q_id = n.q_id LEFT JOIN kw_hits k ON q.q_id = k.q_id""")
def combo_keyword_match(spark, d):
    return _matched(spark, d).select("q_id", F.col("keyword_match.combo_id").alias("keyword_combo"))


def with_requirements(spark, d):
    """Questions with requirement lists: what was asked for, of every third part its name, and what
    follows from it, of every fifth part a remark; null for every seventh."""
    names = B.products(spark, d).select(F.col("id").alias("part_id"), F.col("name").alias("_name"))
    part, none = F.col("part_id"), F.array().cast("array<string>")
    explicit = F.when(part % 7 == 0, F.lit(None).cast("array<string>")).when(
        part % 3 == 0, F.array(F.concat(F.lit(" Cần "), "_name"), F.lit("loại tốt"))).otherwise(none)
    implicit = F.when(part % 5 == 0, F.array(F.lit("widget "))).otherwise(none)
    return (B.product_questions(spark, d).join(names, "part_id").withColumn("explicit_requirements", explicit)
            .withColumn("implicit_requirements", implicit).drop("_name"))


_REQ_SQL = f"""
rq AS (
  SELECT q.q_id, q.shop_id, array_to_string(list_concat([{_norm_sql('q.text')}], list_transform(list_concat(
      CASE WHEN q.part_id % 7 = 0 THEN [] WHEN q.part_id % 3 = 0 THEN [' Cần ' || p.name, 'loại tốt'] ELSE [] END,
      CASE WHEN q.part_id % 5 = 0 THEN ['widget '] ELSE [] END), lambda x: {_norm_sql('x')})), ' ') AS hay
  FROM product_questions q JOIN products p ON p.id = q.part_id)"""


@register("combo_match_requirements", _LISTING_SQL + "," + _REQ_SQL + "," + _NAME_SQL.replace("FROM q ", "FROM rq q ") + ","
          + _kw_sql().replace("FROM q ", "FROM rq q ") + """
SELECT rq.q_id, n.name_combo, CASE WHEN n.name_combo IS NULL THEN k.keyword_combo END AS keyword_combo
FROM rq LEFT JOIN name_hits n ON rq.q_id = n.q_id LEFT JOIN kw_hits k ON rq.q_id = k.q_id""")
def combo_match_requirements(spark, d):
    """#22 / #23 with the requirement texts as part of the message."""
    out = C.match_combos(with_requirements(spark, d), _candidates(spark, d), keyword_groups=GROUPS,
                         extra_cols=("explicit_requirements", "implicit_requirements"))
    return out.select("q_id", F.col("name_match.combo_id").alias("name_combo"),
                      F.col("keyword_match.combo_id").alias("keyword_combo"))


@register("price_intent", _LISTING_SQL + f"""
SELECT q_id, {_contains_any_sql('hay', C.PRICE_KEYWORDS)} AS price_intent FROM q""")
def price_intent(spark, d):
    q = B.product_questions(spark, d)
    return q.select("q_id", C.price_intent(F.col("text")).alias("price_intent"))


def _selections(spark, d):
    """Each question 'selects' the combo id of its own part ."""
    q = B.product_questions(spark, d)
    sel = F.when(F.col("part_id") % 7 == 0, F.col("part_id").cast("string")) \
           .when(F.col("part_id") % 11 == 0, F.col("part_id").cast("string")) \
           .otherwise(F.concat(F.col("shop_id"), F.lit("-"), F.col("part_id").cast("string")))
    return q.withColumn("selected_combo", sel)


_SEL_SQL = """
sel AS (
  SELECT q.*, CASE WHEN part_id % 7 = 0 THEN CAST(part_id AS VARCHAR) WHEN part_id % 11 = 0 THEN CAST(part_id AS VARCHAR)
                   ELSE shop_id || '-' || CAST(part_id AS VARCHAR) END AS selected_combo FROM q),
firsts AS (
  SELECT shop_id, combo_id, arg_min(id, position) AS sel_product, arg_min(price, position) AS sel_price
  FROM cands GROUP BY shop_id, combo_id),
looked AS (
  SELECT s.q_id, s.hay, s.selected_combo, f.sel_product, f.sel_price
  FROM sel s LEFT JOIN firsts f ON s.shop_id = f.shop_id AND s.selected_combo = f.combo_id)"""


@register("selected_combo_lookup", _LISTING_SQL + "," + _SEL_SQL +
          "\nSELECT q_id, selected_combo, sel_product, sel_price FROM looked")
def selected_combo_lookup(spark, d):
    return (C.selected_combo_lookup(_selections(spark, d), _candidates(spark, d))
            .select("q_id", "selected_combo", F.col("sel_rank.id").alias("sel_product"), "sel_price"))


@register("fallback_combo", _LISTING_SQL + "," + _NAME_SQL + "," + _kw_sql() + "," + _SEL_SQL + f"""
SELECT l.q_id, {_contains_any_sql('l.hay', C.PRICE_KEYWORDS)} AS price_intent,
       CASE WHEN l.sel_product IS NOT NULL THEN l.selected_combo
            WHEN {_contains_any_sql('l.hay', C.PRICE_KEYWORDS)} THEN coalesce(n.name_combo, k.keyword_combo) END
         AS final_combo
FROM looked l LEFT JOIN name_hits n ON l.q_id = n.q_id
     LEFT JOIN kw_hits k ON l.q_id = k.q_id""")
def fallback_combo(spark, d):
    cands = _candidates(spark, d)
    looked = C.selected_combo_lookup(_selections(spark, d), cands)
    matched = C.match_combos(looked, cands, keyword_groups=GROUPS)
    return C.fallback_combo(matched).select("q_id", "price_intent", "final_combo")
