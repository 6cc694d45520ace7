"""Catalog listing, combo candidates and text-to-combo matching (#10, #11, #21-#24, #51).

Matching plan.  The whole catalog is searched; only the listing (#10) has a limit.  A
candidate's place in the catalog is its ``rank`` struct (name, then id), so "first in
catalog order" is a ``min`` and no shop is sorted in one task.  Names are reduced to one
row per shop and spelling and meet the distinct texts by their rarest gram (``matching.py``).
There is no nested-loop join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import contains_any, has_text, normalize, normalize_name
from parlance.operators.matching import name_hits
from parlance.session import stored

LISTING_LIMIT = 50

# Price-intent keywords, matched on the normalised message.
PRICE_KEYWORDS = ["giá", "bao nhiêu", "price", "cost", "tiền"]

# Keyword groups for the second matching pass (group -> spellings).
KEYWORD_GROUPS = {
    "hoodie": ["hoodie", "áo hoodie", "ao hoodie"],
    "ao thun": ["áo thun", "ao thun", "t-shirt", "tee"],
    "ao so mi": ["áo sơ mi", "ao so mi", "sơ mi", "so mi"],
}

# Demo combos used when a shop has no products (priced variant).
DEMO_COMBOS = [
    ("DEMO-01", "ao_thun_basic", 10, 199000.0),
    ("DEMO-02", "ao_so_mi", 5, 349000.0),
    ("DEMO-03", "ao_hoodie", 12, 499000.0),
]


def catalog_listing(products: DataFrame, limit: int = LISTING_LIMIT) -> DataFrame:
    """#10: per shop, the first ``limit`` products by name, ties by id.

    ``row_number() <= limit`` plans as WindowGroupLimit: each map task keeps only
    its local top ``limit`` per shop before the shuffle, so a hot shop ships at
    most ``limit`` rows per input partition.
    """
    w = Window.partitionBy("shop_id").orderBy(F.col("name"), F.col("id"))
    return (products.withColumn("position", F.row_number().over(w))
            .where(F.col("position") <= limit)
            .select("shop_id", "position", "id", "name", "sku",
                    F.col("price").cast("double").alias("price"), F.col("stock_quantity")))


def combo_candidates(products: DataFrame, shops: DataFrame | None = None) -> DataFrame:
    """#11: product -> single-product combo; shops without products get the demo combos."""
    def rank(seq, name, pid):
        return F.struct(seq.cast("int").alias("seq"), name.alias("name"), pid.cast("long").alias("id")).alias("rank")

    combos = products.select(
        "shop_id", rank(F.lit(0), F.col("name"), F.col("id")),
        F.coalesce(F.nullif(F.col("sku"), F.lit("")), F.col("id").cast("string")).alias("combo_id"),
        F.array(F.col("name")).alias("products"),
        F.col("stock_quantity").cast("int").alias("stock"),
        F.col("price").cast("double").alias("price"),
        F.lit(False).alias("is_demo"))
    if shops is None:
        return combos
    demo = F.array(*[F.struct(rank(F.lit(i + 1), F.lit(n), F.lit(None)), F.lit(c).alias("combo_id"),
                              F.array(F.lit(n)).alias("products"), F.lit(s).cast("int").alias("stock"),
                              F.lit(p).alias("price")) for i, (c, n, s, p) in enumerate(DEMO_COMBOS)])
    empty = shops.select(F.col("id").alias("shop_id")).join(products.select("shop_id"), "shop_id", "left_anti")
    return combos.unionByName(empty.select("shop_id", F.inline(demo)).withColumn("is_demo", F.lit(True)))


def with_texts(questions: DataFrame, text_col: str, extra_cols: tuple) -> DataFrame:
    """``questions`` with the normalised text as ``_said``, and with the requirement texts as ``_hay``."""
    questions, pieces = questions.withColumn("_said", normalize(F.col(text_col))), F.array("_said")
    for c in extra_cols:
        pieces = F.concat(pieces, F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), normalize))
    return questions.withColumn("_hay", F.array_join(pieces, " "))


def _names(candidates: DataFrame) -> DataFrame:
    """Candidates with the spelling that is looked for in texts."""
    return candidates.withColumn("token", normalize_name(F.col("products")[0])).where(F.length("token") > 0)


def match_combos(questions: DataFrame, candidates: DataFrame, text_col: str = "text",
                 extra_cols: tuple = (), keyword_groups: dict = KEYWORD_GROUPS) -> DataFrame:
    """#22 / #23 / #51: name match, keyword-group match and price intent per question.

    ``questions`` has ``shop_id`` and a text column; ``extra_cols`` are further
    requirement texts (explicit / implicit lists) appended to the haystack.  Questions that are
    written may carry ``with_texts`` already.
    """
    groups = list(keyword_groups.values())
    q = questions if "_hay" in questions.columns else with_texts(questions, text_col, extra_cols)
    # what distinct texts find is written: the questions then meet tables of known size,
    # and are not shuffled where those are small
    hays = stored(q.where(has_text("_hay")).select("shop_id", "_hay").distinct(), "asked-texts")
    names = _names(candidates)
    first = F.struct("rank", "combo_id")
    firsts = names.groupBy("shop_id", "token").agg(F.min(first).alias("first"))
    by_name = stored(name_hits(hays, names).join(firsts, ["shop_id", "token"]).groupBy("shop_id", "_hay").agg(
        F.min("first").alias("name_match")), "name-matches")
    spelled = candidates.withColumn("spelled", F.concat_ws(" ", normalize(F.col("combo_id")),
                                                           F.array_join(F.transform("products", normalize), " ")))
    by_group = stored(spelled.groupBy("shop_id").agg(
        *[F.min(F.when(contains_any(F.col("spelled"), kws), first)).alias(f"kw_{i}") for i, kws in enumerate(groups)]),
        "group-matches")
    kw_hits = [F.when(contains_any(F.col("_hay"), kws), F.col(f"kw_{i}")) for i, kws in enumerate(groups)]
    kw_hit = F.least(*kw_hits) if len(kw_hits) > 1 else kw_hits[0]
    found = (hays.join(by_name, ["shop_id", "_hay"], "left").join(by_group, "shop_id", "left")
             .withColumn("keyword_match", F.when(F.col("name_match").isNull(), kw_hit))
             .where(F.col("name_match").isNotNull() | F.col("keyword_match").isNotNull())
             .select("shop_id", "_hay", "name_match", "keyword_match"))
    return (q.join(stored(found, "text-matches"), ["shop_id", "_hay"], "left")
            .withColumn("price_intent", contains_any("_said", PRICE_KEYWORDS)).drop("_hay", "_said"))


def price_intent(text: Column) -> Column:
    """#51: whether a message asks for a price."""
    return contains_any(normalize(text), PRICE_KEYWORDS)


def selected_combo_lookup(selections: DataFrame, candidates: DataFrame) -> DataFrame:
    """#21: first candidate in catalog order whose combo_id equals the selected id, else null."""
    firsts = (candidates.groupBy("shop_id", F.col("combo_id").alias("selected_combo"))
              .agg(F.min(F.struct("rank", "price")).alias("_first"))
              .select("shop_id", "selected_combo", F.col("_first.rank").alias("sel_rank"),
                      F.col("_first.price").alias("sel_price")))
    return selections.join(firsts, ["shop_id", "selected_combo"], "left")


def fallback_combo(matched: DataFrame) -> DataFrame:
    """#24: the looked-up selection, else (price intent only) name match, else keyword match."""
    heur = F.coalesce(F.col("name_match.combo_id"), F.col("keyword_match.combo_id"))
    return matched.withColumn(
        "final_combo",
        F.when(F.col("sel_rank").isNotNull(), F.col("selected_combo"))
         .when(F.col("price_intent"), heur))
