"""The complete turn record (#57): routing, memory, requirements, stage, profile, combo, upsell and the whole trace.

Everything that depends on one turn alone is computed in its row.  What needs other rows is reduced first to one row
per session (profile, stage), per distinct text of a shop (name and keyword matches) or per shop (keyword
groups), written, and met by joins of known size; only the memory and requirement frames, which need a session's
order, are joined by turn.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import catalog as C
from parlance.operators import scoring as S
from parlance.plans import catalog_queries as CQ
from parlance.plans import scoring_queries as SQ
from parlance.plans import turn_queries as TQ
from parlance.plans.memory_queries import LONG_TTL
from parlance.plans.registry import register
from parlance.session import stored
from parlance.sources import bindings as B
from parlance.sources.tables import read_table

#: A shop that has no product, asked in by every 23rd turn.
EMPTY_SHOP = "Brand#99"

#: The requirement lists that count as said in a turn.
REQUIREMENTS = ("explicit_requirements", "implicit_requirements")

# The lines of the trace that tell how the combo was found.
LOAD, EMPTY = "Phase 2.4a: Load products from DB catalog", "Phase 2.4a: DB empty -> fallback to demo combos"
FALLBACK, SELECTED = "Phase 2.4b: Fallback combo selection (heuristic)", "Phase 2.4b: Selected "
UPSELL = "Phase 2.4: UpSalesCrossSalesAgent"

# What is said in a turn, by the rest of its number; {n} is a product's name, {t} its type.
TEXTS = ["giá {n} bao nhiêu", "Price of the economy bolt, please", "tư vấn {t}", "What size and color do you recommend? price",
         "I want to buy a widget, quality first", "refund, it is broken", "hello", "How much is the delivery cost?"]


def turn_messages(spark, d):
    """Every event as a turn: its shop and product, what is said, and the combo that the upsell step chose (of
    every five turns one chose nothing, one a combo of the shop, one an unknown id, one '', one a demo combo)."""
    ev = read_table(spark, d, "events", "event_id", "ts", "user_id")
    part = read_table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type").select(
        F.col("p_partkey").alias("part_id"), "p_name", "p_brand", "p_type")
    number = F.col("event_id")
    j = ev.withColumn("part_id", number % 199 + 1).join(part, "part_id")
    text = F.element_at(F.array(*[F.lit(t) for t in TEXTS]), (number % len(TEXTS) + 1).cast("int"))
    text = F.replace(F.replace(text, F.lit("{n}"), F.col("p_name")), F.lit("{t}"), F.col("p_type"))
    own = (F.when(F.col("part_id") % 7 == 0, F.col("part_id").cast("string"))
           .when(F.col("part_id") % 11 == 0, F.col("part_id").cast("string"))
           .otherwise(F.concat("p_brand", F.lit("-"), F.col("part_id").cast("string"))))
    chosen = (F.when(number % 5 == 1, own).when(number % 5 == 2, "UNKNOWN").when(number % 5 == 3, "")
              .when(number % 5 == 4, "DEMO-02"))
    return j.select("event_id", number.alias("msg_id"), F.col("user_id").alias("session_id"),
                    B.epoch_seconds(F.col("ts")).alias("ts"),
                    F.when(number % 23 == 0, EMPTY_SHOP).otherwise(F.col("p_brand")).alias("shop_id"),
                    text.alias("content"), chosen.alias("selected_combo"))


def combo_trace(candidates, turns):
    """#21-#24 of turns with requirement lists: ``final_combo``, its price, and the lines of the trace."""
    looked = C.selected_combo_lookup(turns, candidates)
    matched = C.fallback_combo(C.match_combos(looked, candidates, "content", REQUIREMENTS, CQ.GROUPS))
    found = F.col("sel_rank").isNotNull()
    rank = F.when(found, F.col("sel_rank")).when(F.col("price_intent"), F.coalesce(
        F.col("name_match.rank"), F.col("keyword_match.rank")))
    prices = stored(candidates.select("shop_id", F.col("rank").alias("final_rank"), F.col("price").alias("final_price")), "combo-prices")
    j = matched.withColumn("final_rank", rank).join(prices, ["shop_id", "final_rank"], "left")
    fell = ~found & F.col("price_intent")
    lines = F.array_compact(F.array(
        F.lit(LOAD), F.when(F.col("final_rank.seq").isNotNull() & (F.col("final_rank.seq") > 0) | F.col("empty"), F.lit(EMPTY)),
        F.when(fell, F.lit(FALLBACK)),
        F.when(fell & F.col("final_combo").isNotNull(), F.concat(
            F.lit(SELECTED), "final_combo", F.lit(" (price="), F.col("final_price").cast("string"), F.lit(")")))))
    return j.withColumn("combo_lines", lines)


def turn_record_frame(spark, d):
    said = turn_messages(spark, d)
    asked = S.requirement_terms(said.select("session_id", "msg_id", "ts", "content"), ttl=LONG_TTL).select(
        "msg_id", "explicit_requirements", "implicit_requirements", "service_type")
    empty = F.col("shop_id") == EMPTY_SHOP
    # written, as the matching reads the turns twice: for their distinct texts and for themselves
    turns = said.join(asked, "msg_id").withColumn("empty", empty)
    turns = stored(C.with_texts(turns, "content", REQUIREMENTS), "asked-turns")
    shops = B.shops(spark, d).select("id").union(spark.range(1).select(F.lit(EMPTY_SHOP)))
    combos = stored(combo_trace(C.combo_candidates(B.products(spark, d), shops), turns).select(
        "event_id", "shop_id", "content", "selected_combo", "explicit_requirements", "implicit_requirements", "service_type",
        "price_intent", "final_combo", "final_price", "combo_lines"), "turn-combos")
    base = TQ.turn_results_frame(spark, d)
    # the lines of the combo go behind that of the upsell step
    end = F.instr("phase_trace", F.lit(UPSELL)) + len(UPSELL)
    whole = F.when(F.contains(F.col("phase_trace"), F.lit(UPSELL)), F.concat(
        F.substring("phase_trace", F.lit(1), end - 1), F.lit(" | "), F.array_join("combo_lines", " | "),
        F.substring("phase_trace", end, F.length("phase_trace")))).otherwise(F.col("phase_trace"))
    return base.join(combos, "event_id").withColumn("phase_trace", whole)


def _record_sql():
    text = "CASE e.event_id % 8 " + " ".join(
        f"WHEN {i} THEN replace(replace('{t}', '{{n}}', p.p_name), '{{t}}', p.p_type)" for i, t in enumerate(TEXTS)) + " END"
    req = SQ._requirement_sql().replace(B.with_ctes("messages_short"), "", 1).lstrip().lstrip(",").replace("messages_short", "tm")
    head, select = req.rsplit("\nSELECT session_id, msg_id,", 1)
    demo = ", ".join(f"({i + 1}, '{c}', '{n}', {p})" for i, (c, n, _, p) in enumerate(C.DEMO_COMBOS))
    kw = " OR ".join(f"({CQ._contains_any_sql('q.hay', k)} AND {CQ._contains_any_sql('c.combo_name', k)})" for k in CQ.GROUPS.values())
    norm = CQ._norm_sql
    lists = f"CASE WHEN {{c}} = '' THEN [] ELSE string_split({{c}}, ',') END"
    both = f"list_concat({lists.format(c='r.explicit_requirements')}, {lists.format(c='r.implicit_requirements')})"
    price = CQ._contains_any_sql(norm("q.content"), C.PRICE_KEYWORDS)
    cut = f"position(' | {UPSELL}' IN t.phase_trace) + {len(UPSELL) + 3}"
    return CQ._LISTING_SQL + f""",
tm AS (
  SELECT e.event_id, e.event_id AS msg_id, e.user_id AS session_id, CAST(floor(epoch(e.ts)) AS BIGINT) AS ts,
         CASE WHEN e.event_id % 23 = 0 THEN '{EMPTY_SHOP}' ELSE p.p_brand END AS shop_id, {text} AS content,
         CASE e.event_id % 5 WHEN 1 THEN CASE WHEN p.p_partkey % 7 = 0 OR p.p_partkey % 11 = 0 THEN CAST(p.p_partkey AS VARCHAR)
                                              ELSE p.p_brand || '-' || CAST(p.p_partkey AS VARCHAR) END
                             WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN '' WHEN 4 THEN 'DEMO-02' END AS selected_combo
  FROM events e JOIN part p ON p.p_partkey = e.event_id % 199 + 1),
{head},
req AS (SELECT session_id, msg_id,{select}),
every AS (
  SELECT shop_id, position, combo_id, token, combo_name, price FROM cands
  UNION ALL SELECT '{EMPTY_SHOP}', n, id, replace(name, '_', ' '), lower(id) || ' ' || name, CAST(price AS DOUBLE)
  FROM (VALUES {demo}) v(n, id, name, price)),
tq AS (
  SELECT q.*, r.explicit_requirements, r.implicit_requirements, r.service_type, {price} AS price_intent,
         array_to_string(list_concat([{norm('q.content')}], list_transform({both}, lambda x: {norm('x')})), ' ') AS hay
  FROM tm q JOIN req r ON r.msg_id = q.msg_id),
sel_at AS (SELECT q.event_id, min(c.position) AS p FROM tq q JOIN every c ON c.shop_id = q.shop_id AND c.combo_id = q.selected_combo
           GROUP BY q.event_id),
name_at AS (SELECT q.event_id, min(c.position) AS p FROM tq q JOIN every c ON c.shop_id = q.shop_id
            WHERE length(c.token) > 0 AND instr(q.hay, c.token) > 0 GROUP BY q.event_id),
kw_at AS (SELECT q.event_id, min(c.position) AS p FROM tq q JOIN every c ON c.shop_id = q.shop_id AND ({kw}) GROUP BY q.event_id),
picked AS (
  SELECT q.*, s.p IS NOT NULL AS found, coalesce(s.p, CASE WHEN q.price_intent THEN coalesce(n.p, k.p) END) AS at
  FROM tq q LEFT JOIN sel_at s USING (event_id) LEFT JOIN name_at n USING (event_id) LEFT JOIN kw_at k USING (event_id)),
combo AS (
  SELECT p.*, c.combo_id AS final_combo, c.price AS final_price,
         array_to_string(list_filter(['{LOAD}', CASE WHEN p.shop_id = '{EMPTY_SHOP}' THEN '{EMPTY}' END,
           CASE WHEN NOT found AND price_intent THEN '{FALLBACK}' END,
           CASE WHEN NOT found AND price_intent AND c.combo_id IS NOT NULL
                THEN '{SELECTED}' || c.combo_id || ' (price=' || CAST(c.price AS VARCHAR) || ')' END],
           lambda x: x IS NOT NULL), ' | ') AS lines
  FROM picked p LEFT JOIN every c ON c.shop_id = p.shop_id AND c.position = p.at)
SELECT t.* EXCLUDE (phase_trace), c.shop_id, c.content, c.selected_combo, c.explicit_requirements, c.implicit_requirements,
       c.service_type, c.price_intent, c.final_combo, c.final_price,
       CASE WHEN t.phase_trace LIKE '%{UPSELL}%' THEN substr(t.phase_trace, 1, {cut} - 1) || ' | ' || c.lines || substr(t.phase_trace, {cut})
            ELSE t.phase_trace END AS phase_trace
FROM ({TQ._turns_sql()}) t JOIN combo c ON c.event_id = t.event_id"""


@register("turn_record", _record_sql())
def turn_record(spark, d):
    out = turn_record_frame(spark, d).drop("combo_lines")
    return out.withColumn("explicit_requirements", F.array_join("explicit_requirements", ",")).withColumn(
        "implicit_requirements", F.array_join("implicit_requirements", ","))
