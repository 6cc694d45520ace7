"""Customer profile queries: history (#30), priority (#54), label (#55)."""

from __future__ import annotations

from parlance.operators import profile as P
from parlance.plans.registry import register
from parlance.sources import bindings as B

_HISTORY_SQL = f"""
WITH agg AS (
  SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS spend, max(o_orderdate) AS last_ts
  FROM orders WHERE o_orderdate < DATE '{B.AS_OF_DATE}' + INTERVAL 1 DAY GROUP BY o_custkey),
history AS (
  SELECT c.c_custkey AS customer_id, CAST(coalesce(a.n, 0) AS BIGINT) AS total_orders,
         round(coalesce(a.spend, 0.0), 2) AS total_spend,
         CAST(date_diff('day', CAST(a.last_ts AS DATE), DATE '{B.AS_OF_DATE}') AS INTEGER) AS last_purchase_days
  FROM customer c LEFT JOIN agg a ON c.c_custkey = a.o_custkey)
"""


def _history(spark, d):
    return P.customer_history(B.customers(spark, d), B.purchases(spark, d), B.AS_OF_DATE)


@register("customer_history", _HISTORY_SQL + "SELECT * FROM history")
def customer_history(spark, d):
    return _history(spark, d)


def _priority_sql(min_orders, min_spend, max_recency):
    return _HISTORY_SQL + f"""
SELECT *, CAST(least(1 + CASE WHEN total_orders > {min_orders} THEN 1 ELSE 0 END
                      + CASE WHEN total_spend > {min_spend} THEN 1 ELSE 0 END
                      + CASE WHEN last_purchase_days < {max_recency} THEN 1 ELSE 0 END, 5) AS INTEGER)
       AS priority_score
FROM history"""


@register("priority_score", _priority_sql(5, 10000000, 30))
def priority_score(spark, d):
    return P.priority_score(_history(spark, d))


# Lower thresholds so every branch of the rule fires on the driver data.
@register("priority_score_low", _priority_sql(10, 3000000, 400))
def priority_score_low(spark, d):
    return P.priority_score(_history(spark, d), min_orders=10, min_spend=3_000_000, max_recency_days=400)


def _label_sql():
    whens = "\n".join(
        f"    WHEN total_orders >= {o} AND total_spend >= {s} AND last_purchase_days <= {r} THEN '{lab}'"
        for _, lab, o, s, r in sorted(P.DEFAULT_LABEL_TIERS, key=lambda t: -t[0]))
    return _HISTORY_SQL + f"SELECT *, CASE\n{whens}\n    ELSE '{P.NEUTRAL_LABEL}' END AS customer_label FROM history"


@register("customer_label", _label_sql())
def customer_label(spark, d):
    return P.customer_label(_history(spark, d))
