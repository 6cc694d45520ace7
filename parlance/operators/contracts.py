"""Table contracts: rule violations, key uniqueness, foreign keys, defaults (#2-#5).

All checks are declarative: a rule is a boolean "bad" expression, evaluated in
one projection; uniqueness is one aggregate; foreign keys are anti joins that
drop null keys first (a null reference is not an orphan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.ids import uuid5_dns

# Closed role domain of a message.
ROLES = ["user", "assistant", "system", "tool"]


def not_null(c: str) -> tuple[str, Column]:
    return f"{c}: not null", F.col(c).isNull()


def in_domain(c: str, values) -> tuple[str, Column]:
    return f"{c}: domain", F.col(c).isNotNull() & ~F.col(c).isin(*values)


def at_least(c: str, lo) -> tuple[str, Column]:
    return f"{c}: >= {lo}", F.col(c) < lo


def between(c: str, lo, hi) -> tuple[str, Column]:
    return f"{c}: {lo}..{hi}", (F.col(c) < lo) | (F.col(c) > hi)


def max_length(c: str, n: int) -> tuple[str, Column]:
    return f"{c}: length <= {n}", F.length(F.col(c)) > n


def contract_violations(df: DataFrame, key_cols, rules) -> DataFrame:
    """#2: one row per (row, broken rule): ``key_cols`` + ``rule``."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]))
    return df.select(*key_cols, F.explode(hits).alias("rule"))


def unique_violations(df: DataFrame, key_cols, skip_nulls: bool = True) -> DataFrame:
    """#3: duplicate keys with their multiplicity (null keys ignored for unique columns)."""
    d = df
    if skip_nulls:
        for c in key_cols:
            d = d.where(F.col(c).isNotNull())
    return d.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def fk_orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, fk_name: str) -> DataFrame:
    """#4: child rows whose non-null reference has no parent row."""
    c = child.where(F.col(child_key).isNotNull())
    p = parent.select(F.col(parent_key).alias("_pk"))  # an anti join needs no distinct build side
    return (c.join(p, c[child_key] == p["_pk"], "left_anti")
            .select(F.lit(fk_name).alias("fk"), F.col(child_key).cast("string").alias("child_key")))


def apply_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """#5: ``coalesce`` each column with its default expression (column names are kept)."""
    def fill(c):
        v = defaults[c]
        return F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)).alias(c)
    return df.select(*[fill(c) if c in defaults else F.col(c) for c in df.columns])


def schema_rules(schema: T.StructType) -> list[tuple[str, Column]]:
    """#2: the rules that a table's declared schema states: its required columns hold a value."""
    return [not_null(f.name) for f in schema.fields if not f.nullable]


def insert_defaults(now: Column, key: Column) -> dict[str, dict[str, Column]]:
    """#5: what a table's columns get when a new row leaves them out.

    ``now`` is the time of the insert; an id is derived from ``key`` (a text that names the row), so that
    an insert that runs again gives the same row the same id."""
    made, times = uuid5_dns(key), {"created_at": now, "updated_at": now}
    return {"shops": {"id": made}, "products": {"id": made, "stock_quantity": F.lit(0)}, "customers": {"id": made, **times},
            "documents": {"id": made, "status": F.lit("active")}, "sessions": {"id": made, **times},
            "messages": {"id": made, "created_at": now}}


def apply_insert_defaults(df: DataFrame, table: str, now: Column, key: Column) -> DataFrame:
    """#5 for rows of a domain table: every default of the table that the frame has a column for."""
    defaults = insert_defaults(now, key)[table]
    return apply_defaults(df, {c: v for c, v in defaults.items() if c in df.columns})
