"""Deletes that follow declared foreign keys (#61), and the references they would break (#4).

A contract is a list of ``ForeignKey``.  ``cascade`` walks its graph from parents to children: a row goes if
it is doomed itself or if a key that cascades points at a row that goes; a key that is set to null loses
its value.  Each step is one aggregate of the doomed keys and one join per key; the rows
of a table are read once, whatever the number of its keys.  Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CASCADE, SET_NULL = "CASCADE", "SET NULL"


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` refers to ``parent.parent_key``; what a delete of the parent does to the child."""

    child: str
    column: str
    parent: str
    on_delete: str = CASCADE
    parent_key: str = "id"

    @property
    def name(self) -> str:
        return f"{self.child}.{self.column}"


# The references between the domain tables and what a delete does.
FOREIGN_KEYS = [
    ForeignKey("products", "shop_id", "shops"),
    ForeignKey("customers", "shop_id", "shops"),
    ForeignKey("documents", "product_id", "products"),
    ForeignKey("sales_pipelines", "shop_id", "shops"),
    ForeignKey("sessions", "current_stage_id", "sales_pipelines", SET_NULL),
    ForeignKey("messages", "session_id", "sessions"),
]


def delete_order(keys: Iterable[ForeignKey]) -> list[str]:
    """Tables with every parent before its children; references in a circle are refused."""
    parents: dict[str, set[str]] = {}
    for k in keys:
        parents.setdefault(k.child, set()).add(k.parent)
        parents.setdefault(k.parent, set())
    order: list[str] = []
    while len(order) < len(parents):
        free = sorted(t for t, p in parents.items() if t not in order and p <= set(order))
        if not free:
            raise ValueError(f"references in a circle: {sorted(set(parents) - set(order))}")
        order += free
    return order


def _marked(rows: DataFrame, column: str, gone: DataFrame, mark: str) -> DataFrame:
    """``rows`` with a column that tells whether ``column`` is among the keys in ``gone``."""
    keys = gone.select(F.col("key").alias(f"_{mark}")).dropna().distinct()
    return (rows.join(keys, rows[column].eqNullSafe(F.col(f"_{mark}")) & rows[column].isNotNull(), "left")
            .withColumn(mark, F.col(f"_{mark}").isNotNull()).drop(f"_{mark}"))


def cascade(tables: dict[str, DataFrame], doomed: dict[str, DataFrame],
            keys: Iterable[ForeignKey] = FOREIGN_KEYS) -> dict[str, DataFrame]:
    """Every table with a column ``_gone``, and references to rows that go set to null where the key says so.

    ``doomed``: per table the keys (column ``key``) of the rows to delete.  A null reference follows nothing."""
    keys = [k for k in keys if k.child in tables and k.parent in tables]
    out: dict[str, DataFrame] = {}
    for name in [t for t in delete_order(keys) if t in tables] + [t for t in tables if all(
            t not in (k.child, k.parent) for k in keys)]:
        rows = tables[name]
        own = next((k.parent_key for k in keys if k.parent == name), "id")
        gone = F.lit(False)
        if name in doomed:
            rows = _marked(rows, own, doomed[name], "_doomed")
            gone = gone | F.col("_doomed")
        for at, k in enumerate(k for k in keys if k.child == name):
            parent = out[k.parent].where("_gone").select(F.col(k.parent_key).alias("key"))
            rows = _marked(rows, k.column, parent, f"_lost{at}")
            if k.on_delete == CASCADE:
                gone = gone | F.col(f"_lost{at}")
            else:
                rows = rows.withColumn(k.column, F.when(~F.col(f"_lost{at}"), F.col(k.column)))
        out[name] = rows.withColumn("_gone", gone).select(*tables[name].columns, "_gone")
    return out


def kept(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows that stay after ``cascade``."""
    return {name: rows.where(~F.col("_gone")).drop("_gone") for name, rows in tables.items()}


def orphans(tables: dict[str, DataFrame], keys: Iterable[ForeignKey] = FOREIGN_KEYS) -> DataFrame:
    """#4 over a whole contract: ``fk, child_key, n``, the references that point at no row, and by how many rows."""
    found = None
    for k in keys:
        if k.child not in tables or k.parent not in tables:
            continue
        there = tables[k.parent].select(F.col(k.parent_key).alias("_key"))
        child = tables[k.child].where(F.col(k.column).isNotNull())
        lost = (child.join(there, child[k.column] == F.col("_key"), "left_anti").groupBy(
            F.lit(k.name).alias("fk"), F.col(k.column).cast("string").alias("child_key")).agg(F.count(F.lit(1)).alias("n")))
        found = lost if found is None else found.unionByName(lost)
    if found is None:
        raise ValueError("no key of the contract has both its tables")
    return found
