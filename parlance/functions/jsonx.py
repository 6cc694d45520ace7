"""JSON helpers as column expressions (#49, #50).

``shallow_merge`` is Python's ``dict.update`` on two JSON objects: right-side keys
win, nested values are replaced whole (not merged) and keep their JSON type
(values are ``VARIANT``, so numbers stay numbers).  Duplicate keys are removed
with ``map_filter`` before ``map_concat``, so no session setting
(``mapKeyDedupPolicy``) is needed.  A null side counts as ``{}``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.operators.parsing import json_candidate

_MAP = "map<string,variant>"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_map(c) -> Column:
    return F.coalesce(F.from_json(col_(c), _MAP), F.from_json(F.lit("{}"), _MAP))


def shallow_merge(left, right) -> Column:
    """#50: JSON text of ``left.update(right)``."""
    lm, rm = json_map(left), json_map(right)
    kept = F.map_filter(lm, lambda k, v: ~F.array_contains(F.map_keys(rm), k))
    return F.to_json(F.map_concat(kept, rm))
