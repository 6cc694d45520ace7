"""String, list and number formatting as Spark column expressions (#41-#46, #48, #17).

Everything here is a built-in expression, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``str.strip()`` removes Unicode whitespace at both ends; Spark's ``trim``
# removes only spaces, so strip with a Unicode-aware regular expression instead.
_EDGE_SPACE = r"(?U)^\s+|\s+$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    return F.regexp_replace(col_(c), _EDGE_SPACE, "")


def has_text(c) -> Column:
    """Whether something is left of ``c`` when it is stripped."""
    return col_(c).rlike(r"(?U)\S")


def stripped_starts_with(c, char: str) -> Column:
    """Whether ``c`` starts with a character when it is stripped."""
    return col_(c).rlike(rf"(?U)\A\s*\Q{char}\E")


def normalize(c) -> Column:
    """#41: null -> '', strip, lower."""
    return F.lower(py_strip(F.coalesce(col_(c), F.lit(""))))


def normalize_name(c) -> Column:
    """#41 for product names: normalise, then '_' -> ' '."""
    return F.replace(normalize(c), F.lit("_"), F.lit(" "))


def contains_any(c, keywords) -> Column:
    """#42: any keyword is a substring of ``c`` (an OR chain of ``instr``, kept in codegen)."""
    out = None
    for k in keywords:
        e = F.instr(col_(c), F.lit(k)) > 0
        out = e if out is None else (out | e)
    return F.coalesce(out, F.lit(False)) if out is not None else F.lit(False)


def list_text(arr) -> Column:
    """#43: list -> ``", "``-joined text; empty or null -> 'None'."""
    a = col_(arr)
    return F.when(F.coalesce(F.size(a), F.lit(0)) <= 0, F.lit("None")).otherwise(F.array_join(a, ", "))


def nonempty_or_null(c) -> Column:
    """#44: '' -> null."""
    return F.nullif(col_(c), F.lit(""))


def numbered_lines(arr, empty_text: str = "(no trace)") -> Column:
    """#45: ``1. a\\n2. b``; an empty list gives ``empty_text``."""
    a = col_(arr)
    body = F.array_join(F.transform(a, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return F.when(F.coalesce(F.size(a), F.lit(0)) <= 0, F.lit(empty_text)).otherwise(body)


def bulleted_lines(arr, bullet: str = "- ") -> Column:
    """#45: one ``- item`` line per element; null is no element."""
    return F.coalesce(F.array_join(F.transform(col_(arr), lambda x: F.concat(F.lit(bullet), x)), "\n"), F.lit(""))


def thousands(c) -> Column:
    """#46: Python ``format(x, ',.0f')`` (half-even rounding, like DecimalFormat)."""
    return F.format_number(col_(c).cast("double"), 0)


def percent2(c) -> Column:
    """#46: Python ``format(x, '.2%')``: the exact value of ``x * 100`` rounded half-even."""
    number = F.format_number(col_(c).cast("double") * 100, 2)
    return F.concat(F.replace(number, F.lit(","), F.lit("")), F.lit("%"))


# Lengths of previews and what marks a cut (messages, summaries, prompts).
PREVIEWS = {100: "...", 200: "...", 2000: ""}


def preview(c, n: int = 100) -> Column:
    """#17: the first ``n`` characters; a cut is marked by ``...``, but for prompts (2000)."""
    s = F.coalesce(col_(c), F.lit(""))
    cut = F.concat(F.substring(s, 1, n), F.lit(PREVIEWS.get(n, "...")))
    return F.when(F.length(s) > n, cut).otherwise(s)


def epoch_to_timestamp(c) -> Column:
    """#48: epoch seconds -> timestamp."""
    return F.timestamp_seconds(col_(c))


def iso_text(c) -> Column:
    """#48: ISO-8601 text of epoch seconds (UTC)."""
    ntz = F.timestamp_add("SECOND", col_(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.date_format(ntz, "yyyy-MM-dd'T'HH:mm:ss")
