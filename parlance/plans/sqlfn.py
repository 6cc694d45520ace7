"""DuckDB SQL text for the helper expressions, used by the oracles."""

from __future__ import annotations

from parlance.functions.ids import NAMESPACE_DNS_HEX


def uuid5_sql(x: str) -> str:
    h = f"sha1(unhex('{NAMESPACE_DNS_HEX}') || encode({x}))"
    var = f"substr('89ab', ((position(substr({h}, 17, 1) IN '0123456789abcdef') - 1) & 3) + 1, 1)"
    hx = f"(substr({h}, 1, 12) || '5' || substr({h}, 14, 3) || {var} || substr({h}, 18, 15))"
    return dashed_sql(hx)


def dashed_sql(hx: str) -> str:
    return (f"(substr({hx}, 1, 8) || '-' || substr({hx}, 9, 4) || '-' || substr({hx}, 13, 4) || '-' || "
            f"substr({hx}, 17, 4) || '-' || substr({hx}, 21, 12))")


def canonical_uuid_sql(x: str) -> str:
    h = f"replace(regexp_replace(replace(replace({x}, 'urn:', ''), 'uuid:', ''), '^[{{}}]+|[{{}}]+$', '', 'g'), '-', '')"
    return f"CASE WHEN regexp_full_match({h}, '[0-9a-fA-F]{{32}}') THEN {dashed_sql('lower(' + h + ')')} END"


def iso_sql(ts: str) -> str:
    return f"strftime(make_timestamp(CAST({ts} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S')"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def norm_sql(x: str) -> str:
    return f"lower({strip_sql(f'coalesce({x}, {chr(39)}{chr(39)})')})"
