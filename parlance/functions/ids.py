"""UUID handling as column expressions (#47).

``canonical_uuid`` accepts what Python's ``uuid.UUID(str)`` accepts for ordinary
text: optional ``urn:`` / ``uuid:`` prefixes, surrounding braces, hyphens, any
letter case; it returns the lower-case 36-character form or null.
``uuid5_dns`` is RFC 4122 version 5 (SHA-1) in the DNS namespace, computed with
``sha1`` over ``namespace bytes || UTF-8 name``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the RFC 4122 DNS namespace UUID.
NAMESPACE_DNS_HEX = "6ba7b8109dad11d180b400c04fd430c8"


def _dashed(hex32: Column) -> Column:
    return F.concat_ws("-", F.substring(hex32, 1, 8), F.substring(hex32, 9, 4), F.substring(hex32, 13, 4),
                       F.substring(hex32, 17, 4), F.substring(hex32, 21, 12))


def canonical_uuid(c) -> Column:
    s = F.col(c) if isinstance(c, str) else c
    h = F.replace(F.replace(s, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    h = F.replace(F.regexp_replace(h, r"^[{}]+|[{}]+$", ""), F.lit("-"), F.lit(""))
    return F.when(h.rlike("^[0-9a-fA-F]{32}$"), _dashed(F.lower(h)))


def uuid5_dns(c) -> Column:
    s = F.col(c) if isinstance(c, str) else c
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_DNS_HEX)), F.encode(s, "UTF-8")))
    # the variant's two bits 10 replace the digit's upper two; each piece is cut from the digest itself, as
    # an expression that is used five times may be computed five times
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
                       F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
