"""Merkle fixity audit of WARC files.

A manifest lists the records of every WARC file in order, with offset, length and
SHA-256 of the record's bytes.  Each replica has a manifest of its own, from the records
that it holds in the order in which it holds them, and a tree over it: a leaf is the digest
of a record's offset, length and SHA-256, a node's digest is the SHA-256 of its children's
digests in order.  An audit compares the roots of two replicas and descends, level by level,
only into the children of nodes that differ or that one side lacks; only the records at the
leaves that it reaches are paired.

Records of a file are paired by id and digest, the n-th copy with the n-th; what is left is
paired by id alone and ``corrupt``; then what only the primary has is ``missing`` and what
only the replica has is ``extra``.  A paired record of equal bytes is ``moved`` if it is not in
every longest run of the file's pairs that keeps the primary's order, and else ``ok``: a
record that only lies further on because others were lost or inserted is not moved.

Defined results: null columns of a page count as empty strings in its record; pages
without an id go to files of their own, by hash, and are paired by digest only; repeated
rows are records of their own and ordered by digest unless the table says where they lie;
an empty table has no records; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import ship_package, stored

#: Ids per WARC file, and children per tree node.
FILE_IDS, FANOUT_BITS = 1000, 4
#: Files over which pages without an id are spread.
LOOSE_FILES = 4096


def record(url: Column, html: Column) -> Column:
    """The bytes of a page's WARC record."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
                    F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            position_col: str | None = None) -> DataFrame:
    """``page_id, file, position, length, sha`` of every page's record; the bytes stay in the
    task.  ``position_col`` orders the records of a file; without it they lie by id."""
    data = record(F.col(url_col), F.col(html_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.col(position_col or id_col).cast("long").alias("position"), data.alias("data"))
    file = F.coalesce(F.floor(F.col("page_id") / FILE_IDS), -1 - F.pmod(F.xxhash64("data"), F.lit(LOOSE_FILES)))
    return rows.select("page_id", file.cast("long").alias("file"), "position",
                       F.octet_length("data").cast("long").alias("length"), F.sha2("data", 256).alias("sha"))


def manifest(rows: DataFrame) -> DataFrame:
    """Ordinal and offset of every record in its file, by position, id and then digest."""
    order = Window.partitionBy("file").orderBy("position", "page_id", "sha")
    return rows.select("page_id", "file", (F.row_number().over(order) - 1).alias("ordinal"),
                       (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"),
                       "length", "sha")


def leaves(listed: DataFrame) -> DataFrame:
    """A manifest's leaves: ``sha`` covers a record's offset and length too."""
    return listed.select("file", "ordinal", F.sha2(F.concat_ws(":", "offset", "length", "sha"), 256).alias("sha"))


def tree(own: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes by level, leaves first: ``file, node, sha``.  Each parent joins at most
    2**FANOUT_BITS children, in the order of their offsets."""
    out = [own.select("file", F.col("ordinal").cast("long").alias("node"),
                         F.coalesce("sha", F.lit("missing")).alias("sha"))]
    for _ in range(levels):
        children = out[-1].groupBy("file", F.shiftright("node", FANOUT_BITS).alias("parent")).agg(
            F.sort_array(F.collect_list(F.struct("node", "sha"))).alias("below"))
        out.append(children.select("file", F.col("parent").alias("node"),
                                   F.sha2(F.array_join("below.sha", ""), 256).alias("sha")))
    return out


def reached(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """``file, node, before`` of the leaves that differ or that one of two manifests lacks;
    ``before`` counts the equal leaves of the file in front of it."""
    most = max(m.agg(F.max("ordinal").alias("n")).first()["n"] or 0 for m in (primary, replica))
    levels = 1
    while most >> (FANOUT_BITS * levels):
        levels += 1
    ours, theirs = ([stored(x, "warc-tree") if i else x for i, x in enumerate(tree(leaves(m), levels))]
                    for m in (primary, replica))

    def differing(level: int, among: DataFrame | None) -> DataFrame:
        a, b = ours[level], theirs[level]
        if among is not None:
            inside = among.select("file", F.col("node").alias("parent"))
            a, b = (x.withColumn("parent", F.shiftright("node", FANOUT_BITS)).join(inside, ["file", "parent"], "left_semi")
                    .drop("parent") for x in (a, b))
        return a.join(b.withColumnRenamed("sha", "there"), ["file", "node"], "full").filter(
            ~F.col("sha").eqNullSafe(F.col("there"))).select("file", "node")

    bad = None
    for level in range(levels, -1, -1):
        bad = stored(differing(level, bad), "warc-differing")
    # a file's leaves are numbered without gaps, so those that are not reached are equal
    rank = F.row_number().over(Window.partitionBy("file").orderBy("node"))
    return bad.withColumn("before", F.col("node") - rank + 1)


def paired(primary: DataFrame, replica: DataFrame, at: DataFrame) -> DataFrame:
    """The records of both manifests at the reached leaves, paired: ``page_id, file, here,
    there``, the record on each side (null if there is none)."""
    entry = F.struct("ordinal", "offset", "length", "sha", "before")
    at = at.withColumnRenamed("node", "ordinal")
    sides = [m.withColumn("ordinal", F.col("ordinal").cast("long")).join(at, ["file", "ordinal"]).select(
        "page_id", "file", "sha", F.lit(side).alias("side"), entry.alias("entry"))
        for side, m in enumerate((primary, replica))]
    both = [F.max(F.when(F.col("side") == side, F.col("entry"))).alias(name) for side, name in enumerate(("here", "there"))]

    def match(rows: DataFrame, *key: str) -> DataFrame:
        copy = F.row_number().over(Window.partitionBy(*key, "side").orderBy("entry.ordinal"))
        return rows.withColumn("copy", copy).groupBy(*key, "copy").agg(*both).select("page_id", "file", "here", "there")

    same = match(sides[0].unionByName(sides[1]), "file", "page_id", "sha")
    alone = "here is null or there is null"
    left = same.filter(alone).select("page_id", "file", F.when(F.col("here").isNull(), 1).otherwise(0).alias("side"),
                                     F.coalesce("here", "there").alias("entry"))
    return (same.filter(f"not ({alone})").unionByName(match(left.filter("page_id is not null"), "file", "page_id"))
            .unionByName(same.filter(f"({alone}) and page_id is null")))


def out_of_order(there: list[int]) -> list[int]:
    """Indices of the values that are not in every longest increasing run of ``there``."""
    def longest(values):
        ends, out = [], []
        for x in values:
            k = bisect_left(ends, x)
            ends[k:k + 1] = [x]
            out.append(k + 1)
        return out

    upto = longest(there)
    after = longest([-x for x in reversed(there)])[::-1]
    best = max(upto, default=0)
    on = [a + b - 1 == best for a, b in zip(upto, after)]
    held = [0] * (best + 1)
    for a, x in zip(upto, on):
        held[a] += x
    return [i for i, (a, x) in enumerate(zip(upto, on)) if not x or held[a] > 1]


def moved(listed: DataFrame, pairs: DataFrame, at: DataFrame) -> DataFrame | None:
    """``file, ordinal`` of the primary's records that are out of their order in the replica;
    None if no file has any.  Python sees the ordinals of files that are out of order only."""
    held = pairs.filter("here is not null and there is not null").select(
        "file", F.col("here.ordinal").alias("ordinal"), F.col("there.ordinal").alias("there"),
        (F.col("here.before") != F.col("there.before")).alias("crossed"))
    last = F.max("there").over(Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    files = stored(held.withColumn("last", last).filter("crossed or there < last").select("file").distinct(), "warc-unordered")
    if files.isEmpty():
        return None
    inside = at.select("file", F.col("node").alias("ordinal"))
    equal = listed.select("file", F.col("ordinal").cast("long").alias("ordinal")).join(files, "file", "left_semi").join(
        inside, ["file", "ordinal"], "left_anti").withColumn("there", F.col("ordinal"))
    every = held.drop("crossed").join(files, "file", "left_semi").unionByName(equal)

    def run(own):
        own = own.sort_values("ordinal")
        return own.iloc[out_of_order(own["there"].tolist())][["file", "ordinal"]]

    ship_package(listed.sparkSession)
    return every.groupBy("file").applyInPandas(run, "file long, ordinal long")


def compare(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """``page_id, file, ordinal, offset, length, sha256, status`` of every record of the primary
    and of every record that only the replica has (with its place there); status is ``ok``,
    ``corrupt``, ``missing``, ``moved`` or ``extra``.  Both take ``records()`` rows."""
    listed, held = (stored(manifest(x), "warc-manifest") for x in (primary, replica))
    at = stored(reached(listed, held), "warc-reached")
    pairs = stored(paired(listed, held, at), "warc-pairs")
    astray = moved(listed, pairs, at)
    status = (F.when(F.col("there").isNull(), "missing").when(F.col("here.sha") != F.col("there.sha"), "corrupt"))
    found = pairs.filter("here is not null").select("file", F.col("here.ordinal").alias("ordinal"), status.alias("status"))
    if astray is not None:
        found = found.join(astray.withColumn("astray", F.lit(True)), ["file", "ordinal"], "left").select(
            "file", "ordinal", F.coalesce("status", F.when(F.col("astray"), "moved")).alias("status"))
    ours = listed.withColumn("ordinal", F.col("ordinal").cast("long")).join(
        found.filter("status is not null"), ["file", "ordinal"], "left").select(
        "page_id", "file", "ordinal", "offset", "length", F.col("sha").alias("sha256"),
        F.coalesce("status", F.lit("ok")).alias("status"))
    extra = pairs.filter("here is null").select("page_id", "file", "there.ordinal", "there.offset", "there.length",
                                                F.col("there.sha").alias("sha256"), F.lit("extra").alias("status"))
    return ours.unionByName(extra)


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """``compare()`` for the records of the primary alone."""
    return compare(primary, replica).filter("status <> 'extra'")
