"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the 64-bit hashes of its distinct 5-word shingles.  Two documents
link when 100 * intersection >= 75 * union.  For sets of n and m hashes that means an
overlap of at least ``ceil(3 * (n + m) / 7)``, and of ``ceil(3 * n / 4)`` for any partner.

Multi-match prefixes: when two sets, both in one global order, overlap in ``a`` elements,
their prefixes of ``n - a + l`` and ``m - a + l`` share at least ``l`` of them, for any l.

1. Sets are digested in the scan.  Equal sets form a class; its smallest id stands for it.
2. In hash order, every class emits a prefix lengthened by ``reach(n)``.  Hashes held by
   one class only are dropped, and then documents with fewer shared hashes than any
   partner would require, again and again: most documents end here, whatever passages
   they share, and only the sets of the others are ever moved.
3. Each remaining document is compared with the partner that it shares most with among
   the most central documents of its hashes' lists.  These star links are linear in the
   size of a group of near copies and already connect most of it.
4. Near misses are documents of whose whole sets *other* components hold as many hashes as a link needs.
   Those around the same central document form a group, inside which they would be all pairs: blocks of its
   documents are compared inside tasks, component against component, by bit matrices; only links leave a task.
5. Near misses of *different* groups are ordered anew, rarest hash first.  A document's prefix is lengthened by its estimated candidate cost (the
   lengths of its lists), and a pair needs as many shared prefix hashes as the
   shorter lengthening demands, at positions that its two sizes allow, and hashes enough
   that other groups hold at all (edits of its own rule a document out).  Pairs inside a
   group are never made; the members of a list's largest group meet the others
   only.
6. Pairs that remain are verified on whole sets; links become components.

No link between different components is lost, so the components are those of the full
similarity join.  Hash equality stands for shingle equality (64 bits, compared only
between the sets of a pair).

Defined results: a document without words or with a null text has an empty set, links
with nothing and is its own component; fewer than 5 words make one shingle of all; a
null id has no component and links nothing; rows that repeat an id and its text get the
same result (ids are taken to be unique otherwise: an id with several texts doesn't fail,
but stands for one document); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import arrow_map, ship_package, slices, stored

WORDS = 5
#: Word hashes that one worker keeps (about 0.15 KB each).
CACHE = 400_000
#: Times that documents with too few shared hashes are dropped (each time is exact).
PRUNES = 2
#: Candidates of a prefix above which it is lengthened, by lists of at most this length.
COST = 64
#: Documents and hashes of a block that is compared inside a task; columns of a bit matrix.
BLOCK_DOCS, BLOCK_HASHES, COLUMNS = 1024, 1 << 20, 4096

_HASHES: dict[bytes, int] = {}
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                               0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


# --- sizes of prefixes and overlaps, for numbers and for columns ---------------------------

def least_overlap(n):
    """Overlap with any partner: ceil(3 n / 4)."""
    return (3 * n + 3) // 4


def reach(n):
    """Hashes by which the prefix in hash order is lengthened."""
    return max(32, n // 12)


def prefix(n):
    return min(n, n - least_overlap(n) + 1 + reach(n))


def matches(n):
    """Shared hashes that the lengthened prefix demands."""
    return prefix(n) - (n - least_overlap(n))


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def _least_overlap(n: Column) -> Column:
    return _div(3 * n + 3, 4)


def _demand(n: Column) -> Column:
    """``matches`` of the smallest partner that a set of n may have."""
    m = _least_overlap(n)
    base = m - _least_overlap(m)
    return F.least(m, base + 1 + F.greatest(F.lit(32), _div(m, 12))) - base


# --- sets ------------------------------------------------------------------------------------

def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    missing = [w for w in set(words) if w not in _HASHES]
    if len(_HASHES) + len(missing) > CACHE:
        _HASHES.clear()
        missing = set(words)
    for w in missing:
        _HASHES[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    own = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    out = np.full(len(own) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ own[k:k + len(out)]) * _MIX[k]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))


def scanned(docs: DataFrame) -> DataFrame:
    """``doc, n, d1, d2, hashes``: size and 128-bit digest of every document's set, and its lengthened
    prefix in hash order.  Of equal sets a task gives the prefix of the first, and again only
    of a smaller id: a large group of copies has few prefixes per task, its smallest id's among them."""
    def run(batches):
        smallest: dict[bytes, int] = {}
        for part in slices(batches):
            n, marks, prefixes = [], [], []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                own = shingle_set(text)
                mark = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                n.append(len(own))
                marks.append(np.frombuffer(mark, np.int64))
                if doc is None or not len(own) or smallest.get(mark, doc + 1) <= doc:
                    prefixes.append(None)
                else:
                    smallest[mark] = doc
                    prefixes.append(own[:prefix(len(own))].tobytes())
            marks = np.array(marks)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int32()), pa.array(marks[:, 0]), pa.array(marks[:, 1]),
                 pa.array(prefixes, pa.binary())], ["doc", "n", "d1", "d2", "hashes"])

    return docs.transform(arrow_map, run, "doc long, n int, d1 long, d2 long, hashes binary")


def unpacked(rows: DataFrame) -> DataFrame:
    """``token, doc, n`` of a frame ``doc, n, hashes``."""
    def run(batches):
        for part in slices(batches):
            own = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(2)]
            if sum(map(len, own)):
                again = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(own)), part.column(0).take(again), part.column(1).take(again)],
                    ["token", "doc", "n"])

    return rows.select("doc", "n", "hashes").transform(arrow_map, run, "token long, doc long, n int")


def whole_sets(docs: DataFrame) -> DataFrame:
    """``doc, hashes``: whole sets as little-endian 64-bit numbers."""
    def run(batches):
        for part in slices(batches):
            sets = [shingle_set(t).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["doc", "hashes"])

    return docs.transform(arrow_map, run, "doc long, hashes binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``x, y`` that link, by their whole sets."""
    both = (pairs.select("x", "y")
            .join(sets.select(F.col("doc").alias("x"), F.col("hashes").alias("hx")), "x")
            .join(sets.select(F.col("doc").alias("y"), F.col("hashes").alias("hy")), "y")
            .select("x", "y", "hx", "hy"))

    def run(batches):
        for part in slices(batches):
            keep = []
            for a, b in zip(part.column(2), part.column(3)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                shared = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
                keep.append(100 * shared >= 75 * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["x", "y"]).filter(pa.array(keep))

    return both.transform(arrow_map, run, "x long, y long")


# --- components ------------------------------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """``doc, comp`` for every document with a link; ``comp`` is the smallest id reachable.

    Each round points every node at its smallest neighbour (if smaller), jumps along the
    pointers to their ends and contracts the links, so long chains take few rounds.
    """
    spark = links.sparkSession
    edges = stored(links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                   .filter("a < b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        parent = stored(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")), "parents")
        while True:  # pointer jumping
            up = parent.select(F.col("node").alias("to"), F.col("to").alias("up"))
            jumped = stored(parent.join(up, "to", "left").select(
                "node", F.coalesce("up", "to").alias("to"), F.col("up").isNotNull().alias("moved")), "parents")
            parent = jumped.select("node", "to")
            if jumped.filter("moved").isEmpty():
                break

        def lifted(df: DataFrame, col: str) -> DataFrame:
            by = parent.select(F.col("node").alias(col), F.col("to").alias("_to"))
            return df.join(by, col, "left").withColumn(col, F.coalesce("_to", col)).drop("_to")

        labels = parent.select(F.col("node").alias("doc"), F.col("to").alias("comp")) if labels is None else \
            lifted(labels, "comp").unionByName(
                parent.select(F.col("node").alias("doc"), F.col("to").alias("comp"))
                .join(labels.select("doc"), "doc", "left_anti"))
        labels = stored(labels, "labels")
        edges = stored(lifted(lifted(edges, "a"), "b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    if labels is None:
        return spark.createDataFrame([], "doc long, comp long")
    roots = labels.select(F.col("comp").alias("doc"), "comp").distinct()
    return labels.unionByName(roots.join(labels.select("doc"), "doc", "left_anti"))


# --- the join ----------------------------------------------------------------------------------

def _shared_only(rows: DataFrame) -> DataFrame:
    """Rows ``token, doc, n`` whose token has two documents and whose document has enough."""
    lists = rows.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token")
    rows = rows.join(lists, "token", "left_semi")
    enough = rows.groupBy("doc").agg(F.count("*").alias("c"), F.max("n").alias("n")).filter(
        F.col("c") >= _demand(F.col("n"))).select("doc")
    return stored(rows.join(enough, "doc", "left_semi"), "shared-prefixes")


def star_pairs(rows: DataFrame) -> DataFrame:
    """Each document with the head of a list that it meets most often.

    A list's head is its most central document, the one with the largest share of its
    prefix in lists: near copies with few edits of their own link most of their group.
    """
    size = F.max("n")
    base = size - _least_overlap(size)
    central = rows.groupBy("doc").agg((F.count("*") / F.least(
        size, base + 1 + F.greatest(F.lit(32), _div(size, 12)))).alias("share"))
    heads = rows.join(central, "doc").groupBy("token").agg(
        F.max(F.struct("share", (-F.col("doc")).alias("last")))["last"].alias("last"))
    met = (rows.join(heads.select("token", (-F.col("last")).alias("head")), "token").filter("doc <> head")
           .groupBy("doc", "head").agg(F.count("*").alias("c")))
    return met.groupBy("doc").agg(F.max(F.struct("c", (-F.col("head")).alias("h"))).alias("best")).select(
        F.col("doc").alias("x"), (-F.col("best.h")).alias("y"))


class _Roots(dict):
    """Components joined in a task."""

    def find(self, x: int) -> int:
        while self.get(x, x) != x:
            self[x] = x = self.get(self[x], self[x])
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)
        return x != y


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by AND and popcount over bit matrices of the
    hashes that both sides hold (within one list: that two sets hold), so many columns at a time."""
    out = np.zeros((len(left), len(right)), np.int64)
    if not left or not right:
        return out
    if left is right:
        tokens, count = np.unique(np.concatenate(left), return_counts=True)
        both = tokens[count > 1]
    else:
        both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    sides = []
    for sets in (left, right):
        of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        tokens = np.concatenate(sets)
        at = np.minimum(np.searchsorted(both, tokens), max(0, len(both) - 1))
        held = both[at] == tokens if len(both) else np.zeros(len(tokens), bool)
        order = np.argsort(at[held], kind="stable")
        sides.append((at[held][order], of[held][order], len(sets)))
    for first in range(0, len(both), COLUMNS):
        bits = []
        for at, of, rows in sides:
            a, b = np.searchsorted(at, [first, first + COLUMNS])
            m = np.zeros((rows, COLUMNS), bool)
            m[of[a:b], at[a:b] - first] = True
            bits.append(np.packbits(m, axis=1).view(np.uint64))
        for row in np.flatnonzero(bits[0].any(axis=1)):
            out[row] += np.bitwise_count(bits[0][row] & bits[1]).sum(axis=1, dtype=np.int64)
    return out


def _block_links(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Links that join components, between the two sides of a pair of blocks (or within one)."""
    side = rows.column("side").to_numpy()
    doc, comp, n = (rows.column(c).to_numpy() for c in ("doc", "comp", "n"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("hashes")]
    one = key[2].as_py() == key[3].as_py() and not key[1].as_py()
    left = np.arange(len(doc)) if one else np.flatnonzero(side == 0)
    right = left if one else np.flatnonzero(side == 1)
    own = [sets[i] for i in left]
    shared = overlaps(own, own if one else [sets[i] for i in right])
    linked = 7 * shared >= 3 * (n[left][:, None] + n[right][None, :])
    linked &= comp[left][:, None] != comp[right][None, :]
    roots, x, y = _Roots(), [], []
    for i, j in zip(*np.nonzero(linked)):
        if roots.join(int(comp[left[i]]), int(comp[right[j]])):
            x.append(int(doc[left[i]]))
            y.append(int(doc[right[j]]))
    return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})


def group_links(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """``x, y``: links between the components of each group, enough of them to join what links.
    ``placed``: ``doc, n, comp, grp``.

    A group's largest component is only compared with the others.  Both are cut into blocks of at most
    ``BLOCK_DOCS`` documents and ``BLOCK_HASHES`` hashes on average; a task compares two blocks by
    bit matrices, and only links leave it: a document is sent once per opposite block."""
    held = placed.groupBy("grp", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    largest = F.max(F.struct("c", "comp", "s"))
    per = held.groupBy("grp").agg(largest.alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s")).filter("c > top.c")
    blocks = lambda c, s: F.ceil(F.greatest(c / BLOCK_DOCS, s / BLOCK_HASHES)).cast("int")
    per = stored(per.select("grp", F.col("top.comp").alias("major"), blocks(F.col("top.c"), F.col("top.s")).alias("majors"),
                            blocks(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("minors")), "group-blocks")
    at = placed.join(per, "grp").withColumn("big", F.col("comp") == F.col("major")).withColumn(
        "own", F.pmod(F.xxhash64("doc"), F.when(F.col("big"), F.col("majors")).otherwise(F.col("minors"))).cast("int"))
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    task = lambda big, a, b, side: F.struct(F.lit(big).alias("big"), a.alias("a"), b.alias("b"), side.alias("side"))
    own = F.col("own")
    with_minor = F.transform(every("minors"), lambda j: task(
        False, F.least(own, j), F.greatest(own, j), F.when(own <= j, 0).otherwise(1)))
    with_major = F.transform(every("majors"), lambda j: task(True, own, j, F.lit(0)))
    to_minor = F.transform(every("minors"), lambda j: task(True, j, own, F.lit(1)))
    sent = at.select("grp", "doc", "comp", "n", F.inline(F.when(F.col("big"), to_minor).otherwise(
        F.concat(with_minor, with_major))))
    ship_package(sets.sparkSession)
    return (sent.join(sets.select("doc", "hashes"), "doc").groupBy("grp", "big", "a", "b")
            .applyInArrow(_block_links, "x long, y long"))


def near_misses(rows: DataFrame, sets: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that may link with another component, and their hashes: ``doc, n, comp`` and ``token, doc``.

    They share enough prefix hashes with other components, and of their whole sets other components hold
    as many hashes as any link needs: a passage that many documents share does not bring them here."""
    placed = rows.join(comps, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    mixed = lambda df: df.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter(
        "lo < hi").select("token")
    enough = stored(placed.join(mixed(placed), "token", "left_semi").groupBy("doc", "comp").agg(
        F.count("*").alias("c"), F.max("n").alias("n")).filter(F.col("c") >= _demand(F.col("n")))
        .select("doc", "comp", "n"), "candidates")
    tokens = stored(unpacked(sets.join(enough.select("doc", "n"), "doc")).drop("n").join(enough, "doc"), "candidate-tokens")
    docs = stored(tokens.join(mixed(tokens), "token", "left_semi").groupBy("doc", "comp", "n").agg(F.count("*").alias("most"))
                  .filter(F.col("most") >= _least_overlap(F.col("n"))).select("doc", "n", "comp"), "near-misses")
    return docs, stored(tokens.select("token", "doc").join(docs.select("doc"), "doc", "left_semi"), "near-tokens")


def cross_pairs(placed: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pairs of different groups that share enough of their adaptive prefixes.  ``placed``: ``doc, n, grp``."""
    tokens = stored(tokens.join(placed.select("doc", "n", F.col("grp").alias("comp")), "doc"), "group-tokens")
    lists = tokens.groupBy("token").agg(F.count("*").alias("df"), (F.min("comp") < F.max("comp")).alias("mixed"))
    ordered = tokens.join(lists, "token").withColumn(
        "pos", F.row_number().over(Window.partitionBy("doc").orderBy("df", "token")) - 1)
    base = F.col("n") - _least_overlap(F.col("n"))
    own = Window.partitionBy("doc")
    cost = F.sum(F.when((F.col("pos") <= base) & (F.col("df") > 1), F.col("df")).otherwise(0)).over(own)
    # a costly prefix is lengthened over the short lists that follow it (up to 1/5 of the
    # set): each costs little and demands one more shared hash; long lists are left out,
    # as meeting them would cost more than verifying the candidates
    short = F.sum((F.col("df") <= COST).cast("int")).over(own)
    longer = F.greatest(F.lit(0), F.least(_div(F.col("n"), 5), _least_overlap(F.col("n")) - 1, short - base - 1))
    # no overlap with another component exceeds the hashes that other components hold
    most = F.sum(F.col("mixed").cast("int")).over(own)
    prefixes = ordered.withColumn("l", F.when(cost > COST, longer).otherwise(0) + 1).withColumn("most", most)
    prefixes = stored(prefixes.filter(F.col("mixed") & (F.col("pos") < base + F.col("l"))
                                      & (F.col("most") >= _least_overlap(F.col("n"))))
                      .select("token", "doc", "comp", "n", "pos", "l", "most"), "adaptive-prefixes")
    # of each list the members of its largest component, and the others
    held = prefixes.groupBy("token", "comp").agg(F.count("*").alias("c"))
    major = held.groupBy("token").agg(F.max(F.struct("c", "comp"))["comp"].alias("major"),
                                      F.count("*").alias("k")).filter("k > 1").select("token", "major")
    lists = stored(prefixes.join(major, "token").withColumn("minor", F.col("comp") != F.col("major")), "mixed-lists")
    a = lists.filter("minor").select("token", *(F.col(c).alias(f"{c}_a") for c in ("doc", "comp", "n", "pos", "l", "most")))
    b = lists.select("token", "minor", *(F.col(c).alias(f"{c}_b") for c in ("doc", "comp", "n", "pos", "l", "most")))
    overlap = _div(3 * (F.col("n_a") + F.col("n_b")) + 6, 7)
    demand = F.least("l_a", "l_b")
    met = a.join(b, "token").filter(
        (F.col("comp_a") != F.col("comp_b")) & (~F.col("minor") | (F.col("doc_a") > F.col("doc_b")))
        & (4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b")) & (overlap <= F.least("most_a", "most_b"))
        & (F.col("pos_a") < F.col("n_a") - overlap + demand) & (F.col("pos_b") < F.col("n_b") - overlap + demand))
    # a pair's sides may change roles from list to list
    return (met.groupBy(F.greatest("doc_a", "doc_b").alias("x"), F.least("doc_a", "doc_b").alias("y"))
            .agg(F.count("*").alias("c"), F.max(demand).alias("demand")).filter("c >= demand").select("x", "y"))


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    docs = _docs(docs, id_col, text_col)
    found = stored(scanned(docs), "set-prefixes")
    classes = stored(found.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc").alias("rep")), "set-classes")
    reps = classes.filter("rep is not null").select(F.col("rep").alias("doc"), "n")

    # one shuffle both counts a hash's documents and keeps its rows (a join would emit twice)
    held = F.count("*").over(Window.partitionBy("token"))
    rows = stored(unpacked(found.filter("hashes is not null").join(reps, ["doc", "n"], "left_semi"))
                  .withColumn("held", held).filter("held > 1").drop("held"), "prefixes")
    for _ in range(PRUNES):
        rows = _shared_only(rows)

    near = rows.select("doc").distinct()
    sets = stored(whole_sets(docs.join(near, "doc", "left_semi").dropDuplicates(["doc", "text"])), "near-sets")
    stars = stored(verified(star_pairs(rows), sets), "star-links")
    apart, tokens = near_misses(rows, sets, components(stars))
    # near misses around the same central document are a group
    heads = star_pairs(rows.join(apart.select("doc"), "doc", "left_semi"))
    placed = stored(apart.join(components(heads).select("doc", F.col("comp").alias("grp")), "doc", "left")
                    .withColumn("grp", F.coalesce("grp", "doc")), "grouped-documents")
    within = stored(group_links(placed, sets), "group-links")
    crossed = stored(verified(cross_pairs(placed, tokens), sets), "cross-links")
    comps = components(stars.unionByName(within).unionByName(crossed))

    found = found.drop("hashes")
    members = found.join(classes, ["d1", "d2", "n"], "left")
    return (members.join(comps.withColumnRenamed("doc", "rep"), "rep", "left")
            .select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("doc").isNotNull(), F.coalesce("comp", "rep", "doc")).alias("component_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document per component: the one whose id is the component's.
    Rows that repeat that id stay or go together; rows without an id stay."""
    kept = linked_components(docs).filter("doc_id = component_id").select("doc_id").distinct()
    rest = docs.filter("doc_id is null")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(rest)
