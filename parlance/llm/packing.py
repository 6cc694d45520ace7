"""Sequence packing as a cutting-stock problem solved by column generation.

1. Every document becomes its token ids and an end id, cut into pieces of ``limit`` ids
   and a rest.  The rest is cut once more, at the last multiple of ``UNIT``, so that the
   stock holds both unit multiples and short tails and nearly every sequence can be
   filled whatever the documents' lengths are.  The cuts depend on the document alone:
   ids are made and digested in one pass and never shuffled.
2. The lengths of the pieces form a histogram of at most ``len(grid(limit))`` types.
3. On the driver, over that bounded histogram only: the linear program "fewest sequences
   that hold all counts" is solved by column generation.  A knapsack dynamic program over
   the duals prices new patterns.  Multiplicities are rounded down, and what remains (a
   bounded number of pieces per type) is packed by best fit.
4. Every piece gets its rank within its type by a two-level count; type and rank name the
   pattern, its copy and so the sequence.  Offsets are running sums within a sequence.

Defined results: a null or empty text is the end id alone; repeated rows are packed each
on its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import arrow_map, slices, stored
from parlance.llm.words import word_ids

LIMIT = 2048
END_ID = 1
#: Grain of the second cut.
UNIT = 128
#: Pieces that share one bucket of the two-level rank, on average, and buckets at least.
BUCKET_ROWS, BUCKETS = 20_000, 64
#: Pivots at most; every basis on the way is a valid packing.
PIVOTS = 4000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def grid(limit: int = LIMIT) -> np.ndarray:
    """The lengths that pieces have: below ``UNIT`` any, from there multiples (and ``limit``)."""
    return np.array([*range(1, min(UNIT, limit)), *range(UNIT, limit, UNIT), limit])


def cuts(total: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids."""
    out = [(at, limit) for at in range(0, total - limit + 1, limit)]
    at = len(out) * limit
    whole = (total - at) // UNIT * UNIT
    return out + [(s, n) for s, n in ((at, whole), (at + whole, total - at - whole)) if n]


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document: place, length and CRC-32 of its ids."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tokenizer = word_ids(path)
        for part in slices(batches):
            rows: list[tuple] = []
            texts = [t or "" for t in part.column(1).to_pylist()]
            for doc, ids in zip(part.column(0).to_pylist(), tokenizer.ids(texts)):
                ids += end
                total = len(ids) // 4
                rows += [(doc, at, n, zlib.crc32(ids[4 * at:4 * (at + n)]), total) for at, n in cuts(total, limit)]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .transform(arrow_map, run, PIECES))


# --- the bounded problem on the driver: types x capacity --------------------------------

def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value and last item for every capacity (unbounded knapsack)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fit = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    for c in range(fit.index(1) if 1 in fit else int(sizes[0]), capacity + 1):
        n = fit[c]
        gain = best[c - sizes[:n]] + values[:n]
        i = gain.argmax()
        if gain[i] > 0:
            best[c], last[c] = gain[i], i
    return best, last


def _pattern(sizes: np.ndarray, last: np.ndarray, first: int, capacity: int) -> np.ndarray:
    a, c = np.zeros(len(sizes)), capacity - sizes[first]
    a[first] = 1
    while c > 0 and last[c] >= 0:
        a[last[c]] += 1
        c -= sizes[last[c]]
    return a


def column_generation(sizes: np.ndarray, counts: np.ndarray, capacity: int,
                      gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and their multiplicities in the linear program.  Ends within
    ``gap`` of the bound that the priced duals give, or of the ids' own volume."""
    m = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / columns.diagonal())
    x = inverse @ counts
    pivots, volume = 0, float(sizes @ counts) / capacity
    while pivots < PIVOTS and x.sum() > (1 + gap) * volume:
        duals = inverse.sum(axis=0)
        best, last = knapsack(sizes, duals, capacity)
        value = duals + best[capacity - sizes]
        order = np.argsort(-value)
        if value[order[0]] <= 1 + gap:
            break
        moved = False
        for first in order[:16]:
            if value[first] <= 1 + gap:
                break
            a = _pattern(sizes, last, first, capacity)
            if inverse.sum(axis=0) @ a <= 1 + gap / 2:
                continue  # a pivot of this round has priced it out
            d = inverse @ a
            up = np.flatnonzero(d > 1e-9)
            ratio = x[up] / d[up]
            out = up[int(ratio.argmin())]
            row = inverse[out] / d[out]
            inverse -= np.outer(d, row)
            inverse[out] = row
            columns[:, out] = a
            x = np.maximum(inverse @ counts, 0)
            pivots += 1
            moved = True
        if not moved:
            break
    return columns, x


def best_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """Best-fit decreasing over the pieces that rounding left."""
    bins: list[dict[int, int]] = []
    room: list[tuple[int, int]] = []
    for i in range(len(sizes) - 1, -1, -1):
        for _ in range(int(counts[i])):
            at = bisect.bisect_left(room, (int(sizes[i]), -1))
            if at < len(room):
                left, b = room.pop(at)
            else:
                left, b = capacity, len(bins)
                bins.append({})
            bins[b][i] = bins[b].get(i, 0) + 1
            bisect.insort(room, (left - int(sizes[i]), b))
    return bins


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(copies, {type: pieces}) patterns that together hold exactly ``counts``."""
    have = np.flatnonzero(counts)
    if not len(have):
        return []
    s, b = sizes[have], counts[have].astype(float)
    columns, x = column_generation(s, b, capacity)
    left, out = counts[have].copy(), []
    for p in np.argsort(-x):
        a = columns[:, p].astype(int)
        on = a > 0
        copies = min(int(x[p] + 1e-6), int((left[on] // a[on]).min()))
        if copies > 0:
            left -= copies * a
            out.append((copies, {int(have[i]): int(a[i]) for i in np.flatnonzero(on)}))
    out += [(1, {int(have[i]): n for i, n in bin_.items()}) for bin_ in best_fit(s, left, capacity)]
    return out


# --- back on Spark ------------------------------------------------------------------------

def assign(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``sequence_id`` and ``offset`` for a stored table of pieces."""
    sizes = grid(limit)
    number = (F.when(F.col("length") == limit, len(sizes) - 1).when(F.col("length") < UNIT, F.col("length") - 1)
              .otherwise(UNIT - 2 + F.floor(F.col("length") / UNIT)))
    typed = cut.withColumn("type", number.cast("int"))
    found = {r["type"]: r["n"] for r in typed.groupBy("type").agg(F.count("*").alias("n")).collect()}
    counts = np.array([found.get(i, 0) for i in range(len(sizes))])
    total = int(counts.sum())

    # piece k of a type: the interval of ranks, its pattern, pieces per copy, first sequence
    spans: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    used, sequence = np.zeros(len(sizes), np.int64), 0
    for copies, pattern in plan(sizes, counts, limit):
        for t, a in pattern.items():
            spans[t].append((int(used[t]), a, sequence))
            used[t] += copies * a
        sequence += copies
    table = [np.array(s, np.int64).reshape(-1, 3) for s in spans]

    buckets = max(BUCKETS, total // BUCKET_ROWS)
    placed = typed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    sums = placed.groupBy("type", "bucket").agg(F.count("*").alias("n"))
    before = sums.select("type", "bucket", (F.sum("n").over(
        Window.partitionBy("type").orderBy("bucket")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("type", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    ranked = (placed.withColumn("local", local).join(before, ["type", "bucket"])
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "type",
                      (F.col("before") + F.col("local") - 1).alias("rank")))

    def place(batches):
        for batch in batches:
            kind, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (5, 6))
            seq = np.empty(len(kind), np.int64)
            for t in np.unique(kind):
                own, spans_t = kind == t, table[t]
                at = np.searchsorted(spans_t[:, 0], rank[own], side="right") - 1
                seq[own] = spans_t[at, 2] + (rank[own] - spans_t[at, 0]) // spans_t[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq)], [*batch.schema.names, "sequence_id"])

    in_order = Window.partitionBy("sequence_id").orderBy(F.desc("type"), "rank")
    return (ranked.transform(arrow_map, place, PIECES + ", type int, rank long, sequence_id long")
            .withColumn("offset", F.sum("length").over(in_order) - F.col("length"))
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))


def pack(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return assign(stored(pieces(docs, path, limit, end_id, id_col, text_col), "pieces"), limit)
