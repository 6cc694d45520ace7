"""Ranked lexical search: MaxScore with bounds on pairs of terms.

The items (queries) are cut into chunks of bounded vocabulary; for each chunk:

1. **Postings.** Tasks that read the documents cut them into blocks of at most ``BLOCK`` documents and
   ``POSTINGS`` postings.  Texts are read once; a block is one row of a table in the shared folder.
2. **Statistics.** Documents, terms and document frequencies are sums over that table and
   give the weight of every term of the chunk's vocabulary.
3. **Index.** Every posting becomes its impact, an integer.  Each block keeps the largest impact of a
   term and, for the pairs of terms that the items are made of, the *intersection list*: the
   documents that hold both, with the largest joint impact.
4. **Search.** A task goes through its blocks with one running top-k per item.  Lists are added
   heaviest first until the bound of the rest is less than the k-th best score: the rest is cut
   into pairs and single terms at least cost, a pair counting its joint maximum (or the larger
   single one), not the sum of both.  From there only documents met so far can get in; each has
   its own bounds (a pair's joint maximum only inside its intersection list) and is dropped as soon
   as they fall short.
5. **Merge.** At most k rows per item leave a task; a window of k rows ends the ranking.

Skipping is safe: a document is dropped only if its bound is below a score that k documents
reach, so equal scores are kept for the tie by id.

Defined results: a null or empty text has no terms, is no candidate and does not count into N or L; an
item without terms gives no rows; rows that repeat an item id ask for the terms of all of them
together, a null id being an id of its own; rows that repeat a document id are ranked
one by one; a null document id comes after the others of its score; empty tables give an empty
result; other columns are ignored.  Texts of any length are counted whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import arrow_map, slices, stored
from parlance.llm.terms import terms

#: Documents and postings of a block, whichever comes first.
BLOCK, POSTINGS = 4096, 1 << 20
#: Terms (with repeats over items) of the items that are searched together.
CHUNK_TERMS = 200_000

_POSTINGS = ("doc_ids array<long>, lengths array<long>, terms array<int>, starts array<int>, ords array<int>, "
             "tfs array<long>")
_INDEX = ("doc_ids array<long>, terms array<int>, starts array<int>, ords array<int>, impacts array<long>, "
          "pairs array<int>, pair_starts array<int>, pair_ords array<int>, pair_max array<long>")


def _rows(columns: dict, types: list) -> pa.RecordBatch:
    """One row of array columns."""
    return pa.record_batch([pa.array([v], pa.list_(t)) for v, t in zip(columns.values(), types)], names=list(columns))


# -- 1. postings ---------------------------------------------------------------------------

def _block(ids: list, lengths: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
    """The postings of a block from the vocabulary numbers that its documents hold."""
    term, tf, ords = [], [], []
    for at, held in enumerate(found):
        t, n = np.unique(held, return_counts=True)
        term.append(t)
        tf.append(n)
        ords.append(np.full(len(t), at))
    term, tf, ords = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (term, tf, ords))
    order = np.argsort(term, kind="stable")
    present, starts = np.unique(term[order], return_index=True)
    return _rows({"doc_ids": ids, "lengths": lengths, "terms": present, "starts": np.append(starts, len(order)),
                  "ords": ords[order], "tfs": tf[order]},
                 [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()])


def _post(vocabulary: dict[bytes, int], block: int, postings: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        ids, lengths, found, held = [], [], [], 0
        for part in slices(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                words = terms(text.as_py())
                if not words:
                    continue
                ids.append(doc_id)
                lengths.append(len(words))
                found.append(np.array([vocabulary[w] for w in words if w in vocabulary], np.int64))
                held += min(len(found[-1]), len(vocabulary))
                if len(ids) >= block or held >= postings:
                    yield _block(ids, lengths, found)
                    ids, lengths, found, held = [], [], [], 0
        if ids:
            yield _block(ids, lengths, found)
    return run


# -- 2. statistics -------------------------------------------------------------------------

def _statistics(blocks: DataFrame, vocabulary: int) -> tuple[int, int, list[int]]:
    """N, L and the weight of every term of the chunk (a bounded table)."""
    total = blocks.agg(F.coalesce(F.sum(F.size("lengths")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.aggregate(
        "lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("l")).first()
    own = F.transform("terms", lambda t, i: F.struct(t.alias("term"), (
        F.get("starts", i + 1) - F.get("starts", i)).cast("long").alias("n")))
    weight = [0] * vocabulary
    for r in blocks.select(F.inline(own)).groupBy("term").agg(F.sum("n").alias("df")).collect():
        weight[r["term"]] = math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * r["df"] + 1)))
    return total["n"], total["l"], weight


# -- 3. index ------------------------------------------------------------------------------

def in_order(wanted: list[int], weight: list[int]) -> list[int]:
    """An item's terms, the heaviest first.  Its pairs are the neighbours in this order: heavy
    terms seldom meet, so a pair's joint maximum is far below the sum of the single ones."""
    return sorted(wanted, key=lambda t: (-weight[t], t))


def pairs_of(wanted: list[int], weight: list[int]) -> list[tuple[int, int]]:
    order = in_order(wanted, weight)
    return [(min(p), max(p)) for p in zip(order, order[1:])]


def _impacts(doc_terms: dict, n: int, total: int, weight: np.ndarray) -> np.ndarray:
    """Impact of every posting; the length part is in Python's integers, which don't overflow."""
    m = np.array([100 - 50 + 50 * x * n // total for x in doc_terms["lengths"].tolist()], np.int64)[doc_terms["ords"]]
    tf = doc_terms["tfs"]
    per_term = np.repeat(weight[doc_terms["terms"]], np.diff(doc_terms["starts"]))
    return per_term * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def _intersections(block: dict, pairs: np.ndarray) -> tuple[list, list, list, list]:
    """Number, start, documents and joint maximum of every pair that meets in a block."""
    place = {t: i for i, t in enumerate(block["terms"].tolist())}
    starts, ords, impacts = block["starts"], block["ords"], block["impacts"]
    numbers, at, docs, most = [], [0], [], []
    for number, (a, b) in enumerate(pairs.tolist()):
        i, j = place.get(a), place.get(b)
        if i is None or j is None:
            continue
        both, x, y = np.intersect1d(ords[starts[i]:starts[i + 1]], ords[starts[j]:starts[j + 1]],
                                    assume_unique=True, return_indices=True)
        if len(both):
            numbers.append(number)
            docs.append(both)
            at.append(at[-1] + len(both))
            most.append(int((impacts[starts[i] + x] + impacts[starts[j] + y]).max()))
    return numbers, at, np.concatenate(docs) if docs else [], most


def _arrays(batches) -> Iterator[dict]:
    """Each row's array columns as numpy arrays; ids with nulls stay an Arrow array."""
    for batch in batches:
        for row in range(batch.num_rows):
            own = {name: batch.column(c)[row].values for c, name in enumerate(batch.schema.names)}
            yield {k: v if k == "doc_ids" else v.to_numpy(zero_copy_only=False) for k, v in own.items()}


def _index(n: int, total: int, weight: list[int], pairs: list[tuple[int, int]]):
    heavy, both = np.array(weight, np.int64), np.array(pairs, np.int64).reshape(-1, 2)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for block in _arrays(batches):
            block["impacts"] = _impacts(block, n, total, heavy)
            numbers, at, docs, most = _intersections(block, both)
            yield _rows({"doc_ids": block["doc_ids"], "terms": block["terms"], "starts": block["starts"],
                         "ords": block["ords"], "impacts": block["impacts"], "pairs": numbers, "pair_starts": at,
                         "pair_ords": docs, "pair_max": most},
                        [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(),
                         pa.int64()])
    return run


# -- 4. search -----------------------------------------------------------------------------

class Block:
    """A block of the index with its maxima."""

    def __init__(self, columns: dict):
        self.ids = columns["doc_ids"]
        self.size = len(self.ids)
        starts, ords, impacts = columns["starts"], columns["ords"], columns["impacts"]
        most = np.maximum.reduceat(impacts, starts[:-1]) if len(impacts) else impacts
        self.lists = {t: (ords[a:b], impacts[a:b], int(m)) for t, a, b, m in
                      zip(columns["terms"].tolist(), starts[:-1], starts[1:], most)}
        at = columns["pair_starts"]
        self.pairs = {p: (columns["pair_ords"][a:b], int(m)) for p, a, b, m in
                      zip(columns["pairs"].tolist(), at[:-1], at[1:], columns["pair_max"])}


class Unit:
    """One term, or two neighbours, with what they can add to a document's score: ``inside`` the
    pair's intersection list the joint maximum, ``outside`` the larger single one."""

    def __init__(self, lists: list[tuple], both: np.ndarray | None = None, joint: int = 0):
        self.lists, self.both = lists, both
        self.outside = max(m for _, _, m in lists)
        self.bound = max(joint, self.outside)

    def bounds(self, docs: np.ndarray) -> np.ndarray:
        """The most that this unit can add to each document."""
        if self.both is None or self.bound == self.outside:
            return np.full(len(docs), self.outside)
        return np.where(_among(self.both, docs)[1], self.bound, self.outside)

    def exact(self, docs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), np.int64)
        for ords, impacts, _ in self.lists:
            at, there = _among(ords, docs)
            out[there] += impacts[at[there]]
        return out


def combined(singles: list[Unit], pairs: list[Unit | None]) -> tuple[list[int], list[bool]]:
    """The least bound of every rest of the terms, and whether it pairs the first two of that rest.

    ``pairs[i]`` joins terms i and i + 1; a rest is cut into pairs and single terms at least cost."""
    rest, paired = [0] * (len(singles) + 2), [False] * len(singles)
    for i in range(len(singles) - 1, -1, -1):
        rest[i] = singles[i].bound + rest[i + 1]
        if i < len(pairs) and pairs[i] and pairs[i].bound + rest[i + 2] < rest[i]:
            rest[i], paired[i] = pairs[i].bound + rest[i + 2], True
    return rest, paired


def _among(ascending: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value would be, and whether it is there."""
    at = np.minimum(np.searchsorted(ascending, wanted), len(ascending) - 1)
    return at, ascending[at] == wanted


def search_block(block: Block, order: list[int], numbers: list[int], k: int,
                 floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents of a block that score ``floor`` or more, with their scores, and the number of
    postings and look-ups that took.  ``order`` holds the item's terms, ``numbers`` its pairs'.

    All documents of the block's own best k are among them."""
    singles, pairs = [], []
    for at, term in enumerate(order):
        if term not in block.lists:
            continue
        singles.append(Unit([block.lists[term]]))
        if at < len(numbers):
            after = block.lists.get(order[at + 1])
            pairs.append(after and Unit([block.lists[term], after], *block.pairs.get(numbers[at], (None, 0))))
    rest, paired = combined(singles, pairs)
    score, work, done = np.zeros(block.size, np.int64), 0, 0
    while done < len(singles) and rest[done] >= floor:
        (ords, impacts, _), = singles[done].lists
        score[ords] += impacts
        work, done = work + len(ords), done + 1
        if np.count_nonzero(score) >= k:
            floor = max(floor, int(np.partition(score, block.size - k)[block.size - k]))
    docs = np.flatnonzero(score)
    docs = docs[score[docs] + rest[done] >= floor]
    left = []
    while done < len(singles):
        left.append(pairs[done] if paired[done] else singles[done])
        done += 1 + paired[done]
    bounds = [u.bounds(docs) for u in left]
    own, most = score[docs], sum(bounds, np.zeros(len(docs), np.int64))
    for at, unit in enumerate(left):
        keep = own + most >= floor
        if not keep.all():
            docs, own, most = docs[keep], own[keep], most[keep]
            bounds = [b[keep] for b in bounds]
        if not len(docs):
            break
        own, most = own + unit.exact(docs), most - bounds[at]
        work += len(docs) * len(unit.lists)
        if len(docs) >= k:
            floor = max(floor, int(np.partition(own, len(docs) - k)[len(docs) - k]))
    keep = own >= floor
    return docs[keep], own[keep], work


class Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.rows: list[tuple] = []

    def add(self, ids: list, scores: list[int]) -> None:
        self.rows = sorted(self.rows + list(zip(scores, ids)), key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:self.k]
        if len(self.rows) == self.k:
            self.floor = self.rows[-1][0]


def _search(items: list, plans: list[tuple], k: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        for columns in _arrays(batches):
            block = Block(columns)
            for own, plan in zip(best, plans):
                docs, scores, _ = search_block(block, *plan, k, own.floor)
                if len(docs):
                    own.add(block.ids.take(pa.array(docs)).to_pylist(), scores.tolist())
        rows = [(item, doc, score) for item, own in zip(items, best) for score, doc in own.rows]
        if rows:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["item_id", "doc_id", "score"])
    return run


def plan(wanted: list[int], weight: list[int], numbers: dict[tuple, int]) -> tuple[list[int], list[int]]:
    """An item's terms in order and the numbers of its pairs."""
    return in_order(wanted, weight), [numbers[p] for p in pairs_of(wanted, weight)]


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], wanted: list[list[int]], block: int = BLOCK,
                postings: int = POSTINGS) -> tuple[DataFrame, list[int], dict[tuple, int]]:
    """The stored index of a frame ``doc_id, text``, the terms' weights and the pairs' numbers."""
    blocks = stored(arrow_map(docs, _post(vocabulary, block, postings), _POSTINGS), "search-postings")
    n, total, weight = _statistics(blocks, len(vocabulary))
    pairs = sorted({p for own in wanted for p in pairs_of(own, weight)})
    index = stored(arrow_map(blocks, _index(n, total, weight, pairs), _INDEX), "search-index")
    return index, weight, {p: i for i, p in enumerate(pairs)}


def _item_terms(batches) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows = [(i, w) for i, t in zip(part.column(0).to_pylist(), part.column(1)) for w in sorted(set(terms(t.as_py())))]
        yield pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.binary())],
                              names=["item_id", "term"])


def rank(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", chunk_terms: int = CHUNK_TERMS,
         block: int = BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents with a score above 0 of every item."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = stored(arrow_map(
        items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")),
        _item_terms, "item_id long, term binary").distinct(), "search-items")
    chunks = -(-asked.count() // chunk_terms)
    found = None
    for chunk in range(chunks):
        # the stated query set, a bounded part at a time
        own: dict = {}
        for r in asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == chunk).collect():
            own.setdefault(r["item_id"], []).append(bytes(r["term"]))
        vocabulary = {t: i for i, t in enumerate(sorted({t for terms_ in own.values() for t in terms_}))}
        wanted = [[vocabulary[t] for t in terms_] for terms_ in own.values()]
        index, weight, numbers = build_index(texts, vocabulary, wanted, block)
        plans = [plan(w, weight, numbers) for w in wanted]
        best = arrow_map(index, _search(list(own), plans, k), "item_id long, doc_id long, score long")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = items.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(
        F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
