"""Sparse top-k over impact-ordered posting blocks (#69).

Postings are rows ``(doc_id, term, weight)``, queries rows ``(query_id, term, qweight)``; a score is
the inner product.  ``within`` columns (such as a shop) belong to the term on both sides, so a
query only meets postings of its own shop.

Spark keeps the postings that some query asks for and deals them by document.  A task
cuts its documents into slices of at most ``SLICE`` postings.  In a slice, each term's postings are ordered by
weight and cut into blocks of ``BLOCK``, whose first weight bounds the block.  A query takes the blocks of all
its terms in order of what they can add, and stops as soon as the best blocks left, one per term,
sum to less than the k-th best score so far: what it has not met by then cannot get in, and what it
has met is only finished if its own score plus that sum reaches.  The k best of a task leave it, and a
window of k rows per query ends the ranking.  So the rows between stages are k per query and task, whatever the number
of documents that share a term with a query.

Queries are a stated set: they go to the tasks in chunks of at most ``CHUNK_TERMS`` rows.  Weights may
have any sign; where a query's products in a slice are not all positive, it is scored there without skipping.
Repeated rows add up; null terms and weights are left out, null ids too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.session import arrow_map, stored

#: Postings of a slice, and of a block.
SLICE, BLOCK = 1 << 20, 128
#: Rows of the queries that are searched together.
CHUNK_TERMS = 200_000
#: Scores are rounded to this many places before they are ranked: a float sum depends on the order of
#: its terms, and exact copies of a document must tie.  Bounds are loosened by as much.
PLACES, SLACK = 9, 1e-8


class Postings:
    """The lists of a slice: for each term its documents by weight, and by number."""

    def __init__(self, doc_ids: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.ids, ords = np.unique(doc_ids, return_inverse=True)
        key = terms.astype(np.int64) * len(self.ids) + ords
        key, at = np.unique(key, return_inverse=True)
        weight = np.bincount(at, weights, len(key))
        term, ords = key // max(1, len(self.ids)), key % max(1, len(self.ids))
        present, starts = np.unique(term, return_index=True)
        self.by_doc = {t: (ords[a:b], weight[a:b]) for t, a, b in
                       zip(present.tolist(), starts, np.append(starts[1:], len(term)))}
        self.by_impact = {}
        for t, (o, w) in self.by_doc.items():
            order = np.argsort(-w, kind="stable")
            self.by_impact[t] = o[order], w[order]

    def exact(self, docs: np.ndarray, query: list[tuple[int, float]]) -> np.ndarray:
        """Scores of documents, summed in the query's order of terms, so that copies get equal sums."""
        out = np.zeros(len(docs))
        for term, qweight in query:
            if term in self.by_doc:
                ords, weight = self.by_doc[term]
                at = np.minimum(np.searchsorted(ords, docs), len(ords) - 1)
                out += np.where(ords[at] == docs, qweight * weight[at], 0.0)
        return np.round(out, PLACES)


def met(postings: Postings, query: list[tuple[int, float]], k: int, floor: float) -> tuple[np.ndarray, int]:
    """Documents of a slice that may score ``floor`` or be among its own k best, and how many
    postings were read to know."""
    lists = [(qweight, *postings.by_impact[term]) for term, qweight in query if term in postings.by_impact]
    if any(q <= 0 or w[-1] <= 0 for q, _, w in lists):
        every = [o for _, o, _ in lists]
        return np.unique(np.concatenate(every)), sum(map(len, every))
    score = np.zeros(len(postings.ids))
    seen = np.zeros(len(postings.ids), bool)
    blocks = sorted(((-q * w[at], number, at) for number, (q, _, w) in enumerate(lists) for at in range(0, len(w), BLOCK)))
    left = [q * w[0] for q, _, w in lists]  # what a term can still add to a document not met in it
    rest, read, turn = sum(left), 0, max(4, len(lists) // 2)
    for step, (_, number, at) in enumerate(blocks):
        if step % turn == 0:
            if np.count_nonzero(seen) >= k:
                floor = max(floor, np.partition(score, len(score) - k)[len(score) - k])
            if rest < floor - SLACK:
                break
        qweight, ords, weight = lists[number]
        own = ords[at:at + BLOCK]
        score[own] += qweight * weight[at:at + BLOCK]
        seen[own] = True
        read += len(own)
        after = qweight * weight[at + BLOCK] if at + BLOCK < len(weight) else 0.0
        rest, left[number] = rest - left[number] + after, after
    else:
        rest = 0.0
    return np.flatnonzero(seen & (score + rest >= floor - SLACK)), read


class _Best:
    """The k best documents of a query so far: by score, then id."""

    def __init__(self, k: int):
        self.k, self.rows, self.floor = k, [], -np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        self.rows = sorted(self.rows + list(zip((-scores).tolist(), ids.tolist())))[:self.k]
        if len(self.rows) == self.k:
            self.floor = -self.rows[-1][0]


def _slices(batches, vocabulary: pa.Array) -> Iterator[Postings]:
    """Slices of postings that arrive ordered by document; a document stays whole."""
    def close(rows: pa.Table) -> Postings:
        number = pc.index_in(rows.column("term"), value_set=vocabulary)
        known = pc.is_valid(number)
        rows, number = rows.filter(known), number.filter(known)
        return Postings(rows.column("doc_id").to_numpy(), number.to_numpy(), rows.column("weight").to_numpy())

    held, count = [], 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count >= SLICE:
            rows = pa.concat_tables(held)
            ids = rows.column("doc_id").to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))  # the last document may go on
            if cut:
                yield close(rows.slice(0, cut))
            held, count = [rows.slice(cut)], len(ids) - cut
    if count:
        yield close(pa.concat_tables(held))


def _search(queries: list[tuple], vocabulary: list[str], k: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in queries]
        for postings in _slices(batches, pa.array(vocabulary, pa.string())):
            for own, (_, query) in zip(best, queries):
                docs, _ = met(postings, query, k, own.floor)
                if len(docs):
                    own.add(postings.ids[docs], postings.exact(docs, query))
        rows = [(query_id, doc, -score) for (query_id, _), own in zip(queries, best) for score, doc in own.rows]
        if rows:
            ids, docs, scores = zip(*rows)
            yield pa.record_batch([pa.array(ids), pa.array(docs, pa.int64()), pa.array(scores)],
                                  names=["query_id", "doc_id", "score"])
    return run


def sparse_top_k(query_terms: DataFrame, postings: DataFrame, k: int = 10, within: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, doc_id, score, rank``: the k documents of each query with the largest inner product.

    Ids of documents are integers; those of queries may be of any plain type."""
    term = lambda: F.concat_ws("\u0000", *[F.col(c).cast("string") for c in (*within, "term")]).alias("term")
    key = [*within, "term"]
    asked = stored(query_terms.dropna(subset=["query_id", "qweight", *key]).groupBy("query_id", term())
                   .agg(F.sum(F.col("qweight").cast("double")).alias("qweight")), "asked-terms")
    held = (postings.dropna(subset=["doc_id", "weight", *key])
            .select(F.col("doc_id").cast("long").alias("doc_id"), term(), F.col("weight").cast("double").alias("weight"))
            .join(asked.select("term").distinct(), "term", "left_semi"))
    chunks = -(-asked.count() // CHUNK_TERMS)
    if chunks > 1:
        held = stored(held, "asked-postings")
    dealt = held.repartition("doc_id").sortWithinPartitions("doc_id")
    kind = asked.schema["query_id"].dataType.simpleString()
    found = None
    for chunk in range(max(1, chunks)):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, chunks))) == chunk).collect()
        vocabulary = sorted({r["term"] for r in rows})
        number = {t: i for i, t in enumerate(vocabulary)}
        queries: dict = {}
        for r in sorted(rows, key=lambda r: r["term"]):
            queries.setdefault(r["query_id"], []).append((number[r["term"]], r["qweight"]))
        best = arrow_map(dealt, _search(list(queries.items()), vocabulary, k), f"query_id {kind}, doc_id long, score double")
        found = best if found is None else found.unionByName(best)
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
