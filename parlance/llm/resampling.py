"""Target-distribution importance resampling by bit-sliced aggregation.

A document's features are hashed to ``BUCKETS`` buckets.  A bucket's gain is the scaled,
smoothed log ratio of its share in the target texts to its share in the documents, an
integer.  A document's weight is the sum of ``count * gain`` over its buckets:

1. The counts of a document become planes of 10000 bits: plane i holds bit i of each
   bucket's count.  The gains become planes in two's complement, the last one negative.
2. The weight is the sum over pairs of planes of ``2**(i + j) * popcount(C[i] & G[j])``, exact
   in 64-bit integers: no product and no lookup per feature.
3. Every document gets a seeded Gumbel score; the highest ones are drawn (sampling without
   replacement in proportion to exp(weight / 1000)).

Spark counts buckets in the tasks that read the texts (at most ``BUCKETS`` rows leave a task),
sums them by bucket, and ships the gain planes (14 or so of 1.25 KB) with the second
pass.  Ranks come from range-partitioned narrow rows; texts are never shuffled.

Defined results: a null or empty text has no features and weight 0; without documents the
result is empty; without target texts t and T are 0; a null id scores as the empty string and
sorts last; rows that repeat an id score alike and share ranks in any order; other columns
are ignored.  Texts of any length are counted whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_map, slices, stored
from parlance.llm.ranks import ranked
from parlance.llm.terms import terms

BUCKETS = 10_000
#: Words of 64 bits in a plane.
_WORDS = -(-BUCKETS // 64)
#: Documents whose counts are held at once (a row of counts is 40 KB).
HELD = 128
#: Distinct features whose bucket a worker remembers.
CACHE = 1_000_000


class _Buckets(dict):
    """feature (bytes) -> bucket, remembered up to ``CACHE`` features."""

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[feature] = at = zlib.crc32(feature) % BUCKETS
        return at


def features(text: str | None, n: int) -> list[bytes]:
    """All runs of 1 to ``n`` consecutive words, joined by one space, repeats kept."""
    words = terms(text)
    out = list(words)
    for k in range(2, n + 1):
        out += [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]
    return out


def _count(text: str | None, n: int, buckets: _Buckets) -> np.ndarray:
    """The bucket of every feature of a text."""
    return np.fromiter(map(buckets.__getitem__, features(text, n)), np.int64)


def _tally(n: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        buckets, sums = _Buckets(), np.zeros(BUCKETS, np.int64)
        for part in slices(batches):
            for text in part.column(0):
                sums += np.bincount(_count(text.as_py(), n, buckets), minlength=BUCKETS)
        held = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(held.astype(np.int32)), pa.array(sums[held])], names=["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """``bucket, n``: features of all texts per bucket, at most ``BUCKETS`` rows."""
    each = arrow_map(texts.select(F.col(text_col).alias("text")), _tally(n), "bucket int, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame) -> list[int]:
    """A bounded table of ``BUCKETS`` counts on the driver."""
    out = [0] * BUCKETS
    for r in counts.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(own: list[int], target: list[int]) -> list[int]:
    """Gain of every bucket from the counts of the documents and of the target texts."""
    of_own, of_target = float(sum(own) + BUCKETS), float(sum(target) + BUCKETS)
    return [math.floor(1000 * math.log((float(t + 1) * of_own) / (float(s + 1) * of_target)))
            for s, t in zip(own, target)]


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of ``BUCKETS`` bits as rows of ``_WORDS`` 64-bit words."""
    packed = np.zeros((len(bits), _WORDS * 8), np.uint8)
    packed[:, :-(-BUCKETS // 8)] = np.packbits(bits.astype(bool), axis=1)
    return packed.view(np.uint64)


def gain_planes(gain: list[int]) -> tuple[np.ndarray, list[int]]:
    """Planes of the gains in two's complement and the power of two (signed) of each."""
    values = np.array(gain, np.int64)
    width = max(int(values.max()).bit_length(), int(-values.min() - 1).bit_length() if values.min() < 0 else 0) + 1
    planes = _packed(np.stack([(values >> j) & 1 for j in range(width)]))
    return planes, [1 << j for j in range(width - 1)] + [-(1 << (width - 1))]


def weights(counts: np.ndarray, planes: np.ndarray, powers: list[int]) -> np.ndarray:
    """``counts @ gains`` by AND and popcount over the planes of both."""
    out = np.zeros(len(counts), np.int64)
    top = int(counts.max()).bit_length() if counts.size else 0
    for i in range(top):
        bits = (counts >> i) & 1
        rows = np.flatnonzero(bits.any(axis=1))
        own = _packed(bits[rows])
        for plane, power in zip(planes, powers):
            out[rows] += np.bitwise_count(own & plane).sum(axis=1, dtype=np.int64) * (power << i)
    return out


def _weigh(n: int, gain: list[int]):
    def run(batches) -> Iterator[pa.RecordBatch]:
        buckets, (planes, powers) = _Buckets(), gain_planes(gain)
        for part in slices(batches, HELD):
            n_words, n_features, counts = [], [], np.zeros((part.num_rows, BUCKETS), np.int32)
            for row, text in enumerate(part.column(1)):
                at = _count(text.as_py(), n, buckets)
                counts[row] = np.bincount(at, minlength=BUCKETS)
                n_features.append(len(at))
                n_words.append(len(at) if n == 1 else len(terms(text.as_py())))
            yield pa.record_batch([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()),
                                   pa.array(weights(counts, planes, powers))],
                                  names=["doc_id", "n_words", "n_features", "weight"])
    return run


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, n: int = 1, least_words: int = 20,
             seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` is null unless drawn."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gain = gains(_dense(bucket_counts(own, n)), _dense(bucket_counts(target, n, target_col)))
    weighed = arrow_map(own, _weigh(n, gain), "doc_id long, n_words long, n_features long, weight long")
    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(seeded, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = stored(weighed.withColumn("score", F.col("weight") + noise), "resample-scores")
    able = F.col("n_words") >= least_words
    drawn = scored.filter(able).count() * percent // 100
    # eligible rows first, so ranks are theirs; the others have no rank
    order = [F.when(able, 0).otherwise(1), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return ranked(scored, order, "rank").select(
        "doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
