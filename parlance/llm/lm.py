"""Language-model scoring by the subword lattice.

The pieces of an existing vocabulary are the units of a unigram model.  Every way to cut a
word (with its word mark) into pieces is a path of a lattice; the lattice likelihood of
the word is the sum over all paths of the product of their piece probabilities, by a
forward recursion in log space.  Piece probabilities sum to one and a mark opens each
word, so the likelihoods of all words sum to one.

A word that training has seen has one more arc, from its start to its end, with its
discounted relative frequency; the mass of the discounts weights the piece paths:
P(word) = (1 - P(end)) * (max(c - d, 0) / n + d * v / n * lattice(word)).
A text's score is the log of the product over its words and its end.

The vocabulary's own scores (ranks) give the first piece probabilities.  They are then
re-estimated on the words of training, each distinct word once, as each gives the same
discount: a forward-backward pass over the lattices gives expected piece counts.

Flow: documents are grouped into blocks in the task that reads them, and a block carries
its documents as numbers into the block's own dictionary of distinct words.  Dictionaries
are shuffled by word, which gives every entry its word's total, and totals and lattice
scores go back to the blocks.  A word that is in every document is shuffled once per block.

Defined results: a null or empty text is the end token alone; a null id counts as the
text '' for the fold; repeated rows count each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import arrow_map, slices, stored

FOLDS, HELD_OUT = 10, 0
#: Add-constant of the base model.
ADD = 0.1
MARK = "▁"
#: Words in a block at most (a longer text is a block of its own).
BLOCK_WORDS = 2_000_000
#: Passes of re-estimation, and the count that every piece has besides.
PASSES, FLOOR = 2, 0.05
#: Cells of a lattice matrix, and longest word that is handled in a matrix.
CELLS, WIDE = 1 << 20, 64

_LATTICES: dict[str, "Lattice"] = {}


class Lattice:
    """Vocabulary pieces (as UTF-8 bytes) with a hash lookup for substrings of words.

    Byte pieces cover what no other piece does, so every word has a path.  Pieces are
    matched as bytes; a piece's hash is polynomial, so that all substrings of a matrix of
    words are hashed from prefix sums.
    """

    BASE = np.uint64(0x100000001B3)

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: dict[bytes, list[int]] = {}
        ranks = []
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            text = bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).encode()
            # a byte piece and a character piece may spell the same bytes: one unit
            if text not in pieces:
                pieces[text] = [len(ranks)]
                ranks.append(model.get_score(i))
        self.pieces = list(pieces)
        self.longest = max(map(len, self.pieces))
        # existing scores are ranks (0, -1, -2, ...): Zipf weights
        weight = 1 / (2.7 - np.array(ranks))
        self.first = np.log(weight / weight.sum())
        self.powers = np.ones(WIDE + self.longest + 2, np.uint64)
        for i in range(1, len(self.powers)):
            self.powers[i:i + 1] = self.powers[i - 1:i] * self.BASE
        hashes = np.array([self._hash(p) for p in self.pieces], np.uint64)
        size = 1 << (4 * len(hashes)).bit_length()
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.probes, slots = 0, (self._mixed(hashes) >> self.shift).astype(np.int64)
        for n, h in enumerate(hashes):
            at, step = int(slots[n]), 1
            while self.values[at] >= 0:
                at, step = (at + 1) & self.mask, step + 1
            self.keys[at], self.values[at] = h, n
            self.probes = max(self.probes, step)
        # most substrings are no pieces: a flag per leading bits of the hash turns them away first
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._mixed(hashes) >> np.uint64(44)] = True
        self.by_length = {n: {p: i for i, p in enumerate(self.pieces) if len(p) == n} for n in range(1, self.longest + 1)}

    def _hash(self, piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(self.BASE) + b + 1) % (1 << 64)
        # lengths are told apart
        return (h ^ (len(piece) * 0x9E3779B97F4A7C15)) % (1 << 64)

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        return h * np.uint64(0x9E3779B97F4A7C15)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, -1 where there is none."""
        out = np.full(h.shape, -1, np.int32)
        mixed = self._mixed(h)
        todo = np.flatnonzero(self.maybe[mixed >> np.uint64(44)])
        at = (mixed[todo] >> self.shift).astype(np.int64)
        for _ in range(self.probes):
            value = self.values[at]
            hit = (self.keys[at] == h[todo]) & (value >= 0)
            out[todo[hit]] = value[hit]
            go = ~hit & (value >= 0)
            todo, at = todo[go], (at[go] + 1) & self.mask
            if not len(todo):
                break
        return out

    def arcs(self, words: list[bytes], width: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of all arcs of words padded to ``width``, by end."""
        n = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        sums = np.zeros((width + 1, len(words)), np.uint64)
        for i in range(width):
            sums[i + 1] = sums[i] * self.BASE + data[:, i].astype(np.uint64) + np.uint64(1)
        out = []
        for end in range(1, width + 1):
            rows = np.flatnonzero(n >= end)
            if not len(rows):
                break
            for start in range(max(0, end - self.longest), end):
                size = end - start
                h = sums[end, rows] - sums[start, rows] * self.powers[size]
                found = self._find(h ^ np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64)))
                on = found >= 0
                if on.any():
                    out.append((start, end, rows[on], found[on]))
        return out

    def _batches(self, words: list[bytes]):
        """(indices, width) of words of like length; words over WIDE come one by one."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            width = len(words[order[at]])
            if width > WIDE:
                yield order[at:at + 1], width
                at += 1
                continue
            width = min(WIDE, width + 2)
            upto, most = at, max(1, CELLS // (width + 1))
            while upto < len(order) and upto - at < most and len(words[order[upto]]) <= width:
                upto += 1
            yield order[at:upto], width
            at = upto

    def _long_arcs(self, word: bytes) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Arcs of one long word by dictionary lookups."""
        one = np.zeros(1, np.int64)
        return [(end - size, end, one, np.array([i])) for end in range(1, len(word) + 1)
                for size in range(1, min(self.longest, end) + 1)
                if (i := self.by_length[size].get(word[end - size:end])) is not None]

    def forward(self, words: list[bytes], logp: np.ndarray, weights: np.ndarray | None = None):
        """Natural-log probability of each marked word; with ``weights`` also the expected
        piece counts (forward-backward)."""
        score = np.empty(len(words))
        counts = np.zeros(len(logp))
        for members, width in self._batches(words):
            own = [words[i] for i in members]
            arcs = self._long_arcs(own[0]) if width > WIDE else self.arcs(own, width)
            alpha = np.full((width + 1, len(own)), -np.inf)
            alpha[0] = 0
            for start, end, rows, pieces in arcs:
                alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + logp[pieces])
            n = np.array([len(w) for w in own])
            total = alpha[n, np.arange(len(own))]
            score[members] = total
            if weights is not None:
                beta = np.full_like(alpha, -np.inf)
                beta[n, np.arange(len(own))] = 0
                w = weights[members]
                for start, end, rows, pieces in reversed(arcs):
                    after = beta[end, rows] + logp[pieces]
                    beta[start, rows] = np.logaddexp(beta[start, rows], after)
                    np.add.at(counts, pieces, w[rows] * np.exp(alpha[start, rows] + after - total[rows]))
        return score, counts


def lattice(path: str) -> Lattice:
    """The worker's lattice for this vocabulary file, built once."""
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


def marked(word: bytes) -> bytes:
    """A word as the vocabulary spells it: with the mark of its start."""
    return MARK.encode() + word


# --- blocks ------------------------------------------------------------------------------------

BLOCKS = ("block long, words array<binary>, train array<int>, docs array<long>, folds array<boolean>, "
          "sizes array<int>, numbers binary")


class Block:
    """Documents as numbers into a dictionary of their distinct words."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.rows: list[tuple[int | None, bool]] = []
        self.ids: list[np.ndarray] = []
        self.held = 0

    def add(self, doc: int | None, out: bool, words: list[bytes]) -> None:
        number = self.number
        for w in set(words):
            if w not in number:
                number[w] = len(number)
        self.rows.append((doc, out))
        self.ids.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        self.held += len(words) + 1

    def batch(self) -> pa.RecordBatch:
        # the name of a block follows from its rows, so a task that runs again repeats it
        numbers = np.concatenate(self.ids).tobytes()
        name = hashlib.blake2b(numbers + repr(self.rows).encode(), digest_size=8).digest()
        taught = [np.empty(0, np.int32), *(x for x, (_, out) in zip(self.ids, self.rows) if not out)]
        counts = np.bincount(np.concatenate(taught), minlength=len(self.number))
        one = lambda x, t: pa.array([x], t)
        return pa.RecordBatch.from_arrays(
            [one(int.from_bytes(name, "little", signed=True), pa.int64()), one(list(self.number), pa.list_(pa.binary())),
             one(counts.astype(np.int32), pa.list_(pa.int32())), one([r[0] for r in self.rows], pa.list_(pa.int64())),
             one([r[1] for r in self.rows], pa.list_(pa.bool_())),
             one([len(x) for x in self.ids], pa.list_(pa.int32())),
             one(pa.compress(numbers, "zstd", asbytes=True), pa.binary())],
            ["block", "words", "train", "docs", "folds", "sizes", "numbers"])


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents grouped as they are read: a block's distinct words with their training
    counts, and every document as numbers into that dictionary."""
    def run(batches):
        block = Block()
        for part in slices(batches):
            for doc, out, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                words = (text or "").encode().lower().split()
                if block.rows and block.held + len(words) > BLOCK_WORDS:
                    yield block.batch()
                    block = Block()
                block.add(doc, out, words)
        if block.rows:
            yield block.batch()

    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(FOLDS))
    return (docs.select(F.col(id_col).cast("long").alias("doc"), (fold == HELD_OUT).alias("out"),
                        F.col(text_col).alias("text")).transform(arrow_map, run, BLOCKS))


# --- training and scoring ------------------------------------------------------------------------

def expected_counts(words: DataFrame, path: str, logp: np.ndarray) -> np.ndarray:
    """Expected piece counts over the column ``word``.  Each task sums its own into one
    vector over the vocabulary, whose size is fixed; the vectors are added per piece."""
    def run(batches):
        model, total = lattice(path), np.zeros(len(logp))
        for part in slices(batches, 50_000):
            own = [marked(w) for w in part.column(0).to_pylist()]
            total += model.forward(own, logp, np.ones(len(own)))[1]
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(total[on])], ["piece", "c"])

    out = np.zeros(len(logp))
    for r in words.select("word").transform(arrow_map, run, "piece int, c double").groupBy("piece").agg(F.sum("c").alias("c")).collect():
        out[r["piece"]] = r["c"]
    return out


def train(words: DataFrame, path: str, passes: int = PASSES) -> np.ndarray:
    """Natural-log piece probabilities, re-estimated on all distinct training words."""
    logp = lattice(path).first
    for _ in range(passes):
        counts = expected_counts(words, path, logp) + FLOOR
        logp = np.log(counts / counts.sum())
    return logp


def score(docs: DataFrame, path: str, passes: int = PASSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    held = stored(blocks(docs, id_col, text_col), "lm-blocks")
    entries = held.select("block", F.posexplode(F.arrays_zip("words", "train")).alias("number", "e")).select(
        "block", "number", F.col("e.words").alias("word"), F.col("e.train").alias("c"))
    # one shuffle and one sort by word: every entry gets its word's total, the first one stands for the word
    same, place = Window.partitionBy("word"), F.struct("block", "number")
    totals = stored(entries.select("block", "number", "word", F.sum("c").over(same).alias("c"),
                                   (F.min(place).over(same) == place).alias("first")), "lm-words")
    ends = held.select(F.expr("size(filter(folds, x -> not x))").alias("n")).agg(F.sum("n")).first()[0] or 0
    known = totals.filter("first and c > 0")
    seen = known.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"),
                     F.count_if(F.col("c") == 2).alias("twice")).first()
    n, v = seen["n"] or 0, seen["v"]
    total, distinct = n + ends, v + (ends > 0)
    logp = train(known, path, passes) if v else lattice(path).first
    below = total + ADD * (distinct + 1)
    base_end = math.log10((ends + ADD) / below)
    # the discount that leaves a word seen once its expected share
    discount = (seen["once"] + 0.5) / (seen["once"] + 2 * seen["twice"] + 1)
    open_mass = discount * v / n if n else 1.0
    end = (ends + 0.5) / (total + 1)
    end_score = math.log10(end)

    def word_scores(batches):
        model = lattice(path)
        for part in slices(batches, 50_000):
            # rows come sorted by word: each run of equal words is scored once
            coded = part.column(2).dictionary_encode()
            at = coded.indices.to_numpy()
            paths = model.forward([marked(w) for w in coded.dictionary.to_pylist()], logp)[0][at] + math.log(open_mass)
            c = part.column(3).to_numpy()
            whole = np.where(c > 0, np.log(np.maximum(c - discount, 1e-300) / max(n, 1)), -np.inf)
            p = (np.logaddexp(paths, whole) + math.log1p(-end)) / math.log(10)
            block, number = part.column(0).to_numpy(), part.column(1).to_numpy().astype("<i4")
            order = np.argsort(block, kind="stable")
            names, first = np.unique(block[order], return_index=True)
            cuts = np.split(order, first[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), *(pa.array([x[i].tobytes() for i in cuts], pa.binary())
                                    for x in (number, c.astype("<i8"), p.astype("<f8")))],
                ["block", "number", "c", "score"])

    # a block's dictionary holds at most BLOCK_WORDS words (or those of one text)
    back = totals.select("block", "number", "word", "c").transform(
        arrow_map, word_scores, "block long, number binary, c binary, score binary").groupBy("block").agg(
        F.collect_list(F.struct("number", "c", "score")).alias("parts"))

    def sums(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                col = lambda name: batch.column(batch.schema.names.index(name))[i]  # noqa: E731, B023
                sizes = np.array(col("sizes").values, np.int64)
                packed = pa.decompress(col("numbers").as_buffer(), int(4 * sizes.sum()), "zstd") if sizes.sum() else b""
                ids = np.frombuffer(packed, np.int32)
                parts = col("parts").as_py() or []
                at, c, own = (np.frombuffer(b"".join(x[k] for x in parts), kind)
                              for k, kind in (("number", "<i4"), ("c", "<i8"), ("score", "<f8")))
                c, own = (np.bincount(at, x) / np.maximum(np.bincount(at), 1) for x in (c, own))
                base = np.log10((c + ADD) / below)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                add = lambda x: np.bincount(doc, x[ids], len(sizes)) if len(ids) else np.zeros(len(sizes))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array(col("docs").values), pa.array(col("folds").values), pa.array(sizes + 1),
                     pa.array(add((c > 0).astype(float)).astype(np.int64) + (ends > 0)),
                     pa.array(np.full(len(sizes), total, np.int64)),
                     pa.array(add(base) + base_end), pa.array(add(own) + end_score)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return held.select("block", "docs", "folds", "sizes", "numbers").join(back, "block", "left").transform(
        arrow_map, sums, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
              "base_score double, score double")
