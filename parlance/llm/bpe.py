"""Byte-level BPE encoding and decoding over padded numpy matrices.

Texts are cut by the split pattern of the rank file.  Distinct pieces of a batch are
bucketed by byte length into padded matrices.  In each round every row merges its
leftmost pair of minimum rank: ranks come from an open-addressing table keyed by the
pair of ids, and the row is compacted by one column.  Rows without a mergeable pair
leave the matrix.

Defined results: a null text is the empty text (no ids, digests of the empty string);
a null id stays null; every input row gives one output row, repeated rows included;
other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_map, slices

NONE = np.int32(2**31 - 1)
#: Widths of the padded matrices; longer pieces are merged one by one.
WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256)
#: Cells of one matrix, and entries of one worker's piece cache (about 0.2 KB each).
CELLS = 1 << 20
CACHE = 400_000

#: Documents encoded together.
ROWS = 1024

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Two white-space characters in a row, by the widest definition (a superset of the pattern's).
_DOUBLE_SPACE = re.compile(r"\s\s")
_ENCODERS: dict[tuple[str, str], "Encoder"] = {}


class PairTable:
    """(left id, right id) -> merged id, in a linear-probing hash table."""

    def __init__(self, vocab: dict[bytes, int]):
        keys, values = [], []
        for token, rank in vocab.items():
            for cut in range(1, len(token)):
                left = vocab.get(token[:cut])
                right = vocab.get(token[cut:]) if left is not None else None
                if right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NONE, np.int32)
        todo, put = np.array(keys, np.int64), np.array(values, np.int32)
        at = self._slot(todo)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = np.flatnonzero(self.keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]] = todo[won], put[won]
            left_over = np.ones(len(todo), bool)
            left_over[won] = False
            todo, put, at = todo[left_over], put[left_over], (at[left_over] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair; NONE where there is none or where a side is padding."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(keys.shape, NONE, np.int32)
        flat, into = keys.ravel(), out.ravel()
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        at = self._slot(flat[todo])
        for _ in range(self.probes):
            if not len(todo):
                break
            found = self.keys[at]
            hit = found == flat[todo]
            into[todo[hit]] = self.values[at[hit]]
            go = ~hit & (found != -1)
            todo, at = todo[go], (at[go] + 1) & self.mask
        return out


def merge_matrix(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """Merge every row of a matrix padded with -1; the result is padded with -1 too."""
    out = np.full(ids.shape, -1, np.int32)
    rows = np.arange(len(ids))
    ranks = pairs.ranks(ids[:, :-1], ids[:, 1:])
    while True:
        at, width = np.arange(len(rows)), ids.shape[1]
        pos = ranks.argmin(axis=1)
        best = ranks[at, pos]
        done = best == NONE
        if done.any():
            out[rows[done], :width] = ids[done]
            go = ~done
            rows, ids, ranks, pos, best = rows[go], ids[go], ranks[go], pos[go], best[go]
            at = np.arange(len(rows))
        if not len(rows):
            return out
        ids[at, pos] = best
        if width == 2:
            out[rows, 0] = ids[:, 0]
            return out
        # compaction: the column after the merged pair closes up
        cols = np.arange(width - 1)
        ids = np.take_along_axis(ids, cols + (cols > pos[:, None]), axis=1)
        ranks = np.take_along_axis(ranks, cols[:-1] + (cols[:-1] > pos[:, None]), axis=1)
        for beside in (pos - 1, pos):
            ok = np.flatnonzero((beside >= 0) & (beside < width - 2))
            ranks[ok, beside[ok]] = pairs.ranks(ids[ok, beside[ok]], ids[ok, beside[ok] + 1])


def merge_long(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """One long row.  All occurrences of the minimum rank merge in one round where that
    equals merging them one after the other from the left: no pair that a merge creates,
    in between or at the end, may rank lower.  Otherwise only the leftmost merges."""
    while len(ids) > 1:
        ranks = pairs.ranks(ids[:-1], ids[1:])
        best = ranks.min()
        if best == NONE:
            break
        at = np.flatnonzero(ranks == best)
        if len(at) > 1 and (np.diff(at) == 1).any():  # overlapping occurrences: every other one
            run = np.cumsum(np.r_[True, np.diff(at) != 1])
            start = at[np.r_[True, np.diff(at) != 1]][run - 1]
            at = at[(at - start) % 2 == 0]
        if len(at) > 1:
            made = np.full(len(at), best, np.int32)
            before = ids[np.maximum(at - 1, 0)]
            before = np.where(at > 0, before, -1)
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            joined = np.where(np.r_[np.diff(at) == 2, False], best, -1)
            joined_before = np.where(np.r_[False, np.diff(at) == 2], best, -1)
            new = (pairs.ranks(before, made), pairs.ranks(made, after),
                   pairs.ranks(made, joined), pairs.ranks(joined_before, made))
            if min(x.min() for x in new) < best:
                at = at[:1]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids = ids.copy()
        ids[at] = best
        ids = ids[keep]
    return ids


class Encoder:
    """Encodes and decodes with one rank file.  Holds a bounded cache of pieces."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            vocab = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, rank in vocab.items():
            self.bytes_of[rank] = token
        self.decimal = list(map(str, range(len(self.bytes_of))))
        self.whole = {token: rank.to_bytes(4, "little") for token, rank in vocab.items()}
        self.byte_id = np.array([vocab[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(vocab)
        self.split = regex.compile(pattern)
        self.seen: tuple[dict, dict] = ({}, {})

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece of the split pattern, as little-endian 32-bit numbers."""
        out: list = [self.whole.get(p) for p in pieces]
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if out[i] is None:
                width = WIDTHS[bisect.bisect_left(WIDTHS, len(piece))] if len(piece) <= WIDTHS[-1] else 0
                by_width.setdefault(width, []).append(i)
        for i in by_width.pop(0, []):
            out[i] = merge_long(self.byte_id[np.frombuffer(pieces[i], np.uint8)], self.pairs).astype("<i4").tobytes()
        for width, members in by_width.items():
            step = max(1, CELLS // width)
            for at in range(0, len(members), step):
                part = members[at:at + step]
                joined = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in part]), np.uint8)
                ids = self.byte_id[joined].reshape(len(part), width)
                lengths = np.array([len(pieces[i]) for i in part])
                ids[np.arange(width) >= lengths[:, None]] = -1
                merged = merge_matrix(ids, self.pairs)
                on = merged >= 0
                flat = merged[on].astype("<i4").tobytes()
                ends = (4 * np.cumsum(on.sum(axis=1))).tolist()
                for i, a, b in zip(part, [0, *ends], ends):
                    out[i] = flat[a:b]
        return out

    def _learn(self, keys: set[str], lead: str) -> dict[str, bytes]:
        """Cache with the ids of ``lead + key`` for all keys."""
        known = self.seen[bool(lead)]
        missing = [k for k in keys if k not in known]
        if len(known) + len(missing) > CACHE:
            known.clear()
            missing = list(keys)
        pieces = [self.split.findall(lead + k) for k in missing]
        distinct = list(dict.fromkeys(chain.from_iterable(pieces)))
        ids = dict(zip(distinct, self.encode_pieces([p.encode() for p in distinct])))
        for key, own in zip(missing, pieces):
            known[key] = ids[own[0]] if len(own) == 1 else b"".join([ids[p] for p in own])
        return known

    def encode_texts(self, texts: list[str]) -> list[list[int]]:
        """Ids of each whole text.

        Without two white-space characters in a row, the pattern never matches across
        the place before a space, so such texts are looked up by space-led words.
        """
        plain = [None if _DOUBLE_SPACE.search(t) else t.split(" ") for t in texts]
        words = [p[1:] if p else [] for p in plain]
        heads = [p[:1] if p else self.split.findall(t) for p, t in zip(plain, texts)]
        led = self._learn(set().union(*words), " ")
        raw = self._learn(set().union(*heads), "")
        joined = (b"".join([raw[k] for k in head] + [led[k] for k in rest]) for head, rest in zip(heads, words))
        return [np.frombuffer(x, "<i4").tolist() for x in joined]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decimals(self, ids: list[int]) -> bytes:
        """Decimal ids joined by one space."""
        return " ".join(map(self.decimal.__getitem__, ids)).encode()


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder for this rank file, built once."""
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, pattern)
    return _ENCODERS[key]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text."""
    def run(batches):
        enc = encoder(path, pattern)
        for part in slices(batches, ROWS):
            texts = [t or "" for t in part.column(1).to_pylist()]
            ids = enc.encode_texts(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))],
                                             ["doc_id", "ids"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .transform(arrow_map, run, "doc_id long, ids array<int>"))


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, data``: the bytes that the ids stand for."""
    def run(batches):
        enc = encoder(path, pattern)
        for part in slices(batches, ROWS):
            data = [enc.decode(x or []) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return ids.select("doc_id", "ids").transform(arrow_map, run, "doc_id long, data binary")


def encode_digests(docs: DataFrame, path: str, pattern: str,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode, then decode the ids again.

    The ids stay inside the task: only the digests leave it.
    """
    def run(batches):
        enc = encoder(path, pattern)
        for part in slices(batches, ROWS):
            rows = []
            for ids in enc.encode_texts([t or "" for t in part.column(1).to_pylist()]):
                rows.append((len(ids), hashlib.sha256(enc.decimals(ids)).hexdigest(),
                             hashlib.sha256(enc.decode(ids)).hexdigest()))
            n, a, b = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .transform(arrow_map, run, SCHEMA))
