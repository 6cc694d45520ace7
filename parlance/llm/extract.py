"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is a sequence of leaf blocks.  Each has binary features: the names, classes, ids and roles of the
elements around it, and what its text is like (length, share of links, how it begins and ends,
words of short texts, place).  The field has a weight per feature, for neighbouring labels and for
both ends; Viterbi decodes the best labelling (article or not) of a page as a whole.

Training takes a documented sample: ``TRAIN_PAGES`` pages, those with the least hashed id among the pages
of at most ``TRAIN_BYTES`` bytes that name their article by markup.  Each is rebuilt in
``layouts.VARIANTS`` layouts, so that the model also knows pages without such markup.  Without such pages
the model learns from layouts of ``PLACEHOLDER`` texts only.  The weights (a number per feature that the sample
holds twice) go to the tasks; pages are scanned, decoded and written in one map, nothing is shuffled.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined in
page order by two line feeds.  A heading inside the article belongs to it.

Defined results: a null or empty page, or one without article blocks, has an empty text; a page cut off inside a
tag ends there; rows that repeat an id or a url are rows of their own; an empty table gives an empty
result; other columns are ignored.  Pages of any length are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.blocks import Element, Leaf, leaves
from parlance.llm.common import arrow_map, slices
from parlance.llm.layouts import VARIANTS, Layout

#: Bounds of the training sample.
TRAIN_PAGES, TRAIN_BYTES, TRAIN_BLOCKS = 192, 65_536, 512
#: Rounds of full-batch training, the step and the weight of the penalty.
ROUNDS, STEP, PENALTY = 150, 0.1, 1e-3
#: Words of a text up to which its words are features.
SHORT = 8

# Elements and words of class or id under which an article's own markup holds something else.
OUTSIDE = frozenset("in:nav in:aside in:footer in:form in:menu in:dialog name:ad name:ads name:comments name:comment".split())
INSIDE = frozenset(["in:article", "in:main"])
PLACEHOLDER = [("h1", "A heading of some words"), ("p", "One sentence of an article, which goes on for a while."),
               ("p", "A second paragraph has more to say. It ends here."), ("p", "Short.")]


# -- features ------------------------------------------------------------------------------

def _size(n: int) -> int:
    return n.bit_length()


def text_features(leaf: Leaf, at: int, of: int) -> list[str]:
    """Features of a block's text and place."""
    text = leaf.text
    n, last, first = len(text), text[-1], text[0]
    out = [f"is:{leaf.inside.tag}", f"chars:{_size(n)}", f"linked:{min(4, 4 * leaf.linked // n)}",
           f"ends:{last if last in '.!?:;,…»”' else 'letter' if last.isalpha() else 'digit' if last.isdigit() else 'other'}",
           "begins:" + ("upper" if first.isupper() else "letter" if first.isalpha() else "digit" if first.isdigit()
                        else first if first in "©«“\"#|" else "other"),
           f"stops:{_size(text.count('. ') + text.count('? ') + text.count('! '))}"]
    if at == 0:
        out.append("first")
    if at == of - 1:
        out.append("last")
    if any(c in text for c in "©|·»"):
        out.append("sign")
    if n <= 80:
        words = text.lower().split()
        if len(words) <= SHORT:
            out += [f"word:{w.strip('.,:;!?')}" for w in words]
    return out


# -- labelled pages ------------------------------------------------------------------------

def label(inside: Element) -> int | None:
    """What markup says about a block: 1 article, 0 not.  An explicit ``data-label`` goes first."""
    if inside.label:
        return int(inside.label == "main")
    return int(bool(INSIDE & inside.above) and not OUTSIDE & inside.above)


def labelled(pages: list[str]) -> list[tuple[list[set], list[int]]]:
    """Feature sets and labels of each page's blocks: the pages themselves and their layouts."""
    out = []

    def add(page: str) -> list[Leaf]:
        found = leaves(page)
        if 0 < len(found) <= TRAIN_BLOCKS:
            out.append(([leaf.inside.path.union(text_features(leaf, i, len(found))) for i, leaf in enumerate(found)],
                        [label(leaf.inside) for leaf in found]))
        return found

    for number, page in enumerate(pages or [None]):
        found = add(page) if page else []
        article = [(x.inside.tag, x.text) for x in found if label(x.inside)] or PLACEHOLDER
        other = [x.text for x in found if not label(x.inside)]
        for variant in range(VARIANTS if page else TRAIN_PAGES):
            # a long article is cut for its layouts, so that the other parts keep their share
            add(Layout(VARIANTS * number + variant, article[:24], other).page())
    return out


# -- the field -----------------------------------------------------------------------------

@dataclass
class Field:
    """Weights of label 1 against label 0 per feature, of neighbouring labels, and of both ends."""

    weight: dict[str, float]
    between: list[list[float]]
    ends: list[list[float]]

    def decode(self, scores: list[float]) -> list[int]:
        """The best labelling (Viterbi) of blocks with these scores for label 1; ties prefer 0."""
        if not scores:
            return []
        (b00, b01), (b10, b11) = self.between
        zero, one = self.ends[0][0], self.ends[0][1] + scores[0]
        back = []
        for s in scores[1:]:
            from_zero, from_one = zero + b00 < one + b10, zero + b01 < one + b11
            back.append((from_zero, from_one))
            zero, one = max(zero + b00, one + b10), max(zero + b01, one + b11) + s
        state = int(one + self.ends[1][1] > zero + self.ends[1][0])
        out = [state]
        for step in reversed(back):
            state = int(step[state])
            out.append(state)
        return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.squeeze(most, axis) + np.log(np.exp(x - most).sum(axis=axis))


def likelihood(scores: np.ndarray, held: np.ndarray, labels: np.ndarray, between: np.ndarray, ends: np.ndarray):
    """Log likelihood of the labels and its gradients by scores, between and ends.

    ``scores``, ``held``, ``labels``: pages by blocks, ``held`` where a page has a block (a prefix
    of each row).  Forward and backward passes go over block numbers, all pages at once."""
    pages, most = scores.shape
    emit = np.stack([np.zeros_like(scores), scores], -1)
    ahead = np.zeros((pages, most, 2))
    ahead[:, 0] = ends[0] + emit[:, 0]
    for t in range(1, most):
        step = _log_sum(ahead[:, t - 1, :, None] + between, 1) + emit[:, t]
        ahead[:, t] = np.where(held[:, t, None], step, ahead[:, t - 1])
    last = held.sum(1) - 1
    behind = np.zeros((pages, most, 2))
    behind[:] = ends[1]
    for t in range(most - 2, -1, -1):
        step = _log_sum(between + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where(held[:, t + 1, None], step, ends[1])
    total = _log_sum(ahead[:, -1] + ends[1], 1)
    share = np.exp(ahead + behind - total[:, None, None]) * held[..., None]
    row = np.arange(pages)
    both = held[:, 1:]
    pair = np.exp(ahead[:, :-1, :, None] + between + (emit + behind)[:, 1:, None, :] - total[:, None, None, None])
    pair *= both[..., None, None]
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:, :-1][both], labels[:, 1:][both]), 1)
    first, final = labels[:, 0], labels[row, last]
    value = ((scores * labels * held).sum() + (between * seen).sum() + ends[0][first].sum() + ends[1][final].sum()
             - total.sum())
    at_ends = np.stack([np.bincount(first, minlength=2) - share[:, 0].sum(0),
                        np.bincount(final, minlength=2) - share[row, last].sum(0)])
    return value, (labels - share[..., 1]) * held, seen - pair.sum((0, 1)), at_ends


@dataclass
class _Batch:
    """Sequences of similar length: blocks held, labels, and which features each block has."""

    held: np.ndarray
    labels: np.ndarray
    of: np.ndarray
    at: np.ndarray

    @classmethod
    def of_sequences(cls, sequences: list, number: dict[str, int]) -> "_Batch":
        pages, most = len(sequences), max(len(labels) for _, labels in sequences)
        held, labels = np.zeros((pages, most), bool), np.zeros((pages, most), np.int64)
        of, at = [], []
        for row, (features, own) in enumerate(sequences):
            held[row, :len(own)], labels[row, :len(own)] = True, own
            for column, names in enumerate(features):
                known = sorted(number[f] for f in names if f in number)
                of += known
                at += [row * most + column] * len(known)
        return cls(held, labels, np.array(of, np.int64), np.array(at, np.int64))

    def slopes(self, weight: np.ndarray, between: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        scores = np.bincount(self.at, weight[self.of], self.held.size).reshape(self.held.shape)
        _, by_score, by_between, by_ends = likelihood(scores, self.held, self.labels, between, ends)
        return [np.bincount(self.of, by_score.ravel()[self.at], len(weight)), by_between, by_ends]


def fit(sequences: list[tuple[list[set], list[int]]], rounds: int = ROUNDS) -> Field:
    """The field that fits labelled sequences: penalised likelihood, full batches, adaptive steps."""
    count = Counter(f for features, _ in sequences for own in features for f in own)
    number = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n > 1))}
    by_length: dict[int, list] = {}
    for sequence in sequences:
        by_length.setdefault(_size(len(sequence[1]) - 1), []).append(sequence)
    batches = [_Batch.of_sequences(by_length[n], number) for n in sorted(by_length)]
    blocks = sum(b.held.sum() for b in batches)
    parts = [np.zeros(len(number)), np.zeros((2, 2)), np.zeros((2, 2))]
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for turn in range(1, rounds + 1):
        for i, own in enumerate(zip(*(b.slopes(*parts) for b in batches))):
            slope = sum(own) / blocks - PENALTY * parts[i] / 10
            mean[i] = 0.9 * mean[i] + 0.1 * slope
            square[i] = 0.99 * square[i] + 0.01 * slope ** 2
        for i in range(3):
            step = STEP * mean[i] / (1 - 0.9 ** turn) / (np.sqrt(square[i] / (1 - 0.99 ** turn)) + 1e-8)
            parts[i] = parts[i] + step
    return Field({f: float(parts[0][i]) for f, i in number.items()}, parts[1].tolist(), parts[2].tolist())


def sample(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> list[str]:
    """The training sample: at most ``TRAIN_PAGES`` pages of at most ``TRAIN_BYTES`` bytes."""
    named = pages.filter(F.col(html_col).rlike(r"(?i)<(article|main)[\s>]") & (F.octet_length(html_col) <= TRAIN_BYTES))
    turn = named.select(F.xxhash64(F.col(id_col).cast("string"), html_col).alias("turn"), F.col(html_col).alias("html"))
    # the numbers first: whole pages leave the tasks only if they are in the sample
    least = [r["turn"] for r in turn.select("turn").distinct().orderBy("turn").limit(TRAIN_PAGES).collect()]
    chosen = turn.filter(F.col("turn").isin(least)).groupBy("turn").agg(F.min("html").alias("html"))
    return [r["html"] for r in chosen.orderBy("turn").collect()]


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Field:
    return fit(labelled(sample(pages, id_col, html_col)))


# -- extraction ----------------------------------------------------------------------------

def main_blocks(page: str | None, model: Field) -> list[str]:
    """Texts of the blocks that the model takes for the article, in page order."""
    found = leaves(page, model.weight)
    around: dict[frozenset, float] = {}
    scores = []
    for i, leaf in enumerate(found):
        path = leaf.inside.path
        if path not in around:
            around[path] = math.fsum(model.weight[f] for f in path)
        scores.append(around[path] + math.fsum(
            model.weight.get(f, 0.0) for f in set(text_features(leaf, i, len(found))).difference(path)))
    return [leaf.text for leaf, kept in zip(found, model.decode(scores)) if kept]


def _extract(model: Field):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = ["\n\n".join(main_blocks(page.as_py(), model)) for page in part.column(2)]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])
    return run


def extract(pages: DataFrame, model: Field | None = None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; the model is trained on ``pages`` if none is given."""
    model = model or train(pages, id_col, html_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    return arrow_map(rows, _extract(model), "page_id long, url string, text string, n_chars long")
