"""Language identification of whole texts, mixed ones included.

Script ranges narrow the candidates of a word to the languages that were learned with that
script.  Each word scores every candidate by hashed letter n-grams and the word itself.
Viterbi over the words, with a penalty for switching the language, labels spans; a text's
language is the one that labels most of its words.

Learned from labelled documents whose crc32(id as text) mod 4 is not 2: per language the
``PER_LANG`` documents whose hashed id is least (a bounded sample for the classifier); more than
``LANGS`` languages raise an error.  Predictions read the text only.

Defined results: a null text, or one without a letter, is ``und`` with score 0; if nothing
can be learned, every text is; a null id counts as '' for the fold; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import arrow_map, slices, stored

FOLDS, HELD_OUT = 4, 2
#: Labelled documents per language that the classifier learns from at most, languages that it learns, and bits of
#: the ranges in which hashed ids are counted.
PER_LANG, LANGS, RANGE_BITS = 1500, 256, 16
#: Hashed features, the nats that a change of language costs, and the weight of a feature.
BITS, SWITCH, WEIGHT = 15, 8.0, 0.5
#: Share of a language's words that a script needs to make the language its candidate.
SCRIPT_SHARE = 0.01
#: Word scores that one worker keeps, and documents of one Viterbi run.
CACHE, ROWS = 200_000, 2048

#: Scripts by code point ranges (first code point, name); fixed values.
SCRIPT_RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"),
    (0x3130, "Hangul"), (0x3190, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x30000, "Other"),
)
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_STARTS = np.array([at for at, _ in SCRIPT_RANGES], np.uint64)
_NUMBER = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES])
_LETTERS = regex.compile(r"\p{L}+")
_ODD, _OPEN, _CLOSE = np.uint64(0x9E3779B97F4A7C15), 60, 62


def letters(token: str) -> str:
    return token if token.isalpha() else "".join(_LETTERS.findall(token))


class Grams:
    """Hashed features of words (non-empty, letters only): 2- and 3-grams of the framed
    word and the word itself, for all words at once, in the order of the words."""

    def __init__(self, words: list[str]):
        c = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le"), np.uint32).astype(np.uint64)
        first = np.flatnonzero(c == _OPEN)
        self.sizes = np.diff(np.r_[first, len(c)])
        two, three = c[:-1] * _ODD + c[1:], (c[:-2] * _ODD + c[1:-1]) * _ODD + c[2:]
        inside = c != _CLOSE
        self.two = self._hash(two[inside[:-1]], 2)
        self.three = self._hash(three[inside[:-2] & inside[1:-1]], 3)
        powers = np.cumprod(np.r_[np.uint64(1), np.full(self.sizes.max(), _ODD)])
        place = np.arange(len(c)) - np.repeat(first, self.sizes)
        self.whole = self._hash(np.add.reduceat(c * powers[place], first), 5)
        self.scripts = _NUMBER[np.searchsorted(_STARTS, c[first + 1], side="right") - 1]

    @staticmethod
    def _hash(x: np.ndarray, kind: int) -> np.ndarray:
        x = (x + np.uint64(kind)) * _ODD
        return (((x ^ (x >> np.uint64(29))) * _ODD) >> np.uint64(64 - BITS)).astype(np.int64)

    def kinds(self):
        """(features, number of them per word) of each kind; every word has each kind."""
        return (self.two, self.sizes - 1), (self.three, self.sizes - 2), (self.whole, np.ones_like(self.sizes))


def _fold(doc: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc.cast("string"), F.lit(""))), F.lit(FOLDS))


def sample(docs: DataFrame, per_lang: int = PER_LANG, langs: int = LANGS) -> DataFrame:
    """``lang, text`` of the bounded training sample.

    The texts are taken by one bound per language, found without them: hashed ids are counted by language
    and range, which gives the range that holds a language's last document of the sample, and only
    ids up to that range are ranked.  So a language of any size costs one task little more than its sample.
    More than ``langs`` languages are refused, as the model grows with their number.
    """
    labelled = docs.filter((_fold(F.col("doc")) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    key = F.xxhash64("doc")
    slim = labelled.select("lang", key.alias("key"), F.shiftright(key, 64 - RANGE_BITS).alias("part"))
    held = slim.groupBy("lang", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("part")) - F.col("n")
    last = stored(held.withColumn("before", before).filter(F.col("before") < per_lang).groupBy("lang").agg(
        F.max("part").alias("last")), "langid-ranges")
    if last.count() > langs:
        raise ValueError(f"labelled documents have more than {langs} languages")
    near = slim.join(F.broadcast(last), "lang").filter(F.col("part") <= F.col("last"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    ranked = near.withColumn("turn", turn).filter(F.col("turn") <= per_lang)
    bounds = ranked.groupBy("lang").agg(F.max("key").alias("most"))
    return labelled.join(F.broadcast(stored(bounds, "langid-sample")), "lang").filter(key <= F.col("most")).select("lang", "text")


class Model:
    """Per-language log probabilities of features, and candidates per script."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        total = counts.sum(axis=0, keepdims=True)
        self.table = (WEIGHT * np.log((counts + 0.5) / (total + 0.5 * len(counts)))).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
        self.candidate = share >= SCRIPT_SHARE
        self.candidate[~self.candidate.any(axis=1)] = True

    def scores(self, tokens: list[str]) -> np.ndarray:
        """One row per token; zeros for tokens without letters, very low for non-candidates."""
        plain = [letters(t) for t in tokens]
        words = list(dict.fromkeys(w for w in plain if w))
        table = np.zeros((len(words) + 1, len(self.langs)), np.float32)  # the last row stands for no letters
        if words:
            grams = Grams(words)
            for features, sizes in grams.kinds():
                table[:-1] += np.add.reduceat(self.table[features], np.cumsum(sizes) - sizes, axis=0)
            own = table[:-1]
            table[:-1] = np.where(self.candidate[grams.scripts], own, own.min(axis=1, keepdims=True) - 100)
        number = dict(zip(words, range(len(words))))
        return table[np.fromiter((number.get(w, -1) for w in plain), np.int64, len(plain))]


def train(docs: DataFrame, per_lang: int = PER_LANG, langs: int = LANGS) -> Model | None:
    """Learn from a frame ``doc, lang, text``; None without labelled documents.

    Tasks add up features before anything is shuffled; the sums have at most
    languages x (2**BITS + scripts) rows.
    """
    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for part in slices(batches):
            words: dict[str, Counter] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(map(letters, text.lower().split()))
            for lang, found in words.items():
                own = counts.setdefault(lang, np.zeros((1 << BITS) + len(SCRIPTS)))
                found.pop("", None)
                if found:
                    grams, n = Grams(list(found)), np.array(list(found.values()), float)
                    for features, sizes in grams.kinds():
                        own += np.bincount(features, np.repeat(n, sizes), len(own))
                    own += np.bincount((1 << BITS) + grams.scripts, n, len(own))
        for lang, own in counts.items():
            on = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(on)), pa.array(on.astype(np.int32)), pa.array(own[on].astype(np.int64))],
                ["lang", "feature", "n"])

    sums = sample(docs, per_lang, langs).transform(arrow_map, run, "lang string, feature int, n long").groupBy(
        "lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(sums.column("lang").to_pylist()))
    if not names:
        return None
    all_counts = np.zeros(((1 << BITS) + len(SCRIPTS), len(names)))
    number = {x: i for i, x in enumerate(names)}
    all_counts[sums.column("feature").to_numpy(), [number[x] for x in sums.column("lang").to_pylist()]] = sums.column("n").to_numpy()
    return Model(names, all_counts[:1 << BITS], all_counts[1 << BITS:])


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best label of every word.  ``scores`` holds the words of all documents one after the
    other, ``sizes`` their numbers; the documents advance together, word by word."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    lengths = sizes[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    langs = np.arange(scores.shape[1], dtype=np.int16)
    best, back = np.zeros((len(sizes), scores.shape[1]), np.float32), []
    for t, n in enumerate(active):
        v = best[:n]
        top = v.argmax(axis=1)
        switched = v[np.arange(n), top][:, None] - penalty
        go = switched > v
        back.append(np.where(go, top[:, None].astype(np.int16), langs))
        best[:n] = np.where(go, switched, v) + scores[starts[:n] + t]
    labels = np.zeros(len(scores), np.int16)
    at = best.argmax(axis=1).astype(np.int16)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        labels[starts[:n] + t] = at[:n]
        at[:n] = back[t][np.arange(n), at[:n]]
    return labels


SPANS = "array<struct<lang:string,first_word:int,n_words:int>>"
SPAN_TYPE = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))


class Labeller:
    """Labels texts with a model; holds a bounded cache of word scores."""

    def __init__(self, model: Model):
        self.model = model
        self.seen: dict[str, int] = {}
        self.table = np.zeros((0, len(model.langs)), np.float32)

    def _ids(self, split: list[list[str]]) -> np.ndarray:
        words = set().union(*split)
        missing = [w for w in words if w not in self.seen]
        if len(self.seen) + len(missing) > CACHE:
            self.seen, self.table, missing = {}, self.table[:0], list(words)
        self.seen.update(zip(missing, range(len(self.seen), len(self.seen) + len(missing))))
        self.table = np.concatenate([self.table, self.model.scores(missing)])
        return np.fromiter(map(self.seen.__getitem__, chain.from_iterable(split)), np.int32, sum(map(len, split)))

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[dict]]]:
        """Language, score and spans of each text."""
        names = self.model.langs
        split = [(t or "").lower().split() for t in texts]
        sizes = np.array([len(w) for w in split])
        ids = self._ids(split)
        labels, lettered = viterbi(self.table[ids], sizes), self.table[ids, 0] != 0
        preds, shares, spans, at = [], [], [], 0
        for n in sizes:
            own, on = labels[at:at + n], lettered[at:at + n]
            at += n
            votes = np.bincount(own[on], minlength=len(names))
            top, total = int(votes.argmax()), votes.sum()
            preds.append(names[top] if total else "und")
            shares.append(float(votes[top] / total) if total else 0.0)
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if total else np.empty(0, int)
            spans.append([{"lang": names[own[f]], "first_word": int(f), "n_words": int(k)}
                          for f, k in zip(first, np.diff(np.r_[first, n]))])
        return preds, shares, spans


def label(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, spans``.  The score is the share of the text's
    words with letters that lie in spans of its language."""
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        (_fold(F.col(id_col)) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    if model is None:
        return frame.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                            F.array().cast(SPANS).alias("spans"))

    def run(batches):
        labeller = Labeller(model)
        for part in slices(batches, ROWS):
            preds, shares, spans = labeller.label(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(preds), pa.array(shares, pa.float64()),
                 pa.array(spans, SPAN_TYPE)], ["doc_id", "held_out", "lang_pred", "score", "spans"])

    return frame.transform(arrow_map, run, f"doc_id long, held_out boolean, lang_pred string, score double, spans {SPANS}")


def identify(docs: DataFrame, per_lang: int = PER_LANG, langs: int = LANGS) -> DataFrame:
    """Learn from ``doc_id, text, lang`` and label every row."""
    return label(docs, train(docs.select(F.col("doc_id").alias("doc"), "lang", "text"), per_lang, langs))


def language_filter(docs: DataFrame, least: float = 0.5, keep_unjudged: bool = False) -> DataFrame:
    """The rows of ``docs`` that have a language: not ``und``, and at least ``least`` of the
    words in it.  The verdict is a property of the text and filters the pass that finds it.

    Without a labelled row to learn from no text can be judged: then none has a language, or
    with ``keep_unjudged`` the rows that have letters stay."""
    model = train(docs.select(F.col("doc_id").alias("doc"), "lang", "text"))
    if model is None:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))) if keep_unjudged else docs.limit(0)
    at = docs.columns.index("text")

    def run(batches):
        labeller = Labeller(model)
        for part in slices(batches, ROWS):
            preds, shares, _ = labeller.label(part.column(at).to_pylist())
            yield part.filter(pa.array([p != "und" and s >= least for p, s in zip(preds, shares)], pa.bool_()))

    return docs.transform(arrow_map, run, docs.schema)
