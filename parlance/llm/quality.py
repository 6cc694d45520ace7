"""Quality rules with adaptive thresholds, on DataFrame functions only.

Per document: counts over its whole text.  Per (language, source): a mergeable KLL
quantile sketch of each ratio.  The threshold of a ratio is its median plus a multiple of
its spread, read from both sides of the sketch: from the median down to the first decile, and up to the last
one, but at most ``CAP`` times the former, so that junk in the upper part of a group can't
widen its own bound by more.
Sketches of groups with fewer than ``min_rows`` documents are too thin; the merged sketch
of the language, then of everything, takes their place.  The thresholds are joined to the
documents, which they filter beside the base rules.

Defined results: a null or empty text has zero counts and fails the base rules; null
languages and sources are groups of their own; every input row gives one output row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import ASCII_SPACE, stored

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Ratios under adaptive thresholds: (numerator, denominator, smallest spread).
#: A group whose ratio hardly varies still tolerates ``REACH`` times the smallest spread.
RATIOS = {
    "symbol_ratio": ("n_symbols", "word_chars", 0.0075),
    "mark_ratio": ("n_marks", "word_chars", 0.003),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 0.045),
    "repeat_ratio": ("n_repeat_words", "n_words", 0.0225),
    "upper_ratio": ("n_upper", "word_chars", 0.003),
}
#: How far the upper side's spread may exceed the lower side's.
CAP = 3.0
#: Size parameter of the sketches (rank error near 0.4 %), and documents that a group needs.
SKETCH_K, MIN_ROWS, REACH = 800, 200, 8.0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once (a lambda variable is never inlined)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(windows: Column) -> Column:
    """Words in the windows whose hash occurs twice or more, each counted once."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = _let(ordered, lambda s: F.filter(s, lambda x, j: (
        F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))))
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    return F.aggregate(
        places, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"])


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of every whole text as columns; ``text_col`` may be null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    long = lambda c: c.cast("long")
    words = docs.withColumn("_words", F.array_remove(F.split(text, ASCII_SPACE + "+"), ""))
    lines = words.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.translate(
        x, " \t\x0b\x0c\r", "") != ""))
    hashes = lines.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    # 64-bit hashes of the 5-word windows of one text
    h = F.col("_hashes")
    starts = F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
    windows = hashes.withColumn("_windows", F.transform(
        starts, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW)))))
    w = F.col("_windows")
    return windows.select(
        *docs.columns,
        long(F.size("_words")).alias("n_words"),
        long(F.char_length(F.translate(text, " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
        long(F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("_lines")).alias("n_lines"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        long(F.when(F.size(F.array_distinct(w)) < F.size(w), _repeat_words(w)).otherwise(0)).alias("n_repeat_words"),
        long(F.char_length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", ""))).alias("n_marks"),
        long(F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))).alias("n_upper"))


def _stratum(lang: str, source: str) -> list[Column]:
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return [key(lang).alias("lang_key"), key(source).alias("source_key")]


def thresholds(rows: DataFrame, min_rows: int = MIN_ROWS, reach: float = REACH) -> DataFrame:
    """Upper bound of each ratio per (lang_key, source_key), from merged sketches."""
    ratio = lambda r: F.col(RATIOS[r][0]) / F.nullif(F.col(RATIOS[r][1]), F.lit(0))
    usable = rows.filter("n_words > 0")
    groups = usable.groupBy("lang_key", "source_key").agg(
        F.count("*").alias("n"),
        *(F.kll_sketch_agg_double(F.coalesce(ratio(r), F.lit(0.0)), F.lit(SKETCH_K)).alias(r) for r in RATIOS))
    groups = stored(groups, "quality-sketches")
    # one row per group from here on: its own sketches, or the merged ones of its language or of all
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(r, F.lit(SKETCH_K)).alias(r) for r in RATIOS)]
    langs = groups.groupBy("lang_key").agg(*merged)
    every = langs.agg(*merged).first()  # one sketch per ratio, a few KB each
    joined = groups.join(langs.select("lang_key", F.col("n").alias("lang_n"),
                                      *(F.col(r).alias(f"lang_{r}") for r in RATIOS)), "lang_key")

    def bound(r: str) -> Column:
        sketch = (F.when(F.col("n") >= min_rows, F.col(r))
                  .when(F.col("lang_n") >= min_rows, F.col(f"lang_{r}"))
                  .otherwise(F.lit(every[r])))
        middle = F.kll_sketch_get_quantile_double(sketch, F.lit(0.5))
        low = middle - F.kll_sketch_get_quantile_double(sketch, F.lit(0.1))
        high = F.least(F.kll_sketch_get_quantile_double(sketch, F.lit(0.9)) - middle, CAP * low)
        return (middle + reach * F.greatest(low, high, F.lit(RATIOS[r][2]))).alias(f"max_{r}")

    return stored(joined.select("lang_key", "source_key", *(bound(r) for r in RATIOS)), "quality-thresholds")


def verdicts(docs: DataFrame, min_rows: int = MIN_ROWS, reach: float = REACH, carry: tuple = (),
             id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             source_col: str = "source") -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and the failed ratios of every document.

    The texts are read once; the counts are stored, sketched and joined to their bounds.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(c.alias(n) for n, c in carry),
                        *_stratum(lang_col, source_col), F.col(text_col).alias("_text"))
    rows = stored(features(given, "_text").drop("_text"), "quality-counts")
    bounds = thresholds(rows, min_rows, reach)
    judged = rows.join(bounds, ["lang_key", "source_key"], "left")
    over = {r: F.coalesce(F.col(top) > F.col(f"max_{r}") * F.col(of), F.lit(False))
            for r, (top, of, _) in RATIOS.items()}
    failed = F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in over.items())))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select(
        "doc_id", *(n for n, _ in carry), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), failed.alias("failed_ratios"))


def quality_filter(docs: DataFrame, min_rows: int = MIN_ROWS, reach: float = REACH) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns.

    A verdict belongs to an id with its text, language and source; rows that repeat all
    four have the same verdict and stay or go together.
    """
    same = F.xxhash64(F.to_json(F.struct("doc_id", "lang", "source"), {"ignoreNullFields": "false"}), F.col("text"))
    name = "_same"
    while name in docs.columns:
        name += "_"
    kept = verdicts(docs, min_rows, reach, carry=((name, same),)).filter("kept").select(name).distinct()
    return docs.withColumn(name, same).join(kept, name, "left_semi").select(*docs.columns)
