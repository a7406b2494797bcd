"""Quality rules: a threshold table compiled into one projection, with built-in functions only.

Measures of a text are column expressions; THRESHOLDS names a measure, its bounds and, where a
ratio means little in a short text, the words from which it counts. A text is kept if it passes
the base rules and every row of the table.

A null text counts as empty (no words, so it fails). Texts of any length are measured whole: the
repeated windows are found by sorting the text's own window hashes, not by comparing all pairs.
Only doc_id and text are read; the other columns are kept apart and can't clash. An empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import WORD_SPACE

SYMBOLS = r"[#*$%&|<>]"
SHOUT = r"[!?]"
WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Frequent function words of the four languages (fixed values).
STOP_WORDS = (
    "the of and to in is that it was for on are with as his they be at one have this from or had by but "
    "le la les de des du et en un une que qui est dans pour par sur au avec ne pas ce il elle "
    "der die das und den von zu mit sich des auf ist im dem nicht ein eine er sie als auch es an wie "
    "el los las del y por se con no su para al lo como más pero sus una"
).split()


@dataclass(frozen=True)
class Threshold:
    """Keep a text only if low <= measure <= high, from `words` words on."""

    measure: str
    low: float | None = None
    high: float | None = None
    words: int = MIN_WORDS


THRESHOLDS = (
    Threshold("mean_word_chars", low=2.0, high=14.0),
    Threshold("symbols_per_word", high=0.35),
    Threshold("shouts_per_word", high=0.35),
    Threshold("dup_line_ratio", high=0.5, words=100),
    Threshold("stop_word_ratio", low=0.04, words=100),
)


def measured(docs: DataFrame) -> DataFrame:
    """The base counts and the ratios of each document; its own columns stay together in `row`."""
    df = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    df = df.withColumn("words", F.filter(F.split("text", WORD_SPACE), lambda w: w != ""))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("words")
    k = WINDOW_WORDS
    hashes = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice("words", i, k)))
    df = df.withColumn("windows", F.when(n >= k, hashes).otherwise(F.array().cast("array<long>")))
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.withColumn("placed", F.when(repeats, placed))
    same = lambda p, j: F.coalesce(F.get("placed", j)["h"] == p["h"], F.lit(False))
    twin = lambda p, j: same(p, j - 1) | same(p, j + 1)
    df = df.withColumn("starts", F.array_sort(F.transform(F.filter("placed", twin), lambda p: p["i"])))
    first = F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("starts", first, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(k), x - a["last"])).alias("n")), lambda a: a["n"])
    folded = F.transform("words", lambda w: F.lower(w))
    df = df.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("text") - F.length(F.regexp_replace("text", SHOUT, ""))).cast("long").alias("n_shouts"),
        F.size(F.filter(folded, lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.array_distinct(folded)).cast("long").alias("n_distinct_words"),
    )
    per_word = lambda c: F.col(c) / F.greatest("n_words", F.lit(1))
    return df.withColumns(
        {
            "mean_word_chars": per_word("word_chars"),
            "symbols_per_word": per_word("n_symbols"),
            "shouts_per_word": per_word("n_shouts"),
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
            "stop_word_ratio": per_word("n_stop_words"),
            "distinct_word_ratio": per_word("n_distinct_words"),
        }
    )


def passes(rules=THRESHOLDS) -> Column:
    """The table as one predicate over the measures."""
    ok = F.lit(True)
    for t in rules:
        inside = F.lit(True)
        if t.low is not None:
            inside = inside & (F.col(t.measure) >= t.low)
        if t.high is not None:
            inside = inside & (F.col(t.measure) <= t.high)
        ok = ok & ((F.col("n_words") < t.words) | inside)
    return ok


def _verdicts(docs: DataFrame, rules) -> DataFrame:
    """row, the measures, base_failed and kept of each document.

    They come out of a generator: a filter on a plain projection would be pushed below it, and the
    nested measures written out again for every place that names them.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    df = measured(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passes(rules))
    return df.select("row", F.inline(F.array(F.struct(*[c for c in df.columns if c != "row"]))))


def judged(docs: DataFrame, rules=THRESHOLDS) -> DataFrame:
    """doc_id, the measures, base_failed and kept of each document."""
    df = _verdicts(docs.select("doc_id", "text"), rules)
    return df.select("row.doc_id", *[c for c in df.columns if c != "row"])


def passing(docs: DataFrame, rules=THRESHOLDS) -> DataFrame:
    """The documents that are kept, with their columns."""
    return _verdicts(docs, rules).where("kept").select("row.*")
