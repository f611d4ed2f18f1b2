"""Quality rules: a table of thresholds compiled into one projection.

``RULES`` names a measure and the range that it may have.  ``measures`` gives the
columns they speak of and ``judge`` turns the table into a single boolean expression;
all is done by built-in functions, without user functions and without a shuffle.

A null text counts as empty.  Empty and blank texts have no words: all counts are 0
and the row is not kept.  Rows are independent; repeated rows repeat their result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import GAP, words

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are or an at "
    "der die das und in zu den von mit ist des ein eine im dem auch "
    "le la les de des du et un une en que est pour dans qui par "
    "el los las del y que un una por con para es se"
).split()

#: (measure, least, most); None: no bound.  Shares are of words, characters or lines.
RULES: list[tuple[str, float | None, float | None]] = [
    ("n_words", 10, 1_000_000),
    ("mean_word_chars", 2.0, 15.0),
    ("symbols_per_word", None, 0.1),
    ("stop_word_share", 0.02, None),
    ("letter_word_share", 0.8, None),
    ("bullet_line_share", None, 0.9),
    ("ellipsis_line_share", None, 0.3),
    ("dup_line_share", None, 0.5),
]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_window_words(w: Column, size: int = 5) -> Column:
    """How many words stand in windows of ``size`` words that the array ``w`` has twice or more.

    Windows are compared by a 64-bit hash chained over their words.  If all are
    distinct the count is zero.  Otherwise windows are sorted by hash and place;
    equal neighbours are repeats; each place covers ``size`` words, less what the
    next place covers.  Time is n log n in the length of the text.
    """
    def chain(hashes: Column) -> Column:
        starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - F.lit(size - 1), F.lit(0)))
        return F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, size)]))

    def counted(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            same = F.filter(s, lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(s, F.greatest(k - 1, F.lit(0)))["h"])))
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        def covered(places: Column) -> Column:
            steps = F.transform(places, lambda p, k: F.least(F.lit(size), F.coalesce(F.get(places, k + 1) - p, F.lit(size))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return _let(_let(placed, repeats), covered)

    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(counted(windows))

    return _let(_let(F.transform(w, lambda x: F.xxhash64(x)), chain), count).cast("long")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a one-element transform binds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(F.col(key), t.alias("_t")).select(
        key, "_t", words(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: F.rtrim(F.translate(x, BLANKS, "")) != "").alias("_l")
    )
    n_words, n_lines = F.size("_w"), F.size("_l")
    stops = list(dict.fromkeys(STOP_WORDS))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    counted = split.select(
        key,
        n_words.cast("long").alias("n_words"),
        F.length(_without(F.col("_t"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(_without(F.col("_t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("_w")).alias("n_repeat_words"),
        n_lines.cast("long").alias("n_lines"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(*stops))).cast("long").alias("n_stop_words"),
        F.size(F.filter("_w", lambda x: F.lower(x) != F.upper(x))).cast("long").alias("n_letter_words"),
        F.size(F.filter("_l", lambda x: F.ltrim(x).startswith("- ") | F.ltrim(x).startswith("* "))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_l", lambda x: F.rtrim(x).endswith("..."))).cast("long").alias("n_ellipsis_lines"),
    )
    c = F.col
    return counted.select(
        "*",
        share(c("word_chars"), c("n_words")).alias("mean_word_chars"),
        share(c("n_symbols"), c("n_words")).alias("symbols_per_word"),
        share(c("n_stop_words"), c("n_words")).alias("stop_word_share"),
        share(c("n_letter_words"), c("n_words")).alias("letter_word_share"),
        share(c("n_bullet_lines"), c("n_lines")).alias("bullet_line_share"),
        share(c("n_ellipsis_lines"), c("n_lines")).alias("ellipsis_line_share"),
        share(c("n_dup_lines"), c("n_lines")).alias("dup_line_share"),
    )


def judge(rules=RULES) -> Column:
    """The threshold table as one expression."""
    verdict = F.lit(True)
    for measure, least, most in rules:
        if least is not None:
            verdict = verdict & (F.col(measure) >= F.lit(least))
        if most is not None:
            verdict = verdict & (F.col(measure) <= F.lit(most))
    return verdict


def judged(docs: DataFrame, rules=RULES) -> DataFrame:
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    return measures(docs).withColumn("base_failed", failed).withColumn("kept", ~failed & judge(rules))


__all__ = ["GAP", "RULES", "judge", "judged", "measures", "repeated_window_words"]
