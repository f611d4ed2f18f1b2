"""Repairs of mistyped words from a known vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import edit_distance, osa_distance
from quillmill.sources.views import table

#: Marks of three bytes that were read one byte a letter, and what stands for them; letters that tell of such a reading.
MISREAD = {"â€™": "'", "â€œ": '"', "â€\ufffd": '"', "â€“": "-", "â€”": "-"}
MISREAD_SIGNS = "[âÃÂ]"


def repaired_encoding(text: Column) -> Column:
    """A text whose UTF-8 bytes were read as one letter each, read again; any other text stays as it is.

    Known marks are replaced first.  What is left is read again as a whole where it has a sign of such a reading, all its
    letters are single bytes, and the bytes are valid UTF-8; null stays null.
    """
    for wrong, right in MISREAD.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    single = text.rlike(MISREAD_SIGNS) & text.rlike(r"\A[\x{00}-\x{FF}]*\z")
    # letters beyond one byte are left out of what is encoded, since Spark may evaluate it where the condition is false
    data = F.encode(F.regexp_replace(text, r"[^\x{00}-\x{FF}]", ""), "ISO-8859-1")
    return F.when(single, F.coalesce(F.try_validate_utf8(data.cast("string")), text)).otherwise(text)


def deletions(word: Column) -> Column:
    """The word and all of it but one letter: words within one edit or swap share one of these."""
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))))


def repair_candidates(spark: SparkSession, sf_dir: str, least: int = 8) -> DataFrame:
    """For each long word of a question, the words of other questions at one edit; words with digits stay as they are."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{%d,}" % least), F.lit(0)))
    w = table(spark, sf_dir, "benchmark").select("item_id", F.explode(words).alias("word"))
    known = w.select("word").distinct().select("word", F.explode(deletions(F.col("word"))).alias("d"))
    pairs = known.join(known.select(F.col("word").alias("other"), "d"), "d").filter("word <> other").select("word", "other").distinct()
    near = pairs.withColumn("distance", edit_distance("word", "other", F.lit(1))).filter("distance <= 1")
    return w.join(near, "word").select("item_id", "word", "other", "distance")


def repaired_query(query: str, planned: list[str]) -> str:
    """A query with mistyped words replaced by planned ones.

    Words with digits and short capitals stay.  One edit is allowed below ten letters,
    two from there, and a word may be two or three planned ones written together.
    """
    known = [p.lower() for p in dict.fromkeys(planned)]
    out = []
    for word in query.split():
        low = word.lower()
        if low in known or any(c.isdigit() for c in word) or (word.isupper() and 2 <= len(word) <= 5):
            out.append(word)
            continue
        most = 1 if len(low) < 10 else 2
        near = sorted((osa_distance(low, k, most), k) for k in known if len(k) > 3)
        if near and near[0][0] <= most and (len(near) == 1 or near[1][0] > near[0][0]):
            out.append(near[0][1])
        else:
            out.append(" ".join(_split_word(low, known, 3)) or word)
    return " ".join(out)


def _split_word(word: str, known: list[str], most: int) -> list[str]:
    """Two to ``most`` known words that make up a word, if there are any."""
    for k in known:
        if len(k) > 2 and word.startswith(k) and len(k) < len(word):
            rest = word[len(k) :]
            if rest in known:
                return [k, rest]
            if most > 2 and (more := _split_word(rest, known, most - 1)):
                return [k, *more]
    return []


def scrubbed(text: str, spans: list[tuple[int, int, str]], approved: str = "", kept: tuple[str, ...] = ()) -> str:
    """Spans of entities replaced by their kind, from right to left; kinds in ``kept`` and what the approved text holds stay."""
    plain = lambda x: "".join(c for c in x.lower() if c.isalnum())
    grounds = plain(approved)
    for start, end, kind in sorted(spans, reverse=True):
        found = plain(text[start:end])
        if kind in kept or (found and found in grounds):
            continue
        text = f"{text[:start]}[{kind}]{text[end:]}"
    return text


def joined_characters(text: str) -> str:
    """Text whose letters stand apart ("h e l l o   w o r l d"): at least eight parts, and most of them single characters."""
    parts = text.split()
    if len(parts) < 8 or sum(len(p) == 1 for p in parts) < 0.65 * len(parts):
        return text
    return " ".join("".join(w.split()) for w in text.replace("   ", "  ").split("  ") if w.strip())


def phrase_intent(text: str, phrases: list[str], joiners: tuple[str, ...] = ("and", "or")) -> bool:
    """Is a message one of the controlled phrases: exactly, with a slip in a short one, or two or three of them joined?"""
    low, known = " ".join(text.lower().split()), [p.lower() for p in phrases]
    if low in known:
        return True
    if len(low) <= 32 and len(low.split()) <= 3 and any(low[:1] == k[:1] and osa_distance(low, k, 1) <= 1 for k in known):
        return True
    parts = [low]
    for j in joiners:
        parts = [q for p in parts for q in p.split(f" {j} ")]
    return 2 <= len(parts) <= 3 and all(p in known for p in parts)
