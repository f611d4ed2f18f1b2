"""Personal data masked unless an approved text holds it: entity spans, e-mail addresses and telephone numbers.

What a text gives is *grounded* if the approved text has it as it stands, without regard to case and
punctuation, as the same run of seven digits or more, or by four fifths of its words (two at least).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmill.functions import text as T
from quillmill.plans.catalogue import register
from quillmill.sources.views import table

#: What is masked without exception, what an approved text keeps, and the marks that are taken out of an answer.
ALWAYS = ("[GOVERNMENT_ID]", "[PAYMENT_CARD]", "[BANK_ACCOUNT]")
KEPT_IF_GROUNDED = ("[EMAIL]", "[PHONE]")
SENSITIVE = ("BANK_ACCOUNT", "CREDIT_DEBIT_NUMBER", "GOVERNMENT_ID", "PAYMENT_CARD", "SSN")
MARK = r"\[(?:ADDRESS|EMAIL|PHONE|NAME|PII)\]"
_WORDS = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_WORDS), F.lit(0)))


def loose(text: Column) -> Column:
    """Lower case, with one space for all that is no letter, digit or underscore."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def approved_forms(text: Column) -> Column:
    """The forms of an approved text that entities are compared with, made once a row."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.lower(t).alias("plain"), loose(t).alias("loose"), digits(t).alias("digits"), words(t).alias("words"))


def grounded(entity: Column, forms: Column) -> Column:
    e = F.trim(F.lower(entity))
    own, in_common = words(e), F.size(F.array_intersect(words(e), forms["words"]))
    return (e != "") & (
        F.contains(forms["plain"], e)
        | (loose(e) != "") & F.contains(forms["loose"], loose(e))
        | (F.length(digits(e)) >= 7) & F.contains(forms["digits"], digits(e))
        | (F.size(own) >= 2) & (in_common >= 2) & (in_common >= 0.8 * F.size(own))
    )


def replaced(text: Column, pattern: str, label: str, keep) -> Column:
    """Matches of a pattern become ``label`` unless ``keep`` holds for them; gaps and matches are joined once."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    said = F.transform(found, lambda m: F.when(keep(m), m).otherwise(label))
    pairs = F.zip_with(gaps, said, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(pairs, "")).otherwise(text)


@F.pandas_udf(StringType())
def without_numbers(texts: pd.Series) -> pd.Series:
    """Identity, card (checksum right) and account numbers masked."""
    return texts.map(lambda x: None if x is None else T.redact(x, ALWAYS))


def scrubbed_patterns(rows: DataFrame, text: str, approved: str) -> DataFrame:
    """``rows`` with ``scrubbed``: identity, card and account numbers always masked, addresses and telephone numbers if they aren't grounded."""
    pattern = {label: f"(?U){p}" for p, label, _ in T.REDACTED}  # letters and digits of all scripts
    out = rows.withColumn("scrubbed", without_numbers(F.coalesce(text, F.lit("")))).withColumn("_forms", approved_forms(F.col(approved)))
    for label in KEPT_IF_GROUNDED:
        out = out.withColumn("scrubbed", replaced(F.col("scrubbed"), pattern[label], label, lambda m: grounded(m, F.col("_forms"))))
    return out.drop("_forms")


def place_name(entity: Column) -> Column:
    """One to four words without a digit: a place and no street address."""
    return ~entity.rlike(r"\p{N}") & F.size(F.regexp_extract_all(entity, F.lit(_WORDS), F.lit(0))).between(1, 4)


def scrubbed_spans(text: Column, spans: Column, forms: Column, names: Column | None = None, keep_places: bool = False, keep_people: bool = False) -> Column:
    """Spans (``start``, ``stop``, ``kind``) of entities become their kind, unless grounded.

    ``names`` are forms that ground names only.  Spans that begin within an earlier one are left out; the text is
    put together once, whatever the number of spans.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.upper(F.coalesce(s["kind"], F.lit("PII"))).alias("kind"))))
    none = F.array().cast("array<struct<start:int,stop:int,kind:string>>")
    apart = F.aggregate(order, none, lambda kept, s: F.when((F.size(kept) > 0) & (s["start"] < F.element_at(kept, -1)["stop"]), kept).otherwise(F.array_append(kept, s)))
    entity = lambda s: F.substring(text, s["start"] + 1, s["stop"] - s["start"])

    def stays(s: Column) -> Column:
        ok = grounded(entity(s), forms)
        if names is not None:
            ok = ok | (s["kind"] == "NAME") & grounded(entity(s), names)
        if keep_places:
            ok = ok | s["kind"].isin("ADDRESS", "LOCATION") & place_name(entity(s))
        return ok | (s["kind"] == "NAME") if keep_people else ok

    masked = F.filter(apart, lambda s: ~stays(s))
    piece = lambda s, i: F.concat(F.substring(text, F.coalesce(F.get(masked, i - 1)["stop"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(masked, i - 1)["stop"], F.lit(0))), F.lit("["), s["kind"], F.lit("]"))
    rest = F.substring(text, F.element_at(masked, -1)["stop"] + 1, F.length(text))
    return F.when(F.size(masked) > 0, F.concat(F.array_join(F.transform(masked, piece), ""), rest)).otherwise(text)


def sensitive(text: Column) -> Column:
    """Does a masked text hold a mark of high risk?"""
    marks = F.regexp_extract_all(text, F.lit(r"(?i)\[([A-Z_]+)\]"), F.lit(1))
    return F.exists(marks, lambda m: F.upper(m).isin(*SENSITIVE))


def without_marks(text: Column) -> Column:
    """An answer without marks: lines that only label one go, others are closed up."""

    def line(x: Column) -> Column:
        x = F.regexp_replace(x, rf"(?i)\s*{MARK}(?:\s*,\s*{MARK})*", "")
        x = F.regexp_replace(F.regexp_replace(x, r"\(\s*\)", ""), r"\s{2,}", " ")
        return F.regexp_replace(F.trim(x), r"\s+([,.;:!?])", "$1")

    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: ~x.rlike(rf"(?i){MARK}\s*:"))
    return F.when(F.contains(text, F.lit("[")), F.array_join(F.filter(F.transform(lines, line), lambda x: x != ""), "\n")).otherwise(text)


@register("grounded_scrub")
def grounded_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scrubbed, where the first document of its source is what is approved."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    first = d.groupBy("source").agg(F.min_by("text", "doc_id").alias("approved")).withColumnRenamed("source", "of")
    pairs = d.join(first, F.col("source").eqNullSafe(F.col("of")), "left")
    out = scrubbed_patterns(pairs, "text", "approved")
    marks = F.size(F.regexp_extract_all("scrubbed", F.lit(r"\[(?:GOVERNMENT_ID|PAYMENT_CARD|BANK_ACCOUNT|EMAIL|PHONE)\]"), F.lit(0)))
    return out.select("doc_id", marks.alias("marks"), sensitive(F.col("scrubbed")).alias("sensitive"), F.sha2("scrubbed", 256).alias("scrubbed_hash"))
