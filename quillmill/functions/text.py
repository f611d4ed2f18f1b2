"""Text functions: built-in expressions, and a few Arrow functions for what Spark lacks."""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

WORD = r"(?U)[^\W_]+"


def tokens(text: Column, least: int = 2) -> Column:
    """Distinct words in order, in lower case, of at least so many characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.length(w) >= least))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def key_phrases(words: Column, sizes: tuple[int, ...] = (4, 3, 2), most: int = 12) -> Column:
    """Word groups of the sizes given, in that order, distinct, the first few."""
    groups = []
    for k in sizes:
        starts = F.slice(words, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))
        groups.append(F.transform(starts, _joined_from(words, k)))
    return F.slice(F.array_distinct(F.concat(*groups)), 1, most)


def _joined_from(words: Column, k: int):
    return lambda _, i: F.array_join(F.slice(words, i + 1, k), " ")


def character_grams(text: Column, k: int = 3) -> Column:
    """Distinct character groups of letters and digits; a short text is one group."""
    s = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (k - 1), F.lit(1))), lambda i: F.substring(s, i, k)))
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(many)


def overlap(a: Column, b: Column) -> Column:
    """Shared part of the smaller set."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def slug(text: Column, most: int = 96) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, most), F.lit("")), F.lit("document"))


def logical_id(scope: Column, country: Column, language: Column, kind: Column, name: Column) -> Column:
    return F.concat_ws(":", F.lower(scope), F.upper(country), F.lower(language), F.lower(kind), slug(name))


def locale_key(language: Column) -> Column:
    return F.lower(F.split_part(language, F.lit("-"), F.lit(1)))


def section_reference(text: Column) -> Column:
    """The number of a section that a text speaks of, with dots."""
    return F.translate(F.regexp_extract(F.lower(text), r"(?:§|section|sec\.?)\s*(\d+(?:[.-]\d+)*)", 1), "-", ".")


def expanded_pages(pages: Column) -> Column:
    """Page numbers of a list such as "3-5, 9": distinct, in order."""
    parts = F.filter(F.transform(F.split(pages, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d+(-\d+)?$"))
    first = lambda p: F.regexp_extract(p, r"^(\d+)", 1).cast("int")
    last = lambda p: F.regexp_extract(p, r"(\d+)$", 1).cast("int")
    ranges = F.transform(parts, lambda p: F.sequence(first(p), F.greatest(first(p), last(p))))
    return F.array_sort(F.array_distinct(F.flatten(ranges)))


def unbalanced(text: Column) -> Column:
    """Do brackets lack their partner?"""
    count = lambda c: F.length(text) - F.length(F.translate(text, c, ""))
    return (count("(") != count(")")) | (count("[") != count("]"))


# What follows needs Python: Unicode normal forms, checksums, a stateful parser.


@F.pandas_udf(StringType())
def folded(texts: pd.Series) -> pd.Series:
    """NFKC, case folding, single spaces."""
    return texts.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


@F.pandas_udf(StringType())
def without_accents(texts: pd.Series) -> pd.Series:
    def strip(x: str | None) -> str | None:
        return None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))

    return texts.map(strip)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid_iban(text: str) -> bool:
    s = re.sub(r"[\s-]", "", text).upper()
    if not 15 <= len(s) <= 34 or not (s.isascii() and s[:2].isalpha() and s[2:4].isdigit() and s.isalnum()):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


#: What is redacted, in this order: a pattern, the label, and for some a checksum that must be right.
REDACTED = (
    (r"(?<!\d)\d{3}[- ]?\d{2}[- ]?\d{4}(?!\d)", "[GOVERNMENT_ID]", None),
    (r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)", "[PAYMENT_CARD]", "card"),
    (r"(?i)(?<![A-Z0-9])(?:[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]){11,30})(?![A-Z0-9])", "[BANK_ACCOUNT]", "account"),
    (r"(?<![\w.+-])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}(?![\w-])", "[EMAIL]", None),
    (r"(?<!\w)(?:\+?\d[\d\s().-]{5,}\d)(?!\w)", "[PHONE]", None),
)
_CHECKS = {"card": lambda x: len(x) >= 13 and luhn(re.sub(r"\D", "", x)), "account": valid_iban}
_REDACTED = [(re.compile(p), label, _CHECKS.get(check)) for p, label, check in REDACTED]


def _labelled(found: str, label: str, check) -> str:
    """The label for what was found, or for its longest part, from the start up to a gap, whose checksum is right."""
    if check is None or check(found):
        return label
    for end in [m.start() for m in re.finditer(r"[ -]", found)][::-1]:
        if check(found[:end]):
            return label + found[end:]
    return found


def redact(text: str, only: tuple[str, ...] | None = None) -> str:
    """Ids, cards and accounts with a right checksum, addresses and phone numbers become labels (or those of ``only``).

    A word that follows an account number does not hide it.
    """
    for pattern, label, check in _REDACTED:
        if only is not None and label not in only:
            continue
        text = pattern.sub(lambda m: _labelled(m[0], label, check), text)  # noqa: B023
    return text


@F.pandas_udf(StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else redact(x))


def redacted(text: str) -> Column:
    """``redact`` of a column; what has neither a digit nor an at sign is as it was."""
    return F.when(F.col(text).rlike("[@\\p{Nd}]"), _redacted(F.col(text))).otherwise(F.col(text))


def osa_distance(a: str, b: str, most: int) -> int:
    """Edits with swaps of neighbours; more than ``most`` is ``most`` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


@F.pandas_udf(IntegerType())
def edit_distance(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([osa_distance(x or "", y or "", int(m)) for x, y, m in zip(a, b, most, strict=True)])


#: Tags that stay, tags that go with what is in them, and schemes of links.
KEPT_TAGS = ("a", "b", "blockquote", "br", "code", "em", "h1", "h2", "h3", "h4", "hr", "i", "li", "ol", "p", "pre", "span", "strong", "table", "tbody", "td", "th", "thead", "tr", "u", "ul")
DROPPED_TAGS = ("script", "style", "iframe", "object", "embed", "noscript", "template", "svg", "math", "form")
EMPTY_TAGS = ("br", "hr")
SCHEMES = ("http", "https", "mailto", "tel")


class _Cleaner(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.dropping: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.dropping or tag in DROPPED_TAGS:
            if tag in DROPPED_TAGS and tag != "embed":
                self.dropping.append(tag)
            return
        if tag not in KEPT_TAGS:
            return
        shown = ""
        if tag == "a":
            given = dict(attrs)
            link = (given.get("href") or "").strip()
            scheme = re.match(r"([a-zA-Z][\w+.-]*):", link)
            if link and (scheme is None or scheme[1].lower() in SCHEMES):
                shown = f' href="{html.escape(link)}"'
            if given.get("target") == "_blank":
                shown += ' target="_blank" rel="noopener noreferrer"'
        self.out.append(f"<{tag}{shown}>")
        if tag not in EMPTY_TAGS:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.dropping:
            if tag == self.dropping[-1]:
                self.dropping.pop()
            return
        if tag in self.open:
            while self.open:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.dropping:
            self.out.append(html.escape(data, quote=False))


def sanitise(text: str) -> str:
    """Allowed tags and links only, escaped text, and every tag closed."""
    cleaner = _Cleaner()
    cleaner.feed(text)
    cleaner.close()
    cleaner.out += [f"</{t}>" for t in reversed(cleaner.open)]
    return "".join(cleaner.out)


@F.pandas_udf(StringType())
def sanitised(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else sanitise(x))


@F.pandas_udf(StringType())
def plain_html(texts: pd.Series) -> pd.Series:
    """Text of a page: tags become spaces, entities characters, white space single."""
    return texts.map(lambda x: None if x is None else " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", x))).split()))
