"""Small helpers that cut one text into sections and chunks; Spark deals the texts."""

from __future__ import annotations

import re

#: Longest chunk and overlap of each profile.
PROFILES = {"current": (4500, 450), "next": (2000, 200)}

_NUMBERED = re.compile(r"^\s*(?:section\s+)?(\d+(?:\.\d+)*)[.)]?\s+(\S.*)$", re.IGNORECASE)
_PAGE_NUMBER = re.compile(r"^\s*(?:page\s+)?\d{1,4}(?:\s+of\s+\d{1,4})?\s*$", re.IGNORECASE)
_SENTENCE_END = re.compile(r"[.!?;:]\s*$")
_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)]|[a-z][.)])\s+(.{24,})$")
_DEFINITION = re.compile(r"^\s*([A-Z][^:\n]{1,60}):\s+(\S.{7,})$")


def bounded_chunks(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of chunks of at most ``most`` characters.

    A chunk ends at the last line or sentence end in its second half, where there is
    one; the next begins ``overlap`` characters before, at the start of a word.
    """
    most, out, start = max(most, 200), [], 0
    overlap = min(max(overlap, 0), most // 2 - 1)
    while start < len(text):
        end = min(start + most, len(text))
        if end < len(text):
            half = start + most // 2
            line, sentence = text.rfind("\n", half, end), text.rfind(". ", half, end)
            at = max(line + 1, sentence + 2 if sentence >= 0 else 0)
            end = at if at > half else end
        out.append((start, end))
        if end == len(text):
            break
        back = max(end - overlap, start + 1)
        space = re.compile(r"\s").search(text, back, end) if overlap else None
        start = space.end() if space and space.end() < end else (back if overlap else end)
    return out


def clean_page(text: str) -> str:
    """Without lines that only hold a page number, and with single blank lines."""
    lines = [x.rstrip() for x in text.split("\n") if not _PAGE_NUMBER.match(x)]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def heading(line: str) -> tuple[str, str] | None:
    """Number (or nothing) and title of a heading line: a dotted number, or a short line of capitals."""
    s = line.strip()
    if not s or len(s) > 120:
        return None
    if (m := _NUMBERED.match(s)) and ("." in m[1] or not _SENTENCE_END.search(s)):
        return m[1], m[2]
    letters = [c for c in s if c.isalpha()]
    if len(letters) >= 4 and sum(c.isupper() for c in letters) >= 0.75 * len(letters):
        return "", s
    return None


def contents_page(text: str) -> bool:
    """Many headings, most of them led by dots to a page, or standing close together."""
    lines = [x for x in text.split("\n") if x.strip()]
    heads = [x for x in lines if heading(x)]
    dotted = sum(bool(re.search(r"\.{3,}\s*\d+\s*$", x)) for x in lines)
    close = len(heads) >= 0.75 * len(lines) and sum(map(len, lines)) <= 160 * max(len(lines), 1)
    return len(heads) >= 6 and (dotted >= 3 or close)


def sections(text: str, least: int = 40) -> list[tuple[str, str, int, int]]:
    """Number, title, start and end of the sections that headings open, each up to the next."""
    found, at = [], 0
    for line in text.split("\n"):
        if h := heading(line):
            found.append((h[0], h[1][:160], at))
        at += len(line) + 1
    if not found or found[0][2] > 0:
        found.insert(0, ("", "", 0))
    ends = [s for _, _, s in found[1:]] + [len(text)]
    return [(n, t, s, e) for (n, t, s), e in zip(found, ends, strict=True) if e - s >= least]


def children(text: str) -> list[tuple[str, str]]:
    """Kind and text of what stands for itself in a section: definitions, list items, lines with figures."""
    out, facts = [], []
    for line in text.split("\n"):
        if m := _DEFINITION.match(line):
            out.append(("definition", f"{m[1]}: {m[2]}"))
        elif m := _ITEM.match(line):
            out.append(("list_item", m[1]))
        elif 12 <= len(line.strip()) <= 360 and re.search(r"\d", line) and re.search(r"[^\W\d_]", line):
            facts.append(("numeric_fact", line.strip()))
    return out + (facts if len(facts) >= 2 else [])


_NUMBER = re.compile(r"^\s*(?:page\s+)?\d{1,4}(?:\s+of\s+\d{1,4})?\s*$", re.IGNORECASE)
_SENTENCE_END = re.compile(r"[.!?;:]\s*$")
_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)]|[a-z][.)])\s+(.{24,})$")
_DEFINITION = re.compile(r"^\s*([A-Z][^:\n]{1,60}):\s+(\S.{7,})$")


def bounded_chunks(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of chunks of at most ``most`` characters.

    A chunk ends at the last line or sentence end in its second half, where there is
    one; the next begins ``overlap`` characters before, at the start of a word.
    """
    most, out, start = max(most, 200), [], 0
    overlap = min(max(overlap, 0), most // 2 - 1)
    while start < len(text):
        end = min(start + most, len(text))
        if end < len(text):
            half = start + most // 2
            line, sentence = text.rfind("\n", half, end), text.rfind(". ", half, end)
            at = max(line + 1, sentence + 2 if sentence >= 0 else 0)
            end = at if at > half else end
        out.append((start, end))
        if end == len(text):
            break
        back = max(end - overlap, start + 1)
        space = re.compile(r"\s").search(text, back, end) if overlap else None
        start = space.end() if space and space.end() < end else (back if overlap else end)
    return out


def clean_page(text: str) -> str:
    """Without lines that only hold a page number, and with single blank lines."""
    lines = [x.rstrip() for x in text.split("\n") if not _PAGE_NUMBER.match(x)]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def heading(line: str) -> tuple[str, str] | None:
    """Number (or nothing) and title of a heading line: a dotted number, or a short line of capitals."""
    s = line.strip()
    if not s or len(s) > 120:
        return None
    if (m := _NUMBERED.match(s)) and ("." in m[1] or not _SENTENCE_END.search(s)):
        return m[1], m[2]
    letters = [c for c in s if c.isalpha()]
    if len(letters) >= 4 and sum(c.isupper() for c in letters) >= 0.75 * len(letters):
        return "", s
    return None


def contents_page(text: str) -> bool:
    """Many headings, most of them led by dots to a page, or standing close together."""
    lines = [x for x in text.split("\n") if x.strip()]
    heads = [x for x in lines if heading(x)]
    dotted = sum(bool(re.search(r"\.{3,}\s*\d+\s*$", x)) for x in lines)
    close = len(heads) >= 0.75 * len(lines) and sum(map(len, lines)) <= 160 * max(len(lines), 1)
    return len(heads) >= 6 and (dotted >= 3 or close)


def sections(text: str, least: int = 40) -> list[tuple[str, str, int, int]]:
    """Number, title, start and end of the sections that headings open, each up to the next."""
    found, at = [], 0
    for line in text.split("\n"):
        if h := heading(line):
            found.append((h[0], h[1][:160], at))
        at += len(line) + 1
    if not found or found[0][2] > 0:
        found.insert(0, ("", "", 0))
    ends = [s for _, _, s in found[1:]] + [len(text)]
    return [(n, t, s, e) for (n, t, s), e in zip(found, ends, strict=True) if e - s >= least]


def children(text: str) -> list[tuple[str, str]]:
    """Kind and text of what stands for itself in a section: definitions, list items, lines with figures."""
    out, facts = [], []
    for line in text.split("\n"):
        if m := _DEFINITION.match(line):
            out.append(("definition", f"{m[1]}: {m[2]}"))
        elif m := _ITEM.match(line):
            out.append(("list_item", m[1]))
        elif 12 <= len(line.strip()) <= 360 and re.search(r"\d", line) and re.search(r"[^\W\d_]", line):
            facts.append(("numeric_fact", line.strip()))
    return out + (facts if len(facts) >= 2 else [])


def table_like(text: str) -> bool:
    """At least three rows and an eighth of the lines hold several columns."""
    lines = [x for x in text.split("\n") if x.strip()]
    rows = sum(bool(re.search(r"\S(?:\s*\||\t| {3,})\s*\S.*(?:\||\t| {3,})", x)) for x in lines)
    return rows >= 3 and rows >= 0.12 * len(lines)


_NUMBER = re.compile(r"(?<![\w.])\d+(?:[.,]\d+)*(?:\s*(?:-|to)\s*\d+(?:[.,]\d+)*)?\s?%?")


def number_forms(number: str) -> set[str]:
    """A number, and with the other decimal mark where it has one or two decimals."""
    n = number.strip().rstrip("%").strip()
    forms = {n}
    if re.fullmatch(r"\d+[.,]\d{1,2}", n):
        forms |= {n.replace(",", "."), n.replace(".", ",")}
    return forms


def numeric_claims(text: str) -> list[tuple[str, int, int]]:
    """Numbers and ranges with their places; list marks and bracketed references are none."""
    out = []
    for m in _NUMBER.finditer(text):
        before = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        after = text[m.end() : m.end() + 2]
        if (not before.strip() and re.match(r"[.)]\s?", after)) or (before.rstrip().endswith("[") and after.startswith("]")):
            continue
        out.append((m[0].strip(), m.start(), m.end()))
    return out


def _words(text: str) -> set[str]:
    return {w for w in re.findall(r"[^\W\d_]{4,}", text.lower())}


def _same_word(a: str, b: str) -> bool:
    if a == b:
        return True
    k = max(6, int(0.7 * max(len(a), len(b))))
    return len(a) >= k and len(b) >= k and a[:k] == b[:k]


def supported(claim: tuple[str, int, int], answer: str, evidence: str, reach: int = 260) -> bool:
    """Does the evidence hold the number near the words that the answer has around it?"""
    number, start, end = claim
    left = max(answer.rfind(c, 0, start) for c in ".!?\n;") + 1
    stops = [p for p in (answer.find(c, end) for c in ".!?\n;") if p >= 0]
    subject = _words(answer[left : min(stops, default=len(answer))])
    for form in number_forms(number):
        for m in re.finditer(rf"(?<![\d.,]){re.escape(form)}(?![\d])", evidence):
            near = _words(evidence[max(0, m.start() - reach) : m.end() + reach])
            if subject and all(any(_same_word(s, w) for w in near) for s in subject):
                return True
            if not subject and len(_words(answer) & near) >= 2:
                return True
    return False


def without_unsupported(answer: str, evidence: str) -> str:
    """The answer without the sentences whose numbers the evidence doesn't hold."""
    spans = []
    for claim in numeric_claims(answer):
        if not supported(claim, answer, evidence):
            left = max(answer.rfind(c, 0, claim[1]) for c in ".!?\n") + 1
            stops = [p for p in (answer.find(c, claim[2]) for c in ".!?\n") if p >= 0]
            spans.append((left, min(stops, default=len(answer) - 1) + 1))
    for left, right in sorted(set(spans), reverse=True):
        answer = answer[:left] + answer[right:]
    return " ".join(answer.split())


def directory_fields(text: str) -> dict[str, str]:
    """Label and value lines; a line without label continues the value before it."""
    out: dict[str, str] = {}
    last = ""
    for line in text.split("\n"):
        if m := re.match(r"^\s*([A-Z][\w /&-]{1,40}):\s*(.*)$", line):
            last = m[1].strip().lower()
            out.setdefault(last, m[2].strip())
        elif last and line.strip():
            out[last] = f"{out[last]} {line.strip()}".strip()
        else:
            last = ""
    return out
