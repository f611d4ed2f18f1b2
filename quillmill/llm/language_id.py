"""Language identification by error-correcting output codes.

Each language has a codeword, and each bit of the code a binary classifier over hashed byte
n-grams (1 to 4 bytes of lower-case letters, words set apart by one space) that says on which side of the bit a
text's language stands.  The n-gram counts of all training rows are added up by Spark; a bit's
weights are the log odds of the mean distributions of its two sides.  A text's margins are decoded to the
language whose codeword has the least loss, a bit's logistic loss counting by how far its sides are apart
(their symmetric divergence).  What goes to the tasks is one matrix of bits by ``GRAMS`` numbers.

``score`` is the decoded language's share among ``exp(-loss)``; ``ambiguous`` is set where the
runner-up (``second``) has a share of ``CLOSE`` or more, or more bits are wrong than the code can
correct.  Equal losses give the first language by name.

A null text, or one without a letter, is ``und`` with score 0.  Rows without an id or a language
are not learned from; with no language learned every text is ``und``, and with one, every text with
letters has it.  Repeated rows have equal results, an empty table none.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import bucket, stored

ORDERS = (1, 2, 3, 4)
BITS = 14
GRAMS = 1 << BITS
#: The most languages of a model (more are an error), and up to how many of them all splits are bits of the code.
LANGUAGES, EXHAUSTIVE = 256, 7
SMOOTHING = 0.5
CLOSE = 0.25
UNKNOWN = "und"
#: Bytes that are looked at in one go; grams across the cut are counted once.
WINDOW = 1 << 20
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def gram_counts(text: str) -> np.ndarray:
    """How often each hashed n-gram stands in the whole text."""
    a = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS) + b" ", np.uint8)
    gap = a == 0x20
    a = a[~(gap & np.concatenate(([False], gap[:-1])))]
    out = np.zeros(GRAMS, np.int64)
    for i in range(0, len(a), WINDOW):
        for n in ORDERS:
            part = a[i : i + WINDOW + n - 1].astype(np.uint32)
            if len(part) >= n:
                h = np.full(len(part) - n + 1, n, np.uint32)
                for j in range(n):
                    h = h * np.uint32(0x01000193) ^ part[j : len(h) + j]
                out += np.bincount(h * np.uint32(2654435761) >> np.uint32(32 - BITS), minlength=GRAMS)
    return out


def code(k: int) -> np.ndarray:
    """``k`` codewords: all splits of few languages, else random splits whose words are as far apart as many tries found."""
    if k < 2:
        return np.ones((k, 0), np.int8)
    if k <= EXHAUSTIVE:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=k - 1) if -1 in rest]
        return np.array(splits, np.int8).T
    width, best, far = math.ceil(10 * math.log2(k)), None, -1
    for seed in range(200):
        words = np.where(np.random.default_rng(seed).random((k, width)) < 0.5, -1, 1).astype(np.int8)
        if (abs(words.sum(0)) < k).all() and (least := distance(words)) > far:
            best, far = words, least
    if best is None:
        raise RuntimeError("no code found")
    return best


def distance(words: np.ndarray) -> int:
    """The least number of bits in which two codewords differ."""
    differ = (words.shape[1] - words.astype(int) @ words.T) // 2
    return int(differ[~np.eye(len(words), dtype=bool)].min()) if len(words) > 1 else words.shape[1]


@dataclass
class Model:
    """languages (by name), their codewords, the classifiers' weights and the bits' weights."""

    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Losses of each language for rows of margins, and the bits that disagree with its codeword."""
        agree = np.clip(margins, -50, 50)[:, None, :] * self.words[None]
        return (np.log1p(np.exp(-agree)) * self.trust).sum(2), (agree < 0).sum(2)


def fit(docs: DataFrame, fold: int = 3, out: int = 1) -> Model:
    """Classifiers from all rows with an id and a language whose ``crc32(doc_id) % fold`` isn't ``out``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in sums.items():
                there = np.flatnonzero(c)
                yield pa.record_batch([pa.array([lang] * len(there), pa.string()), pa.array(there, pa.int32()), pa.array(c[there], pa.int64())], ["lang", "gram", "n"])
            sums.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    c = gram_counts(text)
                    sums[lang] = sums[lang] + c if lang in sums else c
                if len(sums) >= LANGUAGES:
                    yield from flush()
        yield from flush()

    train = docs.filter(F.col("lang").isNotNull() & (bucket(F.col("doc_id"), fold) != out)).select("lang", "text")
    counts = train.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stored(counts, "grams")
    languages = sorted(r[0] for r in counts.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(languages) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    table = counts.toArrow()  # LANGUAGES times GRAMS rows at most
    words = code(len(languages))
    at = {x: i for i, x in enumerate(languages)}
    seen = np.zeros((len(languages), GRAMS))
    seen[[at[x] for x in table["lang"].to_pylist()], table["gram"].to_numpy()] = table["n"].to_numpy()
    p = (seen + SMOOTHING) / (seen + SMOOTHING).sum(1, keepdims=True)
    weights, trust = np.zeros((words.shape[1], GRAMS)), np.ones(words.shape[1])
    for b in range(words.shape[1]):
        one, other = p[words[:, b] > 0].mean(0), p[words[:, b] < 0].mean(0)
        weights[b] = np.log(one) - np.log(other)
        trust[b] = ((one - other) * weights[b]).sum()
    return Model(languages, words, weights.astype(np.float32), trust / trust.mean() if len(trust) and trust.mean() > 0 else np.ones(words.shape[1]))


def identified(docs: DataFrame, model: Model, fold: int = 3, out: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, second and ambiguous of each row."""
    slip = (distance(model.words) - 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights.T.astype(float)
        for b in batches:
            texts, rows = b.column(1).to_pylist(), []
            for i in range(0, len(texts), 64):
                part = texts[i : i + 64]
                grams = np.zeros((len(part), GRAMS))
                known = [has_letter(x) and bool(model.languages) for x in part]
                for j, x in enumerate(part):
                    if known[j]:
                        grams[j] = gram_counts(x)
                loss, wrong = model.decode(grams @ weights)
                for j in range(len(part)):
                    if not known[j]:
                        rows.append((UNKNOWN, 0.0, None, True))
                        continue
                    share = np.exp(loss[j].min() - loss[j])
                    share /= share.sum()
                    best, *rest = np.argsort(loss[j], kind="stable").tolist()[:2]
                    close = bool(rest) and (bool(share[rest[0]] >= CLOSE) or int(wrong[j][best]) > slip)
                    rows.append((model.languages[best], round(float(share[best]), 9), model.languages[rest[0]] if rest else None, close))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.string(), pa.bool_()), strict=True))], ["doc_id", "lang_pred", "score", "second", "ambiguous"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, second string, ambiguous boolean")
    held = F.coalesce(bucket(F.col("doc_id"), fold) == out, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "second", "ambiguous")
