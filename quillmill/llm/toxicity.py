"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding.  Texts are lower-cased, letters that look like Latin ones become those, digits
and signs that stand for letters become letters (``l`` and ``1`` both become ``i``), and
all else becomes a space; accents and invisible characters are dropped; so "1D1OT", Cyrillic lookalikes and "idiot" are one word.

Lexicon.  Weights are log ratios of document frequencies among toxic and other training
rows; a word is kept if its weight and its z-score are high.  Common insults have a
prior weight where labels say nothing about them.  It is fitted on at most
``SAMPLE_ROWS`` labelled rows, taken by a hash of the id, with one row for equal texts.

Score.  The weights of all hits outside exception phrases, by hundred words, with the
number of hits, go through a logistic curve that is fitted on the same rows.

Null, empty and blank texts have no hits and get the curve's lowest score.  A row's
score depends on its text alone; repeated rows repeat it.  Null labels are left out; of
several labels of an id the highest counts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import bucket, stored

SAMPLE_ROWS = 20_000
LEAST_ROWS = 5
LEAST_WEIGHT = 2.5
LEAST_Z = 3.0
PRIOR_WEIGHT = 3.0

#: Characters that look like Latin letters (Cyrillic and Greek, by code point), and what they look like.
LOOKALIKES = {
    0x430: "a", 0x435: "e", 0x43E: "o", 0x440: "p", 0x441: "c", 0x443: "y", 0x445: "x", 0x456: "i", 0x458: "j", 0x455: "s", 0x43A: "k", 0x43C: "m", 0x442: "t", 0x432: "b", 0x43D: "h",
    0x3B1: "a", 0x3B5: "e", 0x3BF: "o", 0x3C1: "p", 0x3B9: "i", 0x3BA: "k", 0x3BD: "v", 0x3C4: "t", 0x3C5: "u", 0x3C7: "x",
}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "!": "i", "|": "i", "l": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t"}
#: Common English insults.
INSULTS = "idiot moron stupid loser scum trash clown pathetic worthless disgusting imbecile jerk dumb fool".split()
#: Harmless phrases that hold a word of the lexicon.
EXCEPTIONS = ("clown fish", "clown car", "trash can", "trash bin", "trash bag", "pond scum", "soap scum", "fool proof", "april fool")

_FOLD = dict(LOOKALIKES) | {ord(k): v for k, v in SUBSTITUTES.items()} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_FOLD = {k: SUBSTITUTES.get(v, v) for k, v in _FOLD.items()}
_OTHER = re.compile(r"[\W\d_]+")


def folded(text: str | None) -> str:
    """Words of letters between single spaces, with a space at both ends.

    A mark that ends a word ("idiot!") is no letter there: marks fold only before a letter or digit.
    Accents, invisible characters and styled letters go by compatibility decomposition, letters
    three or more times in a row become one, and four or more single letters in a row a word.
    """
    x = text or ""
    if not x.isascii():
        x = "".join([c for c in unicodedata.normalize("NFKD", x) if c.isascii() or unicodedata.category(c) not in ("Mn", "Me", "Cf")])
    x = _TAIL.sub(" ", x.lower())
    x = f" {_OTHER.sub(' ', x.translate(_FOLD)).strip()} "
    x = _MANY.sub(r"\1", x)
    return _APART.sub(lambda m: m[0].replace(" ", ""), x)


_MANY = re.compile(r"([^\W\d_])\1{2,}")
_APART = re.compile(r"(?<= )(?:[^\W\d_] ){3,}[^\W\d_](?= )")


_TAIL = re.compile(r"[!|$@]+(?![^\W_])")


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (-3.0, 2.5, 1.5)
    exceptions: tuple[str, ...] = EXCEPTIONS


class Matcher:
    """The automaton of a model, and the measures of a text."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.automaton = ahocorasick.Automaton()
        for word, w in model.weights.items():
            self.automaton.add_word(f" {word} ", (w, 1, len(word) + 2))
        for phrase in model.exceptions:
            inside = [w for w in folded(phrase).split() if w in model.weights]
            if inside:
                self.automaton.add_word(folded(phrase), (-sum(model.weights[w] for w in inside), -len(inside), 0))
        if len(self.automaton):
            self.automaton.make_automaton()

    def measures(self, text: str | None) -> tuple[float, float]:
        """log(1 + weight by 100 words), and whether anything was hit."""
        x = folded(text)
        total, hits = 0.0, 0
        if len(self.automaton):
            for _, (w, n, _) in self.automaton.iter(x):
                total += w
                hits += n
        words = x.count(" ") - 1
        return math.log1p(max(total, 0.0) * 100 / (words + 50)), float(hits > 0)

    def score(self, text: str | None) -> float:
        a, b, c = self.model.curve
        density, hit = self.measures(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * density + c * hit))))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and ``toxic`` of at most ``rows`` labelled rows that are not held out."""
    chosen = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (bucket(F.col("doc_id"), 5) != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # at most `rows` ids and labels, so they can be sent to every task
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return joined.groupBy(F.sha2("text", 256).alias("blob")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon and curve from the training rows; the words of ``rows`` rows bound both."""
    train = stored(training_rows(docs, labels, rows), "toxicity")

    def count(batches):
        for b in batches:
            found: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[y].update(set(folded(x).split()))
            every = list(found[0].keys() | found[1].keys())
            yield pa.record_batch([pa.array(every, pa.string()), pa.array([found[1][w] for w in every], pa.int64()), pa.array([found[0][w] for w in every], pa.int64())], ["word", "c1", "c0"])

    n = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    words = train.mapInArrow(count, "word string, c1 long, c0 long").groupBy("word").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    weight = F.log((F.col("c1") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("c0") + 0.5) / F.lit(n0 + 1.0))
    z = F.col("weight") / F.sqrt(1 / (F.col("c1") + 0.5) + 1 / (F.col("c0") + 0.5))
    insults = [folded(w).strip() for w in INSULTS]
    kept = (
        words.withColumn("weight", weight)
        .withColumn("z", z)
        .filter(F.col("word").isin(insults) | (F.col("c1") >= LEAST_ROWS) & (F.col("weight") >= LEAST_WEIGHT) & (F.col("z") >= LEAST_Z))
        .select("word", "weight")
        .collect()
    )
    weights = dict.fromkeys(insults, PRIOR_WEIGHT) | {r["word"]: r["weight"] for r in kept}
    weights = {w: x for w, x in weights.items() if x > 0}
    model = Model(weights)

    def measure(batches):
        matcher = Matcher(model)
        for b in batches:
            m = [matcher.measures(x) for x in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array([x for x, _ in m], pa.float64()), pa.array([x for _, x in m], pa.float64()), b.column(1)], ["density", "hit", "toxic"])

    seen = train.mapInArrow(measure, "density double, hit double, toxic int").toPandas()
    seen = seen.sort_values(["toxic", "density", "hit"])  # sums of floats then don't depend on the order of tasks
    if n1 and n0:
        model.curve = _logistic(seen[["density", "hit"]].to_numpy(float), seen["toxic"].to_numpy(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> tuple[float, float, float]:
    """Newton's method for a logistic curve with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    at, hold = np.zeros(3), ridge * np.diag([1e-3, 1.0, 1.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + hold + 1e-9 * np.eye(3), x.T @ (y - p) - hold @ at)
        at = at + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1]), float(at[2])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""

    def run(batches):
        matcher = Matcher(model)
        for b in batches:
            s = [round(matcher.score(x), 9) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted to be toxic."""
    schema = docs.schema

    def run(batches):
        matcher = Matcher(model)
        at = schema.names.index("text")
        for b in batches:
            yield b.filter(pa.array([matcher.score(x) < 0.5 for x in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)
