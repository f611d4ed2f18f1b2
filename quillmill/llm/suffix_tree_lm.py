"""Language-model scores by a probabilistic suffix tree, beside a unigram base.

Texts become their words in lower case (A-Z), joined by single spaces and closed by an
end symbol; symbols are bytes.

Groups.  Each task gathers its rows in groups of about ``GROUP_BYTES`` and writes, once,
the texts of a group (compressed) with its distinct grams of ``depth`` + 1 bytes and its
distinct words, each with its count in training rows (0 where only others hold it).

Learning.  Grams are summed over all groups; those of each shorter context are sums of
the longer ones.  Level by level, a join gives each (context, next byte) its probability
under the longest shorter state.  A context becomes a state if it occurs ``LEAST`` times
and its next bytes differ from those of that state by more than the cost of describing
them (n times the Kullback-Leibler divergence against k / 2 log n).  Its next-symbol
distribution is smoothed towards that state's by Witten and Bell's rule, and at the root
towards all bytes alike.  The tree is a table: it grows with the corpus, and neither the
driver nor a task holds it.

Scoring.  A byte is predicted by the state of the longest suffix before it.  What that
gives is known for each distinct gram, so a group gets the probabilities of its own
grams (and the counts of its own words) by a join, and meets its texts in one task.
Nothing is broadcast.

Null, empty and blank texts consist of the end symbol alone.  A null id counts as a
training row.  Repeated rows each get their result.  With no training rows the base has
N = V = 0 and the tree is its root.  Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import bucket, release_shuffles, stored

DEPTH = 5  # bytes of the longest context; a gram is one byte more, seven at most
LEAST = 16
END = b"\n"
GROUP_BYTES = 32_000_000
GROUP_ROWS = 200_000
PART_BYTES = 1_000_000
SLICE = 1_000_000
_PACKED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("line", pa.binary())])
_NAMES = ["g", "texts", "gram", "word", "n"]
_KINDS = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int32()]
_GROUPED = "g long, texts binary, gram long, word string, n int"


def symbols(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def places(lines: list[bytes], depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The gram of each predicted byte (which is the lowest of its number), and the line it is in, by slices.

    A line is closed by the end symbol and opened by ``depth`` of them, which are not predicted.
    """
    pad = END * depth
    raw = np.frombuffer(b"".join([pad + x + END for x in lines]), np.uint8)
    sizes = np.array([len(x) + 1 + depth for x in lines], np.int64)
    predicted = np.ones(len(raw), bool)
    predicted[((np.cumsum(sizes) - sizes)[:, None] + np.arange(depth)).reshape(-1)] = False
    own = np.repeat(np.arange(len(lines), dtype=np.int32), sizes)
    for lo in range(depth, len(raw), SLICE):
        hi = min(lo + SLICE, len(raw))
        code = raw[lo:hi].astype(np.int64)
        for k in range(1, depth + 1):
            code |= raw[lo - k : hi - k].astype(np.int64) << (8 * k)
        keep = predicted[lo:hi]
        yield code[keep], own[lo:hi][keep]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(found)).astype(np.int64)


def _parts(rows: list, size, most: int = PART_BYTES) -> Iterator[list]:
    """Cut a list so that the sizes of a part add up to about ``most``."""
    part, total = [], 0
    for r in rows:
        part.append(r)
        total += size(r)
        if total > most:
            yield part
            part, total = [], 0
    if part:
        yield part


def gram_counts(lines: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of all lines, in order, and how often each occurs."""
    parts, kept = [], 0
    for part in _parts(lines, len, 4 * PART_BYTES):
        for code, _ in places(part, depth):
            parts.append(np.unique(code, return_counts=True))
            kept += len(parts[-1][0])
            if kept > 4 * SLICE and len(parts) > 1:
                parts = [_merged(parts)]
                kept = len(parts[0][0])
    return _merged(parts)


def grouped(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Rows of groups ``g``: packed ``texts``, or a ``gram`` or ``word`` of the group with its training count ``n``."""

    def batch(g: int, **columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        given = {"g": pa.array(np.full(n, g)), **columns}
        return pa.record_batch([given.get(name, pa.nulls(n, kind)) for name, kind in zip(_NAMES, _KINDS, strict=True)], _NAMES)

    def rows_of(g: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for part in _parts(rows, lambda r: len(r[2])):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _PACKED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _PACKED, strict=True)], schema=_PACKED))
            yield batch(g, texts=pa.array([sink.getvalue().to_pybytes()], pa.binary()))
        mine, other = [x for _, held, x in rows if not held], [x for _, held, x in rows if held]
        codes, counts = gram_counts(mine, depth)
        unseen = np.setdiff1d(gram_counts(other, depth)[0], codes, assume_unique=True)
        codes, counts = np.concatenate([codes, unseen]), np.concatenate([counts, np.zeros(len(unseen), np.int64)])
        for at in range(0, len(codes), 100_000):
            yield batch(g, gram=pa.array(codes[at : at + 100_000]), n=pa.array(counts[at : at + 100_000].astype(np.int32)))
        words = Counter()
        for x in mine:
            words.update(x.split(b" "))
        for x in other:
            for w in x.split(b" "):
                words.setdefault(w, 0)
        words.pop(b"", None)
        words[END] = len(mine)
        every = list(words.items())
        for at in range(0, len(every), 100_000):
            part = every[at : at + 100_000]
            yield batch(g, word=pa.array([w.decode() for w, _ in part], pa.string()), n=pa.array([n for _, n in part], pa.int32()))

    def run(batches):
        first, rows, size, k = TaskContext.get().partitionId() << 32, [], 0, 0
        for b in batches:
            for d, x, held in zip(*[c.to_pylist() for c in b.columns], strict=True):
                line = b" ".join(symbols(x))
                rows.append((d, held, line))
                size += len(line)
                if size > GROUP_BYTES or len(rows) >= GROUP_ROWS:
                    yield from rows_of(first + k, rows)
                    rows, size, k = [], 0, k + 1
        if rows:
            yield from rows_of(first + k, rows)

    held = F.coalesce(bucket(F.col("doc_id"), 10) == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out")).mapInArrow(run, _GROUPED)


def _mask(d: int) -> int:
    return (1 << (8 * (d + 1))) - 1


def probabilities(counts: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """``gram`` and ``q``: log10 of the last byte's probability after the others, for each gram of ``counts`` (gram, n)."""
    levels = {depth: counts.select(F.col("gram").alias("code"), "n")}
    for d in range(depth - 1, -1, -1):
        shorter = levels[d + 1].groupBy(F.col("code").bitwiseAND(F.lit(_mask(d))).alias("code")).agg(F.sum("n").alias("n"))
        levels[d] = stored(shorter, f"grams{d}")
    total = levels[0].agg(F.sum("n")).first()[0] or 0
    known = levels[0].select("code", F.log10((F.col("n") + 0.5) / F.lit(total + 128.0)).alias("q"))
    for d in range(1, depth + 1):
        shorter = known.select(F.col("code").alias("shorter"), F.col("q").alias("p"))
        met = levels[d].withColumn("shorter", F.col("code").bitwiseAND(F.lit(_mask(d - 1)))).join(shorter, "shorter")
        n, seen, of = F.col("n"), F.col("n") > 0, Window.partitionBy("context")  # a context has at most 256 rows
        met = met.select("code", F.shiftright("code", 8).alias("context"), "n", "p").select(
            "code", "n", "p", F.sum("n").over(of).alias("total"), F.sum(seen.cast("int")).over(of).alias("kinds"),
            F.sum(F.when(seen, n * (F.log(n) - F.col("p") * math.log(10)))).over(of).alias("gain"),
        )
        state = (F.col("total") >= least) & (F.col("gain") - F.col("total") * F.log("total") > 0.5 * F.col("kinds") * F.log("total"))
        smoothed = F.log10((n + F.col("kinds") * F.pow(F.lit(10.0), "p")) / (F.col("total") + F.col("kinds")))
        known = stored(met.select("code", F.when(state, smoothed).otherwise(F.col("p")).alias("q")), f"tree{d}")
    return known.select(F.col("code").alias("gram"), "q")


def scored(docs: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    every = stored(grouped(docs, depth), "lm-groups")
    grams, words = every.filter("gram is not null").select("g", "gram", "n"), every.filter("word is not null").select("g", "word", "n")
    tree = probabilities(stored(grams.groupBy("gram").agg(F.sum("n").alias("n")), "lm-grams"), depth, least)
    release_shuffles(docs.sparkSession)
    # a word has a row in a group at most, so the rows of a frequent word are as many as the groups
    alike = Window.partitionBy("word")
    counted = words.select("g", "word", F.sum("n").over(alike).alias("c"), (F.min("g").over(alike) == F.col("g")).alias("first"), (F.count("*").over(alike) > 1).alias("shared"))
    counted = stored(counted, "lm-words")
    release_shuffles(docs.sparkSession)
    tokens, distinct = counted.filter("first").agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    tokens, below = tokens or 0, (tokens or 0) + 0.1 * (distinct + 1)

    told = grams.join(tree, "gram").select("g", "gram", F.col("q").cast("float").alias("q"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("c"))
    told = told.unionByName(counted.filter("shared").select("g", F.lit(None).cast("long").alias("gram"), F.lit(None).cast("float").alias("q"), "word", "c"))

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        log = {}

        def learn(words: list[bytes], counts: np.ndarray) -> None:
            log.update(zip(words, zip(np.log10((counts + 0.1) / below).tolist(), (counts > 0).tolist(), strict=True), strict=True))

        shared = known.filter(known.column("word").is_valid())
        learn([w.encode() for w in shared.column("word").to_pylist()], shared.column("c").to_numpy())
        code, q = known.column("gram").drop_null().to_numpy(), known.column("q").drop_null().to_numpy()
        order = np.argsort(code)
        code, q = code[order], q[order].astype(np.float64)
        packed = texts.column("texts").to_pylist()
        # words that no other group has are counted here
        mine = Counter()
        for data in packed:
            rows = pa.ipc.open_stream(data).read_all()
            for x, held in zip(rows.column("line").to_pylist(), rows.column("held_out").to_pylist(), strict=True):
                mine.update([w for w in (*x.split(), END) if w not in log] if not held else ())
        learn(list(mine), np.array(list(mine.values()), np.int64))
        never = (math.log10(0.1 / below), False)
        end, out = log.get(END, never), []
        for data in packed:
            rows = pa.ipc.open_stream(data).read_all()
            lines = rows.column("line").to_pylist()
            total = np.zeros(len(lines))
            for at, own in places(lines, depth):
                order = np.argsort(at)  # looked up in order, so that the table is read once from end to end
                total += np.bincount(own[order], q[np.searchsorted(code, at[order])], len(lines))
            for d, held, x, s in zip(rows.column("doc_id").to_pylist(), rows.column("held_out").to_pylist(), lines, total.tolist(), strict=True):
                hits = [log.get(w, never) for w in x.split()]
                out.append((d, held, len(hits) + 1, sum([k for _, k in hits]) + end[1], tokens, math.fsum([p for p, _ in hits]) + end[0], s))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCORED, strict=True)], schema=_SCORED)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts = every.filter("texts is not null").select(F.col("g").alias("texts_of"), "texts")
    return texts.groupBy("texts_of").cogroup(told.groupBy("g")).applyInArrow(score, schema)


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
