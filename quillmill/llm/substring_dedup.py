"""Substring dedup by content-defined chunks of a gear rolling hash.

A gear hash of the last ``WINDOW`` bytes is kept at every byte; a chunk ends where that
hash is the largest within ``RADIUS`` bytes on both sides (moved on to the end of the
word, or of the character in text without spaces).  So a cut depends on nearby bytes
alone: what is inserted before or after a passage does not move the cuts inside it, and
chunks are longer than ``RADIUS`` bytes (except at the ends) and about twice as long.

Chunks are named by a 128-bit digest, counted over all documents, and the least
(doc_id, start) of a digest is its first copy.  Chunks that occur again are joined back
to their places, and neighbours in a document make a span.  Spans shorter than
``LEAST_BYTES`` are left alone: they are phrases, not passages.

Counting aggregates before the shuffle; the join back may meet a digest that very many
documents hold, and is a plain equi-join, which Spark splits where it is skewed.

Null and empty texts have no chunks.  Rows without an id are left alone.  Rows that
repeat an id and a text are one document.  Places are in UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import discard, release_shuffles, sifted, stored, whole_rows, with_text

WINDOW = 16
RADIUS = 24
LEAST_BYTES = 64
LONGEST_WORD = 32


def gear_table(seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """256 pseudo-random 32-bit numbers by the splitmix64 rule."""
    out, mask = [], (1 << 64) - 1
    for i in range(256):
        z = (seed * (i + 1)) & mask
        z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & mask
        out.append((z ^ z >> 31) >> 32)
    return np.array(out, np.uint32)


GEAR = gear_table()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the gears of the last WINDOW bytes, each shifted by its distance."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def _ahead(v: np.ndarray, width: int) -> np.ndarray:
    """At each place, the largest of ``v`` in the next ``width`` places, itself included."""
    m, have = v, 1
    while have < width:
        step = min(have, width - have)
        n = m.copy()
        n[:-step] = np.maximum(m[:-step], m[step:])
        m, have = n, have + step
    return m


def cuts(data: bytes) -> np.ndarray:
    """Ends of the chunks of a text, the last one being its length."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    if n <= RADIUS:
        return np.array([n] if n else [], np.int64)
    v = gear_hash(raw).astype(np.int64)
    ahead = _ahead(v, RADIUS)
    before = np.full(n, -1, np.int64)
    before[RADIUS:] = ahead[:-RADIUS]
    before[1:RADIUS] = np.maximum.accumulate(v[: RADIUS - 1])
    after = np.full(n, -1, np.int64)
    after[:-1] = ahead[1:]
    ends = np.flatnonzero((v > before) & (v >= after)) + 1
    ends = ends[ends < n]
    if len(ends) == 0:
        return np.array([n], np.int64)
    blank = np.flatnonzero((raw == 32) | (raw >= 9) & (raw <= 13)) + 1  # places after white space
    at = np.searchsorted(blank, ends)
    word = np.where(at < len(blank), blank[np.minimum(at, max(len(blank) - 1, 0))] if len(blank) else n, n)
    whole = np.flatnonzero((raw & 0xC0) != 0x80)  # places where a character begins
    place = np.searchsorted(whole, ends)
    char = np.where(place < len(whole), whole[np.minimum(place, len(whole) - 1)], n)
    ends = np.unique(np.where(word - ends <= LONGEST_WORD, word, char))
    return np.append(ends[ends < n], n)


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, start, length and digest (two longs) of each chunk."""

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in batches:
            ids, starts, lengths, hashes = [], [], [], []
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = x.encode("utf-8")
                ends = cuts(data)
                begin = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
                ids.append(np.full(len(ends), d, np.int64))
                starts.append(begin)
                lengths.append(ends - begin)
                hashes += [digest(data[s:e]) for s, e in zip(begin.tolist(), ends.tolist(), strict=True)]
            if hashes:
                two = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                columns = [np.concatenate(ids), np.concatenate(starts).astype(np.int32), np.concatenate(lengths).astype(np.int32), two[:, 0].copy(), two[:, 1].copy()]
                yield pa.record_batch([pa.array(c) for c in columns], ["doc_id", "start", "length", "h1", "h2"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text <> ''")
    return rows.mapInArrow(run, "doc_id long, start int, length int, h1 long, h2 long")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Digest, first place and number of copies of each chunk that occurs again."""
    place = F.struct("doc_id", "start")
    counted = chunks(docs).groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("copies"))
    # rows that repeat an id and a text have the same place, so they alone make no copies
    again = counted.filter(F.col("first") != F.col("last")).select("h1", "h2", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"), "copies")
    again = stored(again, "again")  # so that the join is one of plain tables, which Spark splits at a very common digest
    release_shuffles(docs.sparkSession)
    return again


def repeated_spans(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """doc_id, start, end, n_chunks, copies, first_doc_id and ``removed`` of each repeated passage.

    A passage has a row in every document that holds it; ``removed`` is false where it
    is the first copy.  ``copies`` is the most occurrences of one of its chunks.
    """
    return _spans(docs, repeated_chunks(docs), least_bytes)


def _spans(docs: DataFrame, again: DataFrame, least_bytes: int) -> DataFrame:
    # cut a second time rather than stored: the rows are more than half as large as the texts
    held = chunks(docs).join(again, ["h1", "h2"]).select(
        "doc_id", "start", (F.col("start") + F.col("length")).alias("end"), "copies", "first_doc_id",
        ((F.col("doc_id") != F.col("first_doc_id")) | (F.col("start") != F.col("first_start"))).alias("removed"),
    )
    held = held.groupBy("doc_id", "start", "end", "removed").agg(F.max("copies").alias("copies"), F.min("first_doc_id").alias("first_doc_id"))
    order = Window.partitionBy("doc_id").orderBy("start")
    fresh = (F.lag("end", 1, -1).over(order) != F.col("start")) | (F.lag("removed").over(order) != F.col("removed"))
    runs = held.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("run", F.sum("fresh").over(order))
    spans = runs.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_chunks"), F.max("copies").alias("copies"), F.min("first_doc_id").alias("first_doc_id"), F.first("removed").alias("removed")
    )
    return spans.filter(F.col("end") - F.col("start") >= least_bytes).drop("run")


def without_repeats(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``docs`` with later copies of repeated passages cut out of ``text``; texts of which nothing is left go.

    Only documents with spans are touched; ``n_chars``, where there is one, follows the text.
    """
    again = repeated_chunks(docs)
    spans = _spans(docs, again, least_bytes).filter("removed").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    # stored, so that the chunks' shuffles are gone before texts are shuffled; those without spans are not
    spans = stored(spans, "spans")
    discard(again)
    release_shuffles(docs.sparkSession)
    data = F.encode("t", "UTF-8")
    start = F.struct(F.lit(0).alias("at"), F.encode(F.lit(""), "UTF-8").alias("out"))

    def step(done, x):
        gap = F.substring(data, done["at"] + 1, x["start"] - done["at"])
        return F.struct(x["end"].alias("at"), F.concat(done["out"], gap).alias("out"))

    left = F.aggregate("_spans", start, step, lambda d: F.concat(d["out"], F.substring(data, d["at"] + 1, F.octet_length("t"))))
    sure, others = sifted(docs, spans)
    joined = whole_rows(others).join(spans, F.col("k") == F.col("doc_id"), "left")
    text = F.when(F.col("_spans").isNull(), F.col("t")).otherwise(F.decode(left, "UTF-8"))
    kept = joined.withColumn("left", text).filter(F.col("_spans").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    return sure.unionByName(with_text(kept, docs.schema, F.col("left")))
