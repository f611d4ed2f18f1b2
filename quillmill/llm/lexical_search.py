"""Ranked lexical search: WAND over shards of documents, whose heaps are merged.

Terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII, with only
A-Z lower-cased.  A term's weight is ``floor(1000 * ln((2N + 2) / (2df + 1)))``, a
document's length norm ``m = 50 + (50 * n * N) div L``, and a posting's impact
``weight * ((10**9 * tf) div (1000 * tf + 20 * m))``; a score is the sum of impacts.

1. Each task turns its run of documents into shards of at most ``SHARD`` postings: lists
   by term of (ordinal, tf), for terms that some query may have.  A bitmap of fixed size
   says which those are; the join below is what decides.
2. Counts over all documents give N, L and each asked term's df.
3. Queries are dealt to blocks and shards to parts of at most about ``PART`` postings.
   The group of a block and a part gets the block's lists only; it goes through its shards
   with one heap a query.  Cursors stand in order of their documents; the pivot is the
   first one at which the largest impacts so far reach the heap's least score, and no
   document before it is looked at.
4. The heaps of the parts are merged by a window, which Spark cuts before the shuffle.

Every row with a term is a document of its own, whatever its id; null texts, and texts
without a term, count for nothing and are never found.  Equal scores stand by ascending
id, a null id first.  Rows of ``queries`` with one id are one query that has the terms of all.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import stored

#: Postings of a shard, and about so many of a group that one task holds.
SHARD = 1_000_000
PART = 4_000_000
#: Queries of a block, about.
BLOCK = 50
#: Bits of the bitmap of asked terms.
BITS = 1 << 20
#: A term of the contract, as a Java pattern.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands for a null id inside a shard.
NO_ID = -(2**63)
_END = 1 << 62
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_SHARD_ROW = "shard long, term string, at binary, tf binary, size long, docs long, length long"


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, with repeats."""
    return raw.translate(_FOLD).split()


def query_terms(queries: DataFrame) -> DataFrame:
    """``item_id`` and ``term``, each pair once."""
    upper, lower = (bytes(range(a, a + 26)).decode() for a in (65, 97))
    found = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), upper, lower), F.lit(TERM), F.lit(0))
    return queries.select("item_id", F.explode(F.array_distinct(found)).alias("term")).distinct()


class _Shard:
    """The postings of a run of documents."""

    def __init__(self, number: int):
        self.number, self.size, self.ids, self.lengths = number, 0, [], []
        self.lists: dict[bytes, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))

    def add(self, doc_id: int | None, n: int, counts: list[tuple[bytes, int]]) -> None:
        at = len(self.ids)
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.lengths.append(n)
        for term, tf in counts:
            where, times = self.lists[term]
            where.append(at)
            times.append(tf)
        self.size += len(counts)

    def rows(self) -> Iterator[tuple]:
        """The documents' row (no term) and one for each list."""
        yield self.number, None, np.array(self.ids, "<i8").tobytes(), np.array(self.lengths, "<i8").tobytes(), 0, len(self.ids), sum(self.lengths)
        for term, (where, times) in self.lists.items():
            yield self.number, term.decode(), np.array(where, "<i4").tobytes(), np.array(times, "<i4").tobytes(), len(where), 0, 0


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 2000):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 2000], strict=True), schema, strict=True)], schema=schema)


_ARROW = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("at", pa.binary()), ("tf", pa.binary()), ("size", pa.int64()), ("docs", pa.int64()), ("length", pa.int64())])


def shards(docs: DataFrame, asked: frozenset[int]) -> DataFrame:
    """Shards of all documents, with the terms whose crc32 is ``asked`` modulo ``BITS``."""
    bits = np.zeros(BITS, bool)
    bits[list(asked)] = True
    packed, most = np.packbits(bits).tobytes(), SHARD

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        wanted, crc, mask = np.unpackbits(np.frombuffer(packed, np.uint8)).tobytes(), zlib.crc32, BITS - 1
        number = TaskContext.get().partitionId() << 20
        shard = _Shard(number)
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms_of(raw)
                if found:
                    shard.add(doc_id, len(found), [(t, n) for t, n in Counter(found).items() if wanted[crc(t) & mask]])
                if shard.size >= most:
                    yield from _batches(list(shard.rows()), _ARROW)
                    number += 1
                    shard = _Shard(number)
        if shard.ids:
            yield from _batches(list(shard.rows()), _ARROW)

    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select(F.col("doc_id").cast("long"), raw.alias("raw")).mapInArrow(index, _SHARD_ROW)


def wand(lists: list[tuple[int, list[int], list[int]]], heap: list[tuple[int, int]], k: int, ties: list[int]) -> None:
    """Bring into ``heap`` the documents of ``lists`` that are among the ``k`` best.

    Each list has its largest impact, its ordinals (ascending, ``_END`` after the last) and
    their impacts.  The heap holds (score, tie), and ``ties`` the ordinals' ties: of equal
    scores the greater tie stays.
    """
    cursors = [[where[0], 0, where, impacts, most] for most, where, impacts in lists]
    doc_of = itemgetter(0)
    cursors.sort(key=doc_of)
    while cursors:
        least = heap[0][0] if len(heap) == k else 1
        reach = 0
        for p, c in enumerate(cursors):
            reach += c[4]
            if reach >= least:
                break
        else:
            return  # all lists together can't reach the least score
        pivot = c[0]
        if pivot == _END:
            return
        if cursors[0][0] == pivot:
            score = 0
            for c in cursors:
                if c[0] != pivot:
                    break
                i = c[1]
                score += c[3][i]
                c[1] = i + 1
                c[0] = c[2][i + 1]
            found = (score, ties[pivot])
            if len(heap) < k:
                heapq.heappush(heap, found)
            elif found > heap[0]:
                heapq.heapreplace(heap, found)
        else:
            for c in cursors[:p]:
                if c[0] < pivot:
                    c[1] = bisect_left(c[2], pivot, c[1] + 1)
                    c[0] = c[2][c[1]]
        cursors.sort(key=doc_of)
        if cursors[-1][0] == _END and len(cursors) > 1 and cursors[len(cursors) // 2][0] == _END:
            cursors = [c for c in cursors if c[0] != _END]


def _searched(n_docs: int, n_terms: int, k: int):
    """The search of one block's queries in the shards of one part."""

    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        by_item: dict[int | None, list[str]] = defaultdict(list)
        for item, term in zip(queries["item_id"].to_pylist(), queries["term"].to_pylist(), strict=True):
            by_item[item].append(term)
        by_shard: dict[int, list[int]] = defaultdict(list)
        for i, s in enumerate(index["shard"].to_pylist()):
            by_shard[s].append(i)
        heaps: dict[int | None, list[tuple[int, int]]] = {item: [] for item in by_item}
        for s in sorted(by_shard) if by_item else ():
            rows = index.take(pa.array(by_shard[s]))
            norm, ties, lists = None, [], {}
            for term, at, tf in zip(*(rows[c].to_pylist() for c in ("term", "at", "tf")), strict=True):
                if term is None:
                    norm = 50 + 50 * np.frombuffer(tf, "<i8") * n_docs // n_terms
                    ties = [-i for i in np.frombuffer(at, "<i8").tolist()]
            for term, at, tf, weight in zip(*(rows[c].to_pylist() for c in ("term", "at", "tf", "weight")), strict=True):
                if term is not None:
                    where, times = np.frombuffer(at, "<i4"), np.frombuffer(tf, "<i4").astype("i8")
                    impacts = weight * (10**9 * times // (1000 * times + 20 * norm[where]))
                    lists[term] = (int(impacts.max()), [*where.tolist(), _END], impacts.tolist())
            for item, terms in by_item.items():
                wand([lists[t] for t in terms if t in lists], heaps[item], k, ties)
        out = [(item, score, None if tie == -NO_ID else -tie) for item, heap in heaps.items() for score, tie in heap]
        return pa.table({name: pa.array([r[j] for r in out], pa.int64()) for j, name in enumerate(("item_id", "score", "doc_id"))})

    return search


def ranked(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of each query's ``k`` best documents with a score above 0."""
    asked = query_terms(queries.select(F.col("item_id").cast("long"), "text"))
    bits = frozenset(r[0] for r in asked.select((F.crc32(F.encode("term", "UTF-8")) % BITS).alias("bit")).distinct().collect())  # BITS at most
    index = stored(shards(docs, bits), "shards")
    n_docs, n_terms, size = (x or 0 for x in index.agg(F.sum("docs"), F.sum("length"), F.sum("size")).first())
    blocks = max(1, math.ceil(asked.select("item_id").distinct().count() / BLOCK))
    parts = max(1, math.ceil(size / PART))
    df = index.filter("term is not null").groupBy("term").agg(F.sum("size").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighted = asked.join(df, "term").select("item_id", "term", weight.alias("weight")).filter("weight > 0")
    weighted = stored(weighted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "queries")
    part = F.pmod(F.shiftright("shard", 20) + F.col("shard").bitwiseAND((1 << 20) - 1), F.lit(parts)).alias("part")
    lists = index.filter("term is not null").join(weighted.select("block", "term", "weight").distinct(), "term").select("block", part, "shard", "term", "at", "tf", "weight")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    of_docs = index.filter("term is null").select(every, part, "shard", "term", "at", "tf", F.lit(0).cast("long").alias("weight"))
    to_parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
    both = lists.unionByName(of_docs).groupBy("block", "part").cogroup(weighted.select(F.col("block").alias("of"), to_parts, "item_id", "term").groupBy("of", "part"))
    heaps = both.applyInArrow(_searched(n_docs, n_terms, k), "item_id long, score long, doc_id long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return heaps.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
