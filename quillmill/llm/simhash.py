"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

A fingerprint's 64 bits are cut into 32 segments of two; the vector of the segments'
bit counts is the embedding.  The Manhattan distance of two vectors never exceeds the
Hamming distance of the fingerprints, so a pair within ``distance`` bits is also within
``distance`` in the grid.  The vector is kept in unary (00, 01, 11 a segment), so that
its Manhattan distance is the bit count of an exclusive or.

Range join.  The segments are dealt to ``distance + 4`` blocks.  Vectors within
``distance`` differ in at most that many blocks, so they agree on some choice of four
blocks: the grid cells joined are the equal values of those coordinates, one equi-join
over all choices.  What meets is tested by the Manhattan bound and then exactly.

Only distinct fingerprints are joined.  A cell of more than ``CELL_LIMIT`` of them is
not joined pairwise: its members (of all such cells together) are linked exactly by
midpoints.  Two fingerprints are within two bits exactly if flipping at most one bit in
each can make them equal; each member is written under its 65 such values, and all that
share a value are linked to the smallest of them.  This needs 65 rows a fingerprint and
no pairs, however large the group of near copies is.

Null, empty and blank texts have fingerprint zero and link with one another.  Repeated
rows and exact copies share a fingerprint and a component.  A component's id is its
smallest doc_id; null ids are ignored there, and a component without others has null.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import discard, release_shuffles, sifted, stored
from quillmill.llm.graph import components

SEED = 42
SHINGLE = 3
DISTANCE = 2
AGREE = 4
CELL_LIMIT = 64
EVEN = 0x5555555555555555
BLOCK = 100_000


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the ``size``-word shingles of a text."""
    import xxhash

    w = (text or "").encode("utf-8").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - size + 1)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(size, len(w)) - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = zip(starts[at : min(n, at + BLOCK)].tolist(), last[at : at + BLOCK].tolist(), strict=False)
        h = np.array([digest(joined[a:b], SEED) for a, b in part], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x, size) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(fp: Column) -> Column:
    """Bit counts of the two-bit segments, in unary."""
    halves = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN))
    both, one = fp.bitwiseAND(halves), fp.bitwiseAND(F.lit(EVEN)).bitwiseOR(halves)
    # low bit: at least one is set; high bit: both are
    return one.bitwiseOR(F.shiftleft(both.bitwiseAND(F.lit(EVEN)), 1))


def cell_masks(distance: int) -> list[int]:
    """Of each choice of blocks, the bits of its segments."""
    blocks = distance + AGREE
    of = [sum(3 << (2 * s) for s in range(32) if s % blocks == k) for k in range(blocks)]
    return [_signed(sum(of[k] for k in chosen)) for chosen in itertools.combinations(range(blocks), AGREE)]


def links(distinct: DataFrame, distance: int = DISTANCE, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Edges (a, b) whose components are those of "at most ``distance`` bits apart"; ``distinct`` has column fp."""
    if distance > 2:
        raise ValueError("midpoints of one flipped bit reach two bits")
    masks = F.array(*[F.struct(F.lit(k).cast("short").alias("k"), F.lit(m).alias("m")) for k, m in enumerate(cell_masks(distance))])
    cells = (
        distinct.withColumn("u", embedding(F.col("fp")))
        .withColumn("c", F.explode(masks))
        .select("fp", "u", F.col("c.k").alias("k"), F.col("u").bitwiseAND(F.col("c.m")).alias("cell"))
    )
    cells = stored(cells, "cells")
    # written before it is joined: a join of plain tables is split where a cell is dense
    sizes = stored(cells.groupBy("k", "cell").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    shared = stored(cells.join(sizes, ["k", "cell"]), "shared")
    discard(cells, sizes)
    few = shared.filter(F.col("n") <= cell_limit)
    left = few.select("k", "cell", F.col("fp").alias("a"), F.col("u").alias("ua"))
    right = few.select("k", "cell", F.col("fp").alias("b"), F.col("u").alias("ub"))
    pairs = left.join(right, ["k", "cell"]).filter(
        (F.col("a") < F.col("b"))
        & (F.bit_count(F.col("ua").bitwiseXOR(F.col("ub"))) <= distance)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    )
    many = shared.filter(F.col("n") > cell_limit).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    near = many.withColumn("flip", F.explode(flips)).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    centre = near.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").select("mid", "b")
    stars = near.join(centre, "mid").select(F.col("fp").alias("a"), "b").filter("a <> b")
    return pairs.select("a", "b").unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id and links (of distinct fingerprints) of each row."""
    prints = stored(fingerprints(docs, size), "fingerprints")
    by_print = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    near = links(by_print.select("fp"), distance, cell_limit)
    edges = stored(near, "links")
    discard(near)
    members = components(edges)
    rooted = by_print.join(members.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    hexadecimal = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named, "fp").select("doc_id", hexadecimal, "component_id")


# Near duplicates of the pipeline: groups of similar texts (Jaccard similarity of shingle sets).
#
# First come the fingerprints: the range join above gives the pairs within ``DISTANCE`` bits,
# an exact check of the shingle sets follows, and what holds is linked.  A text may be similar to
# another and more than ``DISTANCE`` bits away from it, so an exact prefix-filter join finds the
# similar pairs that the fingerprints have not linked; it passes over those that they have.
#
# All shingles have one order.  Two sets of the similarity share so much that the first
# shingles of each, a fifth of it and one more, have one in common: those are the cells
# that a text is a member of, and every pair of the similarity meets in one, whatever the
# lengths.  The order may be any; shingles that a sample of the texts finds often come
# last, so that passages of many texts make few large cells.
#
# Pairs are many where copies are many, so links come first: each member of a cell is
# compared with the cell's least id and with its most central member, which has most
# shingles in common with others (of many edited copies, the original).  Then all pairs
# that meet and are not linked yet are compared too: by a join in small cells, where the
# number of cells that a pair shares must reach what the similarity asks for, and by
# blocks of members in dense cells.
#
# Before the texts of a pair meet, their parity bits do: which buckets of a hash table hold
# an odd number of the shingles.  Two texts differ in at least as many shingles as bits, so
# no pair of the similarity is lost, and texts travel for the pairs that are left.

STAGE_SHINGLE = 5
SIMILARITY = 0.8
SAMPLE = 16
OFTEN = 4
PAIR_LIMIT = 64  # members of a cell that is joined pairwise
BLOCK_ROWS = 256
COLUMNS = 4096
LATE_LIMIT = 200_000  # shingles that come last; which ones they are changes the work and not the result


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of a text, sorted."""
    import xxhash

    w = (text or "").encode("utf-8").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined, lengths = b" ".join(w), np.array([len(x) + 1 for x in w])
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1).tolist()
    last = ends[min(size, len(w)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last, strict=False)], np.uint64))


def parity_bits(hashes: np.ndarray) -> bytes:
    """The number of shingles, and the buckets that hold an odd number of them: the least power of two of buckets that is not under that number, and 64 at least."""
    size = max(64, 1 << max(0, len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return len(hashes).to_bytes(4, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_alike(a: bytes, b: bytes, similarity: float) -> bool:
    """Do parity bits allow the similarity?  A larger table is folded to the size of the smaller one."""
    n, m = int.from_bytes(a[:4], "little"), int.from_bytes(b[:4], "little")
    x, y = np.frombuffer(a, np.uint8, offset=4), np.frombuffer(b, np.uint8, offset=4)
    width = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, width), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum()) <= (n + m) * (1 - similarity) / (1 + similarity) + 1e-6


def prefix(hashes: np.ndarray, late: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a text: those of ``late`` (sorted) come after all others, else the hash is the order."""
    if not len(hashes):
        return hashes
    n = len(hashes) - math.ceil(similarity * len(hashes) - 1e-6) + 1
    if len(late):
        often = late[np.minimum(np.searchsorted(late, hashes), len(late) - 1)] == hashes
        hashes = np.concatenate([hashes[~often], hashes[often]])
    return hashes[:n]


def frequent_shingles(docs: DataFrame, size: int = STAGE_SHINGLE) -> np.ndarray:
    """Sorted hashes of the shingles that a sample of the texts has often, the most frequent ones if they are many."""

    def run(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                yield pa.record_batch([pa.array(shingle_hashes(x, size).view(np.int64))], ["s"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    counts = sample.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    rows = counts.orderBy(F.desc("n"), "s").limit(LATE_LIMIT).select("s").collect()
    return np.sort(np.array([r["s"] for r in rows], np.int64).view(np.uint64))


def sketches(docs: DataFrame, late: np.ndarray, similarity: float = SIMILARITY, size: int = STAGE_SHINGLE) -> DataFrame:
    """doc_id, digest of the words (two longs), fingerprint, number of shingles, their parity bits and the first shingles."""
    schema = "doc_id long, h1 long, h2 long, fp long, n int, bits binary, parts array<long>"

    def run(batches):
        import xxhash

        for b in batches:
            texts = b.column(1).to_pylist()
            two = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join((x or "").encode("utf-8").lower().split())) for x in texts), "<i8").reshape(-1, 2)
            hashes = [shingle_hashes(x, size) for x in texts]
            parts = pa.array([prefix(h, late, similarity).view(np.int64) for h in hashes], pa.list_(pa.int64()))
            n, bits = pa.array([len(h) for h in hashes], pa.int32()), pa.array([parity_bits(h) for h in hashes], pa.binary())
            fps = pa.array(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64), pa.int64())
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), fps, n, bits, parts], ["doc_id", "h1", "h2", "fp", "n", "bits", "parts"])

    return docs.select("doc_id", "text").filter("doc_id is not null").mapInArrow(run, schema)


def fingerprint_pairs(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (x, y) of texts (rep, fp, n) by the range join of their fingerprints, if so many shingles can have the similarity.

    Texts of one fingerprint meet its least id, and least ids meet where their fingerprints link.
    """
    texts = texts.select("rep", "fp", "n")
    first = stored(texts.groupBy("fp").agg(F.min(F.struct("rep", "n")).alias("least")), "prints")
    near = links(first.select("fp"))
    linked = stored(near, "print-links")
    discard(near)
    of = lambda k: first.select(F.col("fp").alias(k), F.col("least").alias(f"of_{k}"))
    apart = linked.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a.rep").alias("x"), F.col("of_a.n").alias("n"), F.col("of_b.rep").alias("y"), F.col("of_b.n").alias("m"))
    same = texts.join(first, "fp").filter("rep <> least.rep").select(F.col("rep").alias("x"), "n", F.col("least.rep").alias("y"), F.col("least.n").alias("m"))
    pairs = apart.unionByName(same).filter(_sizes("n", "m", similarity))
    pairs = stored(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "print-pairs")
    discard(first, linked)
    return pairs


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, size: int = STAGE_SHINGLE) -> DataFrame:
    """doc_id and ``root``: the smallest id of the group that similar texts form.

    A stored table is deleted, and shuffle files are released, as soon as what reads them is stored.
    """
    every = stored(sketches(docs, frequent_shingles(docs, size), similarity, size), "sketches")
    whole = stored(every.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("parts").alias("parts")), "texts")
    named = stored(every.select("doc_id", "h1", "h2"), "named")
    discard(every)
    release_shuffles(docs.sparkSession)
    members = stored(whole.select("rep", "n", "parts"), "parts").select("rep", "n", F.explode("parts").alias("s"))
    texts = stored(whole.drop("parts"), "texts")
    discard(whole)
    bits = texts.select(F.col("rep").alias("id"), F.col("bits").alias("v"))

    cells = stored(members.groupBy("s").agg(F.count("*").alias("k")).filter("k > 1"), "cells")
    release_shuffles(docs.sparkSession)
    shared = stored(members.join(cells, "s"), "shared")
    discard(members, cells)
    release_shuffles(docs.sparkSession)

    by_print = verified(fingerprint_pairs(texts, similarity), bits, docs, similarity, size)

    # a text's weight is the number of its shingles that others have
    weights = stored(shared.groupBy("rep").agg(F.count("*").alias("w")), "weights")
    weighed = stored(shared.join(weights, "rep"), "weighed")
    ends = weighed.groupBy("s").agg(F.min(F.struct("rep", "n")).alias("least"), F.max(F.struct("w", F.negative("rep").alias("r"), "rep", "n")).alias("most"))
    ends = stored(ends.select("s", "least", F.struct("most.rep", "most.n").alias("most")), "ends")
    discard(weights, weighed)
    release_shuffles(docs.sparkSession)

    met = shared.join(ends, "s").select(F.col("rep").alias("x"), "n", F.explode(F.array("least", "most")).alias("y")).filter(_sizes("n", "y.n", similarity))
    pairs = met.select("x", F.col("y.rep").alias("y")).filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    pairs = stored(pairs.join(by_print, ["x", "y"], "left_anti"), "pairs")
    discard(ends)
    release_shuffles(docs.sparkSession)
    alike = by_print.unionByName(verified(pairs, bits, docs, similarity, size))
    linked = components(alike.select(F.col("x").alias("a"), F.col("y").alias("b")), "linked")
    roots = stored(linked, "linked-roots")
    discard(pairs, linked)
    release_shuffles(docs.sparkSession)
    rooted = shared.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rooted = stored(rooted, "rooted")
    discard(shared, roots)
    alike = alike.unionByName(unlinked(rooted, bits, docs, similarity, size))
    roots = components(alike.select(F.col("x").alias("a"), F.col("y").alias("b")), "groups")
    by_text = texts.select("h1", "h2", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("root", "rep").alias("root"))
    groups = stored(named.join(by_text, ["h1", "h2"]).select("doc_id", "root"), "groups-of-rows")
    discard(rooted, alike, roots, texts, named)
    release_shuffles(docs.sparkSession)
    return groups


def _sizes(n: str, m: str, similarity: float) -> Column:
    """Whether sets of so many shingles can have the similarity."""
    return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6


def unlinked(rooted: DataFrame, bits: DataFrame, docs: DataFrame, similarity: float, size: int) -> DataFrame:
    """Similar pairs (x, y) of members (s, rep, n, root) of one cell that have different roots, at least one for each two roots that have any."""
    by_root = stored(rooted.groupBy("s", "root").agg(F.count("*").alias("c")), "by-root")
    main = by_root.groupBy("s").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("k"), F.count("*").alias("roots")).filter("roots > 1")
    main = stored(main.select("s", F.col("m.root").alias("main"), (F.col("k") - F.col("m.c")).alias("others")), "mixed-cells")
    mixed = stored(rooted.join(main, "s"), "mixed")
    discard(by_root, main)

    # small cells; the count is of all that a pair shares unless it shares a dense one, where it is compared anyway
    few = mixed.filter(F.col("k") <= PAIR_LIMIT)
    side = lambda k: few.select("s", F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("root").alias(f"r{k}"))
    pairs = side("x").join(side("y"), "s").filter((F.col("x") < F.col("y")) & (F.col("rx") != F.col("ry")) & _sizes("nx", "ny", similarity))
    pairs = pairs.groupBy("x", "y").agg(F.count("*").alias("c"), F.first("nx").alias("nx"), F.first("ny").alias("ny"))
    need = (F.col("nx") + F.col("ny")) * (similarity / (1 + similarity)) - 1e-6
    # shingles in common that are not among the first of both lie beyond the first ones of one of them
    rest = F.ceil(F.greatest("nx", "ny") * similarity - 1e-6) - 1
    release_shuffles(docs.sparkSession)
    pairs = stored(pairs.filter(F.col("c") + rest >= need).select("x", "y"), "pairs")
    release_shuffles(docs.sparkSession)
    small = verified(pairs, bits, docs, similarity, size)
    discard(pairs)

    # dense cells: the members outside the main root against all, block by block
    many = mixed.filter(F.col("k") > PAIR_LIMIT)
    rows, cols = F.ceil(F.col("others") / BLOCK_ROWS).cast("int"), F.ceil(F.col("k") / BLOCK_ROWS).cast("int")
    draw = F.xxhash64("rep", F.lit(SEED))
    left = many.filter("root <> main").select("s", "rep", "root", F.lit(0).alias("side"), F.pmod(draw, rows).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), cols - 1)).alias("j"))
    right = many.select("s", "rep", "root", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), rows - 1)).alias("i"), F.pmod(draw, cols).cast("int").alias("j"))
    asked = stored(many.select(F.col("rep").alias("doc_id")).distinct(), "asked-sets")
    hashed = stored(_hashed(docs, asked, size), "hashed")
    discard(asked)
    release_shuffles(docs.sparkSession)

    def compare(table: pa.Table) -> pa.Table:
        side, rep, root = (table.column(k).to_numpy() for k in ("side", "rep", "root"))
        sets = [np.frombuffer(h, np.uint64) for h in table.column("h").to_pylist()]
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        x, y = np.nonzero(alike_sets([sets[i] for i in a], [sets[i] for i in b], similarity))
        x, y = a[x], b[y]
        new = root[x] != root[y]
        x, y = x[new], y[new]
        ends = np.stack([np.minimum(root[x], root[y]), np.maximum(root[x], root[y])], axis=1)
        once = np.unique(ends, axis=0, return_index=True)[1] if len(ends) else np.zeros(0, np.int64)
        return pa.table({"x": pa.array(rep[x[once]], pa.int64()), "y": pa.array(rep[y[once]], pa.int64())})

    dense = left.unionByName(right).join(hashed.withColumnRenamed("doc_id", "rep"), "rep").groupBy("s", "i", "j").applyInArrow(compare, "x long, y long")
    alike = stored(small.unionByName(dense).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "alike")
    discard(small, mixed, hashed)
    release_shuffles(docs.sparkSession)
    return alike


def alike_sets(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets on the left have the similarity with which on the right, by products of incidence matrices."""
    sizes = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    shared = np.zeros((len(left), len(right)), np.float64)
    if not shared.size:
        return shared > 0
    own = [np.repeat(np.arange(len(n)), n) for n in sizes]
    hashes = [np.concatenate(x) for x in (left, right)]
    common = np.intersect1d(np.unique(hashes[0]), np.unique(hashes[1]), assume_unique=True)
    at = [np.searchsorted(common, h) for h in hashes]
    known = [(p < len(common)) & (common[np.minimum(p, max(0, len(common) - 1))] == h) if len(common) else np.zeros(len(h), bool) for p, h in zip(at, hashes, strict=True)]
    own, at = [o[k] for o, k in zip(own, known, strict=True)], [p[k] for p, k in zip(at, known, strict=True)]
    order = [np.argsort(p, kind="stable") for p in at]
    own, at = [o[k] for o, k in zip(own, order, strict=True)], [p[k] for p, k in zip(at, order, strict=True)]
    for begin in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - begin)
        part = []
        for o, p, n in zip(own, at, sizes, strict=True):
            lo, hi = np.searchsorted(p, [begin, begin + width])
            m = np.zeros((len(n), width), np.float32)
            m[o[lo:hi], p[lo:hi] - begin] = 1
            part.append(m)
        shared += part[0] @ part[1].T
    return shared >= similarity * (sizes[0][:, None] + sizes[1][None, :] - shared)


def _hashed(docs: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """doc_id and ``h``, the shingle hashes of its text, of the documents asked for."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array([shingle_hashes(x, size).tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "h"])

    texts = sifted(docs.select("doc_id", "text"), asked)[1].join(asked, "doc_id", "left_semi")
    return texts.mapInArrow(run, "doc_id long, h binary")


PAIRS_A_BLOCK = 2_000


def one_a_document(docs: DataFrame) -> DataFrame:
    """Of rows that share an id, the one whose text has the least digest, null first; only such rows are shuffled."""
    several = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated-ids")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rank = F.struct(F.coalesce(F.sha2("text", 256), F.lit("")), F.to_json(row))
    chosen = docs.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, rank).alias("row")).select("row.*")
    return docs.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(chosen)


def _met(pairs: DataFrame, values: DataFrame, label: str) -> tuple[DataFrame, list[DataFrame]]:
    """hub, leaf and their values s and t, of each pair (x, y), and the tables stored for them; ``values`` has columns id and v.

    Each pair goes from its ``leaf``, which is in fewer pairs, to its ``hub``; so no leaf
    has more pairs than about the square root of all.  The pairs of a hub are dealt to
    blocks of about PAIRS_A_BLOCK, and its value goes once to each.
    """
    degree = stored(pairs.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.count("*").alias("n")), "degrees")
    asked = stored(sifted(values, degree, "id")[1].join(degree, "id").select("id", "n", "v"), label)
    of = lambda k: degree.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"))
    met = pairs.join(of("x"), "x").join(of("y"), "y")
    turned = F.col("nx") >= F.col("ny")
    met = met.select(F.when(turned, F.col("x")).otherwise(F.col("y")).alias("hub"), F.when(turned, F.col("y")).otherwise(F.col("x")).alias("leaf"), F.greatest("nx", "ny").alias("n"))
    blocks = F.ceil(F.col("n") / PAIRS_A_BLOCK).cast("int")
    leaves = met.withColumn("part", F.pmod(F.xxhash64("leaf"), blocks).cast("int")).join(asked.select(F.col("id").alias("leaf"), F.col("v").alias("t")), "leaf")
    hubs = asked.select(F.col("id").alias("hub"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("part"), F.col("v").alias("s"))
    return leaves.join(hubs, ["hub", "part"]).select("hub", "leaf", "s", "t"), [degree, asked]


def verified(pairs: DataFrame, bits: DataFrame, docs: DataFrame, similarity: float, size: int) -> DataFrame:
    """The pairs (x, y) whose texts have the similarity: those whose parity bits (id, v) allow it, compared by their whole shingle sets."""

    def possible(batches):
        for b in batches:
            keep = [may_be_alike(s, t, similarity) for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1)], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    def similar(batches):
        for b in batches:
            keep, last, mine = [], None, None
            for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if mine is None or s != last:
                    last, mine = s, shingle_hashes(s, size)
                other = shingle_hashes(t, size)
                shared = len(np.intersect1d(mine, other, assume_unique=True))
                union = len(mine) + len(other) - shared
                keep.append(union == 0 or shared >= similarity * union)
            yield pa.record_batch([b.column(0), b.column(1)], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    met, scratch = _met(pairs.select("x", "y"), bits, "asked-bits")
    left = stored(met.mapInArrow(possible, "x long, y long").distinct(), "possible")
    discard(*scratch)
    release_shuffles(docs.sparkSession)
    # texts rather than sets travel: they are smaller, and compress
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("v"))
    met, scratch = _met(left, texts, "asked")
    alike = stored(met.mapInArrow(similar, "x long, y long").distinct(), "alike")
    discard(left, *scratch)
    release_shuffles(docs.sparkSession)
    return alike


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, size: int = STAGE_SHINGLE) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their group of similar texts, one row for an id; rows without an id stay.

    Blank texts are similar to one another.  Of rows that share an id and differ in text, only the one with the least digest of its text counts.
    """
    one = one_a_document(docs.filter("doc_id is not null"))
    groups = similar_groups(one, similarity, size)
    gone = stored(groups.filter("doc_id <> root").select("doc_id"), "gone")
    discard(groups)
    sure, others = sifted(one, gone)
    return sure.unionByName(others.join(gone, "doc_id", "left_anti").select(*docs.columns)).unionByName(docs.filter("doc_id is null"))
