"""Nearest neighbours by inverted lists: vectors lie in the list of their nearest centroid, and a query looks into few lists.

The centroids come from a bounded sample and stay the same for all rows; every row is
indexed.  A filter (here: the label) is part of the join's key, so that it cuts a list before the
list is scanned.  A label's vectors are dealt to parts, so that no task gets a list of very many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.operators.retrieval import PART, QUERY_BLOCK, unit_vectors
from quillmill.operators.scoring import Best, importable, rounded_key
from quillmill.plans.catalogue import register

#: Vectors that the centroids are fitted on at most, and lists at most: what the driver and each task hold.
SAMPLE, LISTS = 20_000, 1024
#: The part of the lists that is probed. The given vectors form no clusters, so that a recall of 0.9 takes most lists; clustered ones need few.
PROBED = 0.85


def centroids(vectors: DataFrame, lists: int | None = None, rounds: int = 8) -> np.ndarray:
    """Unit centroids of a sample of at most ``SAMPLE`` vectors (by a hash of their id), by spherical k-means."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"].to_pylist()
    if not sample:
        return np.zeros((0, 0))
    x = np.array(sample)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    k = min(lists or math.ceil(math.sqrt(len(x))), LISTS, len(x))
    c = x[:k].copy()
    for _ in range(rounds):
        nearest = (x @ c.T).argmax(1)
        for j in range(k):
            mean = x[nearest == j].sum(0)
            if (size := np.linalg.norm(mean)) > 0:
                c[j] = mean / size
    return c


def listed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``vec_id``, ``label``, unit ``v``, its ``list`` and the ``angle`` to the list's centroid."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(2).to_pylist(), float)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                near = x @ centres.T
                best = near.argmax(1)
                angle = np.arccos(np.clip(near[np.arange(len(x)), best], -1, 1))
                yield pa.record_batch([b.column(0), b.column(1), pa.array(x.tolist()), pa.array(best, pa.int32()), pa.array(angle)], ["vec_id", "label", "v", "list", "angle"])

    return vectors.select("vec_id", "label", "v").mapInArrow(assign, "vec_id long, label int, v array<double>, list int, angle double")


def probes(queries: DataFrame, centres: np.ndarray, radius: dict[int, float]) -> DataFrame:
    """For each query the ``lists`` by nearness, and the ``most`` that a vector of each can score.

    No vector of a list is nearer to the query than the centroid's angle less the list's radius.
    """
    widths = np.array([radius.get(j, -1.0) for j in range(len(centres))])
    there = np.flatnonzero(widths >= 0)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = np.array(b.column(2).to_pylist(), float)
                q /= np.linalg.norm(q, axis=1, keepdims=True)
                angle = np.arccos(np.clip(q @ centres.T, -1, 1))[:, there]
                order = np.argsort(angle, axis=1, kind="stable")
                most = np.take_along_axis(np.cos(np.maximum(0, angle - widths[there])), order, axis=1)
                lists = pa.array(there[order].tolist(), pa.list_(pa.int32()))
                yield pa.record_batch([b.column(0), b.column(1), pa.array(q.tolist(), pa.list_(pa.float64())), lists, pa.array(most.tolist(), pa.list_(pa.float64()))], ["query_id", "label", "qv", "lists", "most"])

    return queries.select("vec_id", "label", "v").mapInArrow(rank, "query_id long, label int, qv array<double>, lists array<int>, most array<double>")


def _scanned(lists: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``vec_id``, ``key`` (the score rounded to nine digits, as a whole number) and ``score`` of vectors with the query's label in the lists that it wants.

    A label's queries are taken in blocks of about QUERY_BLOCK, and its vectors dealt to parts of about PART. A task makes the scores of a block
    and a part list by list, by a product of matrices, and keeps each query's best ``k``: pairs are neither stored nor shuffled.
    """
    parts = lists.groupBy("label").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    blocks = wanted.groupBy("label").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    sizes = parts.join(blocks, "label")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda k, n: F.pmod(F.xxhash64(k), F.col(n)).cast("int")
    asked = wanted.join(sizes, "label").select("query_id", "label", "qv", "lists", dealt("query_id", "blocks").alias("block"), numbers("parts").alias("part"))
    vectors = lists.join(sizes, "label").select("vec_id", "label", "list", "v", numbers("blocks").alias("block"), dealt("vec_id", "parts").alias("part"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        query, vec, of = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy(), right.column("list").to_numpy()
        best = Best(len(query), k, 1)
        if len(query) and len(vec):
            mine, others = (matrix(t.column(c)) for t, c in ((left, "qv"), (right, "v")))
            ends = left.column("lists").combine_chunks()
            wants, who = ends.flatten().to_numpy(), np.repeat(np.arange(len(query)), ends.value_lengths().to_numpy())
            order = np.argsort(wants, kind="stable")
            wants, who = wants[order], who[order]
            for j in np.unique(of):
                rows, cols = who[slice(*np.searchsorted(wants, [j, j + 1]))], np.flatnonzero(of == j)
                scores = mine[rows] @ others[cols].T
                # those under the k-th so far are left out
                ok = (scores > 0) & (vec[cols][None, :] != query[rows][:, None]) & (scores >= best.least[rows][:, None] / 1e9 - 1e-8)
                x, y = np.nonzero(ok)
                best.offer(rows[x], vec[cols][y], rounded_key(scores[x, y], 9), scores[x, y])
        i, found, key, score = best.kept
        return pa.table({"query_id": pa.array(query[i], pa.int64()), "vec_id": pa.array(found, pa.int64()), "key": pa.array(key, pa.int64()), "score": pa.array(score, pa.float64())})

    keys = ("label", "block", "part")
    return asked.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, key long, score double")


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    v = vectors.combine_chunks()
    return v.flatten().to_numpy().reshape(len(v), -1)


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), F.asc("vec_id"))
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, probe: int | None = None, exact: bool = False) -> DataFrame:
    """``query_id``, ``vec_id``, ``score`` and ``rank`` of the ``k`` nearest vectors with the query's label.

    ``PROBED`` of the lists are probed unless ``probe`` says how many.  With ``exact``, the lists not
    probed are scanned too where they may hold a vector that scores as much as the k-th found.
    """
    known = "vec_id is not null and label is not null"
    vectors, queries = importable(vectors).filter(known), queries.filter(known)
    centres = centroids(vectors)
    lists = listed(vectors, centres)
    radius = dict(tuple(r) for r in lists.groupBy("list").agg(F.max("angle")).collect())  # LISTS rows at most
    every = probes(queries, centres, radius)
    probe = probe or max(1, math.ceil(len(centres) * PROBED))
    first = _scanned(lists, every.withColumn("lists", F.slice("lists", 1, probe)), k)
    if not exact:
        return _best(first, k).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")
    least = _best(first, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    may = every.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - 1e-8)
    rest = F.filter(F.arrays_zip("lists", "most"), lambda x, i: (i >= probe) & (x["most"] >= F.col("least")))
    may = may.withColumn("lists", F.transform(rest, lambda x: x["lists"])).filter(F.size("lists") > 0)
    both = first.unionByName(_scanned(lists, may, k))
    return _best(both, k).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_COSINE = "list_inner_product(q.v, d.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(d.v, d.v)))"


@register(
    "filtered_neighbours",
    f"""WITH {_UNIT} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, d.vec_id, {_COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COSINE}, 9) DESC, d.vec_id) AS rank
  FROM u q JOIN u d ON q.label = d.label WHERE q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id AND {_COSINE} > 0) t WHERE rank <= 10""",
)
def filtered_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact nearest vectors of the query's label, by lists whose bound can't be beaten."""
    v = unit_vectors(spark, sf_dir)
    return neighbours(v, v.filter("vec_id % 20 = 0"), exact=True)


@register("probed_neighbours")
def probed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors that the probed lists hold: a test measures their recall."""
    v = unit_vectors(spark, sf_dir)
    return neighbours(v, v.filter("vec_id % 20 = 0"))
