"""Candidate search, fusion, scores and selections."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions.vectors import jaccard, norm
from quillmill.operators.scoring import CHUNK, NO_ID, Best, best_documents, documents_of, importable, question_blocks, rounded_key, rows_by_id
from quillmill.plans.catalogue import register
from quillmill.sources.views import table

#: Queries of a block and vectors of a part: what a task holds.
QUERY_BLOCK, PART = 4096, 4096


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    v = v.withColumn("n", norm(F.col("embedding"))).filter("n > 0")
    return v.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "n")


_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_COSINE = "list_inner_product(q.v, d.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(d.v, d.v)))"


def vector_best(spark: SparkSession, sf_dir: str, k: int, positive: bool) -> DataFrame:
    """``query_id``, ``vec_id``, ``label``, ``key`` (the score rounded to nine digits, as a whole number) and ``score``: each query (ids divisible by 20) against every vector.

    Queries are taken in blocks of about QUERY_BLOCK, and vectors are dealt to parts of about PART.  A task makes the scores of
    a block and a part by a product of matrices, and keeps the ``k`` best of each query: pairs are neither stored nor shuffled.
    """
    v = importable(unit_vectors(spark, sf_dir))
    q = v.filter("vec_id % 20 = 0")
    n_blocks = max(1, math.ceil(q.count() / QUERY_BLOCK))  # numbers without gaps, whatever the ids are
    n_parts = max(1, math.ceil(v.count() / PART))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    asked = q.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.col("n").alias("qn"), dealt(n_blocks).alias("block"), numbers(n_parts).alias("part"))
    vectors = v.select("vec_id", "label", "v", "n", numbers(n_blocks).alias("block"), dealt(n_parts).alias("part"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({n: pa.array([], t) for n, t in zip(("query_id", "vec_id", "label", "key", "score"), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)})
        if not (left.num_rows and right.num_rows):
            return empty
        ids, mine, others = (t.column(c).to_pylist() for t, c in ((left, "query_id"), (left, "qv"), (right, "v")))
        length, norms = left.column("qn").to_numpy(), right.column("n").to_numpy()
        doc = right.column("vec_id").fill_null(NO_ID).to_numpy()
        best, sizes = Best(len(ids), k, 2), np.array([len(x) for x in others])
        widths = np.array([len(x) for x in mine])
        for w in np.unique(widths):  # vectors of one length can be compared
            rows, cols = np.flatnonzero(widths == w), np.flatnonzero(sizes == w)
            a = np.array([mine[i] for i in rows], float)
            for at in range(0, len(cols), CHUNK):
                some = cols[at : at + CHUNK]
                scores = a @ np.array([others[i] for i in some], float).T / (length[rows][:, None] * norms[some][None, :])
                ok = doc[some][None, :] != np.array([ids[i] for i in rows])[:, None]
                ok &= scores >= best.least[rows][:, None] / 1e9 - 1e-8  # the others are under the k-th
                i, j = np.nonzero(ok & (scores > 0) if positive else ok)
                best.offer(rows[i], doc[some][j], np.floor(scores[i, j] * 1e9 + 0.5), some[j], scores[i, j])
        query, vec, key, row, score = best.kept
        label = right.column("label").take(pa.array(row.astype(np.int64)))
        return pa.table([pa.array([ids[i] for i in query.tolist()], pa.int64()), pa.array(vec, pa.int64(), mask=vec == NO_ID), label.cast(pa.int32()).combine_chunks(), pa.array(key), pa.array(score)], empty.schema)

    near = asked.groupBy("block", "part").cogroup(vectors.groupBy("block", "part")).applyInArrow(compare, "query_id long, vec_id long, label int, key long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), F.asc_nulls_last("vec_id"))
    return near.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


@register(
    "vector_topk",
    f"""WITH {_UNIT} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT q.vec_id AS query_id, d.vec_id, {_COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COSINE}, 9) DESC, d.vec_id) AS rank
  FROM u q, u d WHERE q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id AND {_COSINE} > 0) t WHERE rank <= 10""",
)
def vector_topk(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Exact cosine top k."""
    return vector_best(spark, sf_dir, k, positive=True).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _asked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id and its distinct terms (letters, over three of them)."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)))
    return table(spark, sf_dir, "benchmark").select("item_id", terms.alias("asked"))


def term_counts(rows: list[list[str]], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The document's number, term, tf and length in terms, of each known term that it holds; rows of one document and length count as one."""
    doc, term, length = [], [], []
    for i, texts in enumerate(rows):
        for text in texts:
            words = re.findall("[a-z]{4,}", text)
            found = [known[w] for w in words if w in known]
            doc += [i] * len(found)
            term += found
            length += [len(words)] * len(found)
    if not doc:
        return (np.zeros(0, np.int64),) * 4
    (doc, length, term), tf = np.unique(np.array([doc, length, term], np.int64), axis=1, return_counts=True)
    return doc, term, tf, length


_TERMS = """qt AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM benchmark),
ds AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{4,}') AS terms FROM documents),
dt AS (SELECT doc_id, len(terms) AS length, term, count(*) AS tf FROM (SELECT doc_id, terms, unnest(terms) AS term FROM ds) t GROUP BY doc_id, len(terms), term),
df AS (SELECT term, count(*) AS df FROM dt GROUP BY term), nn AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM ds)"""


def _collection(spark: SparkSession, sf_dir: str) -> tuple[int, float]:
    d = table(spark, sf_dir, "documents")
    n, mean = d.agg(F.count("*"), F.avg(F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))))).first()
    return n, mean or 1.0


def _scored(spark: SparkSession, sf_dir: str, k: int, weight: Callable[..., np.ndarray]) -> DataFrame:
    """The ``k`` best documents of each question by the sum of its terms' ``weight`` (of tf, length, df, and how many documents of which mean length there are).

    Texts are read twice for each block of questions: for the document counts of its terms, and for the scores.
    """
    n, mean = _collection(spark, sf_dir)
    documents = rows_by_id(table(spark, sf_dir, "documents"), F.lower(F.coalesce("text", F.lit(""))))

    def block_of(block: dict[int | None, list[str]]) -> DataFrame:
        ids = list(block)
        known = {w: i for i, w in enumerate(dict.fromkeys(w for words in block.values() for w in words))}
        asks = np.zeros((len(known), len(ids)))
        for j, words in enumerate(block.values()):
            asks[[known[w] for w in words], j] = 1

        def held(batches):
            df = np.zeros(len(known), np.int64)
            for _, rows in documents_of(batches):
                df += np.bincount(term_counts(rows, known)[1], minlength=len(known))
            there = np.flatnonzero(df)
            yield pa.record_batch([pa.array(there), pa.array(df[there])], ["term", "df"])

        df = np.zeros(len(known), np.int64)
        for r in documents.mapInArrow(held, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # the block's terms at most
            df[r["term"]] = r["df"]

        def score(doc: np.ndarray, rows: list[list[str]], best: Best) -> None:
            own, term, tf, length = term_counts(rows, known)
            w = weight(tf, length, df[term], n, mean)
            ends = np.searchsorted(own, np.arange(len(rows) + 1))
            scores = np.stack([w[a:b] @ asks[term[a:b]] for a, b in zip(ends, ends[1:], strict=False)])
            d, q = np.nonzero(scores)
            best.offer(q, doc[d], rounded_key(scores[d, q], 6), scores[d, q])

        return best_documents(documents, k, len(ids), ids, score, {"score": "double"})

    schema = "item_id long, doc_id long, key long, score double"
    found = reduce(DataFrame.unionByName, map(block_of, question_blocks(_asked_terms(spark, sf_dir))), spark.createDataFrame([], schema))
    order = Window.partitionBy("item_id").orderBy(F.desc("key"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
    return ranked.select("item_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@register(
    "tfidf_search",
    f"""WITH {_TERMS} SELECT item_id, doc_id, round(score, 4) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM (
    SELECT item_id, doc_id, sum((1 + ln(1 + tf)) * (ln((1 + n) / (1.0::DOUBLE + df)) + 1)) AS score FROM qt JOIN dt USING (term) JOIN df USING (term), nn GROUP BY item_id, doc_id) a) b WHERE rank <= 10""",
)
def tfidf_search(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Lexical search of the evaluation questions."""
    return _scored(spark, sf_dir, k, lambda tf, length, df, n, mean: (1 + np.log(1 + tf)) * (np.log((1 + n) / (1.0 + df)) + 1))


@register(
    "bm25_search",
    f"""WITH {_TERMS} SELECT item_id, doc_id, round(score, 4) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM (
    SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl))) AS score
    FROM qt JOIN dt USING (term) JOIN df USING (term), nn GROUP BY item_id, doc_id) a) b WHERE rank <= 10""",
)
def bm25_search(spark: SparkSession, sf_dir: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25, which stands for the ranking of a search service."""
    return _scored(spark, sf_dir, k, lambda tf, length, df, n, mean: np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)))


def ranked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of parts for each brand: by price and by size."""
    p = table(spark, sf_dir, "part")
    by = lambda *o: F.row_number().over(Window.partitionBy("p_brand").orderBy(*o))
    return p.select("p_brand", "p_partkey", "p_type", "p_size", "p_retailprice", by(F.desc("p_retailprice"), "p_partkey").alias("r1"), by(F.desc("p_size"), "p_partkey").alias("r2"))


_LISTS = """lists AS (SELECT p_brand, p_partkey, p_type, p_size, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r1,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r2 FROM part)"""


@register(
    "rrf_fusion",
    f"""WITH {_LISTS}, hits AS (SELECT p_brand, p_partkey, r1 AS r FROM lists WHERE r1 <= 20 UNION ALL SELECT p_brand, p_partkey, r2 FROM lists WHERE r2 <= 20)
SELECT p_brand, p_partkey, round(sum(1.0::DOUBLE / (60 + r)), 8) AS score, count(*) AS lists FROM hits GROUP BY p_brand, p_partkey""",
)
def rrf_fusion(spark: SparkSession, sf_dir: str, k: int = 60, depth: int = 20) -> DataFrame:
    """Reciprocal rank fusion of two lists."""
    lists = ranked_lists(spark, sf_dir)
    hits = lists.select("p_brand", "p_partkey", F.explode(F.array("r1", "r2")).alias("r")).filter(F.col("r") <= depth)
    return hits.groupBy("p_brand", "p_partkey").agg(F.round(F.sum(1.0 / (max(k, 1) + F.col("r"))), 8).alias("score"), F.count("*").alias("lists"))


@register(
    "parent_diversity",
    f"""WITH {_LISTS}, capped AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY r1) AS per FROM lists)
SELECT p_brand, p_partkey, p_type, pos FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY r1) AS pos FROM capped WHERE per <= 2) t WHERE pos <= 8""",
)
def parent_diversity(spark: SparkSession, sf_dir: str, per_parent: int = 2, most: int = 8) -> DataFrame:
    """At most so many results of a parent, in order, until the list is full."""
    lists = ranked_lists(spark, sf_dir)
    capped = lists.withColumn("per", F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy("r1"))).filter(F.col("per") <= per_parent)
    ranked = capped.withColumn("pos", F.row_number().over(Window.partitionBy("p_brand").orderBy("r1")).cast("long"))
    return ranked.filter(F.col("pos") <= most).select("p_brand", "p_partkey", "p_type", "pos")


@register(
    "candidate_merge",
    f"""WITH {_LISTS}, t AS (SELECT p_brand, p_partkey, 1.0::DOUBLE / r1 AS text_score FROM lists WHERE r1 <= 15), v AS (SELECT p_brand, p_partkey, p_size / 50.0::DOUBLE AS vec_score FROM lists WHERE r2 <= 15)
SELECT coalesce(t.p_brand, v.p_brand) AS p_brand, coalesce(t.p_partkey, v.p_partkey) AS p_partkey, round(coalesce(text_score, 0) + coalesce(vec_score, 0) * 0.25, 6) AS score FROM t FULL JOIN v ON t.p_brand = v.p_brand AND t.p_partkey = v.p_partkey""",
)
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text hits count with their best score, vector hits add a weighted one: one aggregation over the union."""
    lists = ranked_lists(spark, sf_dir)
    none = F.lit(None).cast("double")
    text = lists.filter("r1 <= 15").select("p_brand", "p_partkey", (1.0 / F.col("r1")).alias("t"), none.alias("v"))
    vector = lists.filter("r2 <= 15").select("p_brand", "p_partkey", none.alias("t"), (F.col("p_size") / 50.0).alias("v"))
    score = F.coalesce(F.max("t"), F.lit(0.0)) + F.coalesce(F.sum("v"), F.lit(0.0)) * 0.25
    return text.unionByName(vector).groupBy("p_brand", "p_partkey").agg(F.round(score, 6).alias("score"))


@register(
    "weighted_union",
    f"""WITH {_LISTS}, q AS (SELECT p_brand, p_partkey, 1.0::DOUBLE * (100 - r1) AS s, p_size = 50 AS exact FROM lists WHERE r1 <= 30 UNION ALL SELECT p_brand, p_partkey, 0.88::DOUBLE * (100 - r2), p_size = 50 FROM lists WHERE r2 <= 30)
SELECT p_brand, p_partkey, round(max(CASE WHEN exact THEN greatest(s, 100.0) ELSE s END), 4) AS score FROM q GROUP BY p_brand, p_partkey""",
)
def weighted_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first query counts fully, further ones less; exact hits have a floor."""
    lists = ranked_lists(spark, sf_dir)
    first = lists.filter("r1 <= 30").select("p_brand", "p_partkey", "p_size", (1.0 * (100 - F.col("r1"))).alias("s"))
    other = lists.filter("r2 <= 30").select("p_brand", "p_partkey", "p_size", (0.88 * (100 - F.col("r2"))).alias("s"))
    s = F.when(F.col("p_size") == 50, F.greatest("s", F.lit(100.0))).otherwise(F.col("s"))
    return first.unionByName(other).groupBy("p_brand", "p_partkey").agg(F.round(F.max(s), 4).alias("score"))


@register(
    "log_rank",
    """SELECT p_brand, p_partkey, round(ln(1 + p_retailprice) / ln(1 + max(p_retailprice) OVER (PARTITION BY p_brand)) * 1.25, 6) AS score FROM part""",
)
def log_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by the logarithm of the best one of their query: the best is an aggregate joined back, not a window over raw rows."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    best = p.groupBy("p_brand").agg(F.max("p_retailprice").alias("best"))
    return p.join(best, "p_brand").select("p_brand", "p_partkey", F.round(F.log1p("p_retailprice") / F.log1p("best") * 1.25, 6).alias("score"))


@register(
    "quota_selection",
    f"""WITH {_LISTS}, g AS (SELECT *, p_type = 'ECONOMY' AS is_global, row_number() OVER (PARTITION BY p_brand, p_type = 'ECONOMY' ORDER BY r1) AS within FROM lists)
SELECT p_brand, p_partkey, is_global FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN is_global AND within <= 3 THEN 0 ELSE 1 END, r1) AS pos FROM g) t WHERE pos <= 9""",
)
def quota_selection(spark: SparkSession, sf_dir: str, n: int = 9) -> DataFrame:
    """The best n with at least a third global rows, where there are as many; the lowest local rows give way."""
    lists = ranked_lists(spark, sf_dir).withColumn("is_global", F.col("p_type") == "ECONOMY")
    lists = lists.withColumn("within", F.row_number().over(Window.partitionBy("p_brand", "is_global").orderBy("r1")))
    first = F.when(F.col("is_global") & (F.col("within") <= max(1, n // 3)), 0).otherwise(1)
    return lists.withColumn("pos", F.row_number().over(Window.partitionBy("p_brand").orderBy(first, "r1"))).filter(F.col("pos") <= n).select("p_brand", "p_partkey", "is_global")


@register(
    "rerank_order",
    f"""WITH {_LISTS} SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN r2 <= 5 THEN r2 ELSE 1000000 + r1 END) AS pos FROM lists WHERE r1 <= 20 OR r2 <= 5""",
)
def rerank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen rows first, in the order of choice, then the others in theirs."""
    lists = ranked_lists(spark, sf_dir).filter("r1 <= 20 or r2 <= 5")
    key = F.when(F.col("r2") <= 5, F.col("r2")).otherwise(F.lit(1_000_000) + F.col("r1"))
    return lists.select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(key)).cast("long").alias("pos"))


@register(
    "confidence_ranked",
    f"""WITH {_LISTS}, t AS (SELECT p_brand, max(p_size) FILTER (WHERE r1 = 1) AS top, coalesce(max(p_size) FILTER (WHERE r1 = 2), 0) AS second, avg(p_size) AS mean, max(p_size) AS strongest FROM lists WHERE r1 <= 5 GROUP BY p_brand)
SELECT p_brand, round(least(top / 100.0::DOUBLE + greatest(top - second, 0) / 100.0::DOUBLE + mean / 300 + least(greatest(strongest - top, 0) / 400.0::DOUBLE, 0.1), 0.95), 3) AS confidence, top - second AS margin FROM t""",
)
def confidence_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list's confidence from its first, second, mean and strongest scores (sizes stand for tenths)."""
    five = ranked_lists(spark, sf_dir).filter("r1 <= 5")
    at = lambda k: F.max(F.when(F.col("r1") == k, F.col("p_size")))
    t = five.groupBy("p_brand").agg(at(1).alias("top"), F.coalesce(at(2), F.lit(0)).alias("second"), F.avg("p_size").alias("mean"), F.max("p_size").alias("strongest"))
    c = F.col
    zero = F.lit(0)
    score = c("top") / 100.0 + F.greatest(c("top") - c("second"), zero) / 100.0 + c("mean") / 300 + F.least(F.greatest(c("strongest") - c("top"), zero) / 400.0, F.lit(0.1))
    return t.select("p_brand", F.round(F.least(score, F.lit(0.95)), 3).alias("confidence"), (c("top") - c("second")).alias("margin"))


@register(
    "confidence_scores",
    """SELECT p_brand, count(*) AS n, max(p_size) AS best, round(avg(p_size), 3) AS mean, round(least(CASE WHEN count(p_size) > 0 THEN 0.7::DOUBLE * max(p_size) / 50 + 0.3::DOUBLE * avg(p_size) / 50 ELSE 0.45 END, 0.99), 4) AS confidence FROM part GROUP BY p_brand""",
)
def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    score = F.when(F.count(s) > 0, 0.7 * F.max(s) / 50 + 0.3 * F.avg(s) / 50).otherwise(0.45)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.max(s).alias("best"), F.round(F.avg(s), 3).alias("mean"), F.round(F.least(score, F.lit(0.99)), 4).alias("confidence"))


@register(
    "evidence_cut",
    f"WITH {_LISTS} SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY r1) AS pos FROM lists WHERE p_size / 50.0 >= 0.05) t WHERE pos <= 5",
)
def evidence_cut(spark: SparkSession, sf_dir: str, least: float = 0.05, most: int = 5) -> DataFrame:
    lists = ranked_lists(spark, sf_dir).filter(F.col("p_size") / 50.0 >= least)
    return lists.withColumn("pos", F.row_number().over(Window.partitionBy("p_brand").orderBy("r1"))).filter(F.col("pos") <= most).select("p_brand", "p_partkey")


@register(
    "hash_dedup",
    """SELECT sha256(text) AS digest, count(*) AS copies, arg_max(doc_id, (n_chars, -doc_id)) AS kept FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1""",
)
def hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal contents by digest; the best-scored copy stays."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "n_chars", F.sha2("text", 256).alias("digest"))
    kept = F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("kept")
    return d.groupBy("digest").agg(F.count("*").alias("copies"), kept).filter("copies > 1")


@register(
    "hash_sample",
    """SELECT event_id FROM (SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS h FROM events) t WHERE CAST('0x' || substr(h, 1, 15) AS BIGINT) / 1152921504606846975.0::DOUBLE < 0.1""",
)
def hash_sample(spark: SparkSession, sf_dir: str, rate: float = 0.1) -> DataFrame:
    """A stable sample by the digest of the id (its first 60 bits)."""
    h = F.conv(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 15), 16, 10).cast("long")
    return table(spark, sf_dir, "events").filter(h / F.lit(float(2**60 - 1)) < rate).select("event_id")


def shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two result lists for each order: its parts, and those that would also be sent at a low discount."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(
        F.collect_set(F.when(F.col("l_discount") <= 0.07, F.col("l_partkey"))).alias("a"), F.collect_set(F.when(F.col("l_quantity") >= 10, F.col("l_partkey"))).alias("b"),
        F.avg("l_discount").alias("primary_confidence"), F.avg("l_tax").alias("vnext_confidence"), F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("top_a"), F.max_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("top_b"), F.max("l_shipdate").alias("shipped"),
        F.sum("l_quantity").alias("duration_ms"),
    )


_SHADOW = """s AS (SELECT l_orderkey, coalesce(list(DISTINCT l_partkey) FILTER (WHERE l_discount <= 0.07), []) AS a, coalesce(list(DISTINCT l_partkey) FILTER (WHERE l_quantity >= 10), []) AS b,
  avg(l_discount) AS primary_confidence, avg(l_tax) AS vnext_confidence, arg_min(l_partkey, (l_linenumber, l_partkey)) AS top_a, arg_max(l_partkey, (l_linenumber, l_partkey)) AS top_b, max(l_shipdate) AS shipped, sum(l_quantity) AS duration_ms FROM lineitem GROUP BY l_orderkey),
o AS (SELECT *, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS overlap FROM s)"""


@register(
    "shadow_overlap",
    f"""WITH {_SHADOW} SELECT count(*) AS n, round(avg(overlap), 6) AS avg_overlap, count(*) FILTER (WHERE round(vnext_confidence, 9) > round(primary_confidence, 9)) AS vnext_wins,
  round(avg(CASE WHEN top_a = top_b THEN 1.0 ELSE 0.0 END), 6) AS match_rate, round(quantile_cont(duration_ms, 0.95), 4) AS p95_ms FROM o""",
)
def shadow_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = shadow_totals(spark, sf_dir, 0.95)
    return t.select("n", F.round("overlap", 6).alias("avg_overlap"), "vnext_wins", F.round("same", 6).alias("match_rate"), F.round("p95", 4).alias("p95_ms"))


def shadow_totals(spark: SparkSession, sf_dir: str, *percents: float) -> DataFrame:
    """Totals and percentiles of durations in one pass: sums by duration first, so that only different durations meet, in order, in the last step."""
    s = shadow(spark, sf_dir).withColumn("overlap", jaccard(F.col("a"), F.col("b"), 1.0))
    wins = F.count_if(F.round("vnext_confidence", 9) > F.round("primary_confidence", 9))
    by_value = s.groupBy("duration_ms").agg(F.count("*").alias("k"), F.sum("overlap").alias("o"), wins.alias("wins"), F.count_if(F.col("top_a") == F.col("top_b")).alias("same"))
    known = F.when(F.col("duration_ms").isNotNull(), F.col("k")).otherwise(0)
    placed = by_value.withColumn("upto", F.sum(known).over(Window.orderBy("duration_ms"))).withColumn("m", F.sum(known).over(Window.partitionBy()))

    def percentile(p: float):
        at = F.lit(p) * (F.col("m") - 1)
        value = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("duration_ms")))
        low, part = value(F.floor(at)), F.first(at - F.floor(at))
        return low + part * (value(F.ceil(at)) - low)

    n = F.sum("k")
    return placed.agg(F.coalesce(n, F.lit(0)).alias("n"), (F.sum("o") / n).alias("overlap"), F.coalesce(F.sum("wins"), F.lit(0)).alias("vnext_wins"), (F.sum("same") / n).alias("same"), *(percentile(p).alias(f"p{round(100 * p)}") for p in percents))


@register(
    "shadow_daily",
    f"""WITH {_SHADOW} SELECT strftime(date_trunc('day', shipped), '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE top_a = top_b) AS matches, round(avg(overlap) + 1e-9, 6) AS overlap FROM o GROUP BY 1""",
)
def shadow_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shadow(spark, sf_dir).withColumn("overlap", jaccard(F.col("a"), F.col("b"), 1.0))
    day = F.date_format(F.date_trunc("day", "shipped"), "yyyy-MM-dd").alias("day")
    return s.groupBy(day).agg(F.count("*").alias("n"), F.count_if(F.col("top_a") == F.col("top_b")).alias("matches"), F.round(F.avg("overlap") + 1e-9, 6).alias("overlap"))


@register("recent_disagreements", f"WITH {_SHADOW} SELECT l_orderkey, top_a, top_b FROM o WHERE top_a <> top_b ORDER BY shipped DESC, l_orderkey LIMIT 50")
def recent_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shadow(spark, sf_dir).filter("top_a <> top_b").orderBy(F.desc("shipped"), "l_orderkey").limit(50).select("l_orderkey", "top_a", "top_b")


@register(
    "comparison_gate",
    f"""WITH {_SHADOW}, r AS (SELECT count(*) AS n, avg(CASE WHEN top_a = top_b THEN 1.0 ELSE 0.0 END) AS same_rate, avg(overlap) AS overlap, quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.95) AS p95 FROM o)
SELECT n, round(same_rate, 6) AS same_rate, round(overlap, 6) AS overlap, round(p50, 4) AS p50, round(p95, 4) AS p95,
  list_filter([CASE WHEN n = 0 THEN 'no_samples' END, CASE WHEN same_rate < 0.85 THEN 'same_section_rate' END, CASE WHEN overlap < 0.7 THEN 'evidence_overlap' END, CASE WHEN p95 > 150 THEN 'latency' END], lambda x: x IS NOT NULL) AS reasons FROM r""",
)
def comparison_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The promotion gate: what keeps the new list from replacing the old one."""
    r = shadow_totals(spark, sf_dir, 0.5, 0.95).withColumnRenamed("overlap", "o")
    c = F.col
    reasons = F.array_compact(F.array(F.when(c("n") == 0, "no_samples"), F.when(c("same") < 0.85, "same_section_rate"), F.when(c("o") < 0.7, "evidence_overlap"), F.when(c("p95") > 150, "latency")))
    return r.select("n", F.round("same", 6).alias("same_rate"), F.round("o", 6).alias("overlap"), F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), reasons.alias("reasons"))
