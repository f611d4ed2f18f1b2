"""Connected components of a distributed edge list, by hash-to-min with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import discard, stored


def components(edges: DataFrame, label: str = "components", most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of each node of ``edges`` (columns a, b).

    Alternates the large-star and small-star steps: in each, a node links its larger
    (or smaller) neighbours to the smallest one.  The edge count never grows, no
    neighbourhood is gathered in one place (only its minimum is), and each round is
    written to shared storage.  It ends when a round changes no edge.
    """
    now = stored(_ordered(edges), label)
    before = None
    for _ in range(most_rounds):
        step = _small_star(_large_star(now))
        now = stored(step, label)
        discard(step)  # the round before, and its least neighbours
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger node a to its smaller node b."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    # written, so that the join below is one of plain tables, which Spark splits at a hub's many edges
    least = stored(least.select(F.col("a").alias("node"), F.least("a", "m").alias("m")), "least")
    up = edges.join(least, edges["b"] == least["node"]).select(F.col("a"), F.col("m").alias("b"))
    return up.filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of a node, and itself, to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    least = stored(least.select(F.col("a").alias("node"), "m"), "least")
    down = edges.join(least, edges["a"] == least["node"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(down.unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))))
