"""Connected components of a link table, and checkpoints in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revpulse.sources.warehouse import use_shared_checkpoints


PART = 100_000  # links


def cut(df: DataFrame) -> DataFrame:
    """Written once to the folder of ``spark.checkpoint.dir``; later steps read it back."""
    use_shared_checkpoints(df.sparkSession)
    return df.checkpoint()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component = smallest node reachable) for every node of ``links`` (a, b).

    Large-star and small-star steps in turn: each points neighbours at the smallest one known.
    A step is an aggregate with map-side minimum and an equi-join, so a node with very many
    links is neither gathered nor paired with itself; adaptive execution splits it.  Rounds grow
    with the logarithm of the longest path.  Between steps the links are kept in one partition per ``PART`` of them, so
    few links do not become very many tiny shuffle files.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before, parts = now, now["n"] // PART + 1
        edges = edges.coalesce(parts)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(2 * parts)
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = cut(
            large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b"))).coalesce(2 * parts).distinct().coalesce(parts)
        )
    # Every edge is now (node, root).
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
