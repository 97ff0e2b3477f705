"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import _shared


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (a long, b long): root is the least node that it reaches.

    Alternates two steps until neither changes an edge: every node hands its neighbours
    above it to the least of its neighbourhood (large star), then its neighbours below it
    (small star). A node's neighbours are only ever grouped to a minimum, never gathered.
    Each round's edges are written to the shared folder, so lineage stays short and a lost
    executor costs one round. Rounds grow with the logarithm of the longest path. What is
    returned reads the last round's table, its attribute edges, to be dropped after it.
    """
    now = _shared.written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        # each minimum is written before it is joined: the join then has two plain shuffles, and Spark splits the rows of a hub
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _shared.written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = _shared.written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), name)
        low = _shared.written(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        old, now = now, _shared.written(small.where("a != b").distinct(), name)
        _shared.drop(old, least, large, low)
        stats = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(stats) == mark:
            break
        mark = tuple(stats)
    roots = now.select("b").distinct()
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
    out.edges = now
    return out
