"""Connected components by alternating large-star and small-star steps.

Edges stay distributed; each step is one aggregation (with partial sums, so a
hub is reduced before it is shuffled) and one join. What was aggregated is
written before it is joined, so that adaptive execution can split a hub's edges.
The rounds needed grow with the logarithm of the number of nodes. After each
round the edges are written to the shared folder, which cuts lineage, and those
of the round before are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import discard, materialise


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least", fewer_files=True)
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least", fewer_files=True)
    joined = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root of every node of ``links`` (two columns of ids) but the roots, each its component's least id."""
    a, b = links.columns
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = materialise(edges, "edges", fewer_files=True), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        if now[0]:
            old = edges
            stars = materialise(_large(edges), "stars", fewer_files=True)
            edges = materialise(_small(stars), "edges", fewer_files=True)
            discard(old)
            discard(stars)
