"""Connected components of links between rows, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so neither links nor components ever meet in one task or the
driver, and a vertex with very many links is pre-aggregated and its join partition split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestrata.llm.common import dropped, written


def _low(edges: DataFrame) -> DataFrame:
    """u, m: each vertex with a lesser neighbour, and the least of them."""
    return edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step. edges: a > b."""
    # large: every greater neighbour hangs on the least vertex around, which is the vertex itself where it has no lesser neighbour
    low = _low(edges)
    large = edges.join(low, edges.b == low.u, "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
    # small: every vertex and its lesser neighbours hang on the least of them
    low = _low(large)
    moved = large.join(low, large.a == low.u).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return moved.filter("a > b").distinct()


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and how many they are with a sum of their hashes, both taken while they are written."""
    seen = Observation()
    table = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hashes")))
    return table, (seen.get["n"], seen.get["hashes"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, component: for each value in columns a and b of links, the least value reachable from it.

    Links may be given in either direction or repeatedly; nulls and loops are ignored. No link, no row.
    """
    edges, before = _marked(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        if not before[0]:
            break
        after, mark = _marked(_stars(edges))
        dropped(edges)
        edges = after
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
