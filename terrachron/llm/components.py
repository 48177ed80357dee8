"""Connected components of a distributed list of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrachron.llm.common import drop_stored, stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u long, v long) links, in any order and repeated -> (u, v): every node but the smallest of its component, and that.

    Nodes that no link names are not in the result. Every round is written to the shared folder; the number of rounds
    grows with the logarithm of the number of nodes. Nodes of very many links are split by the adaptive skew join.
    """
    edges = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        after = stored(_small(_large(edges)), "edges")
        now = _state(after)
        drop_stored(edges)
        edges = after
        if now == state:
            break
        state = now
    return edges
