"""Connected components of a table of links, by large-star and small-star rounds.

Defined results: links with a null end and links of a node with itself are left out; repeated links
count once; without links there is no row.  Nodes may be of any type that has an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorweave.llm._shared import BROADCAST_BYTES, Tables, row_bytes


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"), F.sum(row_bytes(edges)).alias("bytes")).first()
    return row["n"], row["s"], row["bytes"] or 0


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, tables: Tables | None = None) -> DataFrame:
    """(node, component) of every node that has a link; a component is named by its smallest node.

    Each round joins edges with the smallest neighbour of a node, which is aggregated before the
    shuffle; edges of a node with very many neighbours are split by the skew join.  Edges stay in the
    shared folder between rounds, among the caller's ``tables`` if given, and never come to the driver.
    A round over edges small enough to be broadcast needs no shuffle; the rows are the same either way.
    """
    tables = tables or Tables(links.sparkSession, "components")
    edges = tables.add(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        few = state[2] <= BROADCAST_BYTES  # summed; nodes have no more bytes than edges
        hint, edges = (F.broadcast, edges.coalesce(1)) if few else ((lambda df: df), edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.join(hint(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(hint(least), "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = tables.add(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if before == state:
            break
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    found = edges.groupBy("u").agg(F.min("v").alias("component"))
    return found.select(F.col("u").alias("node"), "component").unionByName(found.select(F.col("component").alias("node"), "component").distinct())
