"""Connected components of a graph of links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import shared

MOST_ROUNDS = 60


def connected_components(links: DataFrame, a: str = "a", b: str = "b", tables: shared.Tables | None = None) -> DataFrame:
    """(node, component): for every node of a link, the smallest node that it reaches.

    Alternates two steps until nothing changes. The large star ties all greater neighbours of a node to its
    smallest neighbour, the small star the node's lesser neighbours and itself. Both keep what is connected, and
    the number of rounds grows with the logarithm of the graph. Each round's links are a stored table. The node in a
    star's middle gets its smallest neighbour by a broadcast, so no task holds all its links. The table that the result
    reads belongs to ``tables``, if given.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    edges, last = shared.materialize_at(edges, "links")
    mark, count = None, edges.count()
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("members"))
        least = least.select("u", F.least("u", "m").alias("m"), "members")
        large = shared.with_key_row(both, least, ["u"], 2 * count).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges, at = shared.materialize_at(small, "links")
        count, total = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        shared.remove(spark, last)
        last = at
        if mark == (count, total):
            break
        mark = count, total
    else:
        raise RuntimeError(f"components are not stable after {MOST_ROUNDS} rounds")
    if tables:
        tables.made.append((spark, last))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
