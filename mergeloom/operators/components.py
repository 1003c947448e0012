"""Connected components by alternating star contractions.

Each round is two aggregates and two equi-joins over the edges; a node's
neighbours are never gathered in one task.  Joins on a hot node are plain
shuffled joins, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.runtime import new_path, remove, trim_driver


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges (u > v): large links greater neighbours, small links lesser ones, to the least."""
    directed = edges
    if large:
        directed = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = directed.where("v > u") if large else directed
    out = moved.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, component) for every node that has an edge to another; component is its least node.

    edges: two columns of one orderable type, undirected; repeats, loops and
    nulls are ignored.  An empty table gives an empty result.  Rounds go on until
    one changes nothing, which takes about the logarithm of the nodes; each
    round's table is removed once the next one is there.
    """
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    held: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        held.append(new_path(spark, "edges"))
        df.write.parquet(held[-1])
        for path in held[:-1]:
            remove(spark, path)
        del held[:-1]
        trim_driver(spark)
        return spark.read.schema(df.schema).parquet(held[-1])

    current = kept(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen, rounds = None, 0
    while True:
        current = kept(_stars(_stars(current, large=True), large=False))
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.union(current.select(F.col("v"), F.col("v")).distinct())
        seen, rounds = mark, rounds + 1
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
