"""Row numbers over large tables: no task holds all rows, nor those of a large group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.runtime import written


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with ``name``, 0 and up in the order of the columns ``order``, which tell all rows apart.

    Ranges of the order are numbered each by itself; their sizes, a row for each
    range, give where each begins.
    """
    ranged = written(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    begins = ranged.groupBy("_range").agg(F.count("*").alias("_size")).select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_begin"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(begins), "_range").withColumn(name, F.col("_begin") + F.col("_place")).drop("_range", "_place", "_begin")


def number_in_groups(df: DataFrame, keys: Sequence[str], bucket: Sequence[Column], order: Sequence[str], name: str) -> DataFrame:
    """df with ``name``, 1 and up in the order of ``order`` within groups of equal ``keys``; NULL keys are equal.

    ``bucket`` splits every group into runs of its order.  A run is numbered by
    itself, and sizes of the runs before it are added, so a group is never in one
    task.
    """
    parts = [f"_bucket{i}" for i in range(len(bucket))]
    cut = df.withColumns(dict(zip(parts, bucket)))
    quoted = [F.col(f"`{k}`") for k in keys]
    sizes = cut.groupBy(*quoted, *parts).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*quoted).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(*[k.alias(f"_k{i}") for i, k in enumerate(quoted)], *[F.col(p).alias(f"_b{p}") for p in parts], F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_begin"))
    placed = cut.withColumn("_place", F.row_number().over(Window.partitionBy(*quoted, *parts).orderBy(*order)))
    same = reduce(lambda a, b: a & b, [k.eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(quoted)] + [F.col(p).eqNullSafe(F.col(f"_b{p}")) for p in parts])
    out = placed.join(begins, same).withColumn(name, F.col("_begin") + F.col("_place"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], name)
