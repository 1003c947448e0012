"""Canonical rewrite and the collapse of the duplicates that it makes.

Rows whose value is a member of an approved cluster get its canonical value.
Rows of a cluster that are then equal in all target columns fold together, but
never two with the same original spelling: these were repeats before.  The k-th
row of each spelling folds into the k-th survivor, so an occurrence number makes
the order-dependent rule a plain group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.operators.numbering import number_in_groups
from mergeloom.operators.union import ORDINALS, Merged
from mergeloom.plans.contracts import Clusters, TargetSchema

#: Approved clusters come from a file that people edit; a map beyond this is joined, not broadcast.
BROADCAST_ROWS = 200_000


class DedupError(ValueError):
    """Clusters that do not fit the merged table."""


@dataclass
class Deduplicated:
    df: DataFrame
    schema: TargetSchema
    column: str

    def summary(self) -> DataFrame:
        """One row: merged_cluster_count, duplicate_row_count, canonicalized_count."""
        return self.df.agg(
            F.count_distinct("_entity_cluster_id").alias("merged_cluster_count"),
            F.coalesce(F.sum(F.col("_merged_row_count") - 1), F.lit(0)).alias("duplicate_row_count"),
            F.coalesce(F.sum("_changed"), F.lit(0)).alias("canonicalized_count"),
        )


def canonical_map(like: DataFrame, clusters: Clusters) -> DataFrame:
    rows = clusters.canonical_rows()
    out = like.sparkSession.createDataFrame(rows, "_member string, _canonical string, _cluster string")
    return F.broadcast(out) if len(rows) <= BROADCAST_ROWS else out


def rewrite(df: DataFrame, column: str, members: DataFrame) -> DataFrame:
    """df with column canonical, and <column>_original_value and _entity_cluster_id added, NULL outside clusters."""
    joined = df.join(members, F.col(f"`{column}`") == F.col("_member"), "left")
    return joined.withColumns({
        f"{column}_original_value": F.when(F.col("_member").isNotNull(), F.col(f"`{column}`")),
        "_entity_cluster_id": F.col("_cluster"),
        column: F.coalesce("_canonical", F.col(f"`{column}`")),
    }).drop("_member", "_canonical", "_cluster")


def _in_order(value: str, order: Column) -> Column:
    """The distinct values of a group in row order, joined; NULL if there are none."""
    pairs = F.array_sort(F.collect_list(F.when(F.col(f"`{value}`").isNotNull(), F.struct(order.alias("o"), F.col(f"`{value}`").alias("v")))))
    return F.nullif(F.array_join(F.array_distinct(F.transform(pairs, lambda x: x["v"])), "; "), F.lit(""))


def deduplicate(merged: Merged, clusters: Clusters, column: str | None = None) -> Deduplicated:
    schema = merged.schema
    targets = {c.target_column for c in clusters.clusters}
    column = column or next(iter(targets), None)
    if column is None:
        raise DedupError("there is no cluster and no column")
    if targets - {column}:
        raise DedupError(f"clusters are of {', '.join(sorted(targets))}, not of {column}")
    kind = {c.name: c.type for c in schema.columns}.get(column)
    if kind != "string":
        raise DedupError(f"{column} is {'no target column' if kind is None else 'not a string column'}")
    original = f"{column}_original_value"
    rewritten = rewrite(merged.df, column, canonical_map(merged.df, clusters))
    order = F.struct(*ORDINALS)
    carried = ["_source_file", *[f"_p_{t}" for t in schema.names]]
    bads = [f"_bad_{t}" for t in schema.names]
    # What no cluster touches passes without a shuffle.
    outside = rewritten.where(F.col("_entity_cluster_id").isNull()).withColumns(
        {"_merged_row_count": F.lit(1).cast("long"), "_changed": F.lit(0).cast("long")}
    )
    key = ["_entity_cluster_id", *schema.names]
    # Runs of 65,536 rows of a source, so that a row repeated throughout a source is not numbered by one task.
    runs = [F.col("_file_idx"), F.col("_sheet_idx"), F.shiftright("_row_idx", 16)]
    inside = number_in_groups(rewritten.where(F.col("_entity_cluster_id").isNotNull()), [*key, original], runs, ORDINALS, "_occurrence")
    folded = inside.groupBy(*[F.col(f"`{k}`") for k in key], "_occurrence").agg(
        F.min(order).alias("_first"), F.count("*").alias("_merged_row_count"),
        *[_in_order(c, order).alias(c) for c in (*carried, original)],
        *[F.min_by(F.col(f"`{b}`"), order).alias(b) for b in bads],
        F.sum((F.col(f"`{column}`") != F.col(f"`{original}`")).cast("long")).alias("_changed"),
    )
    folded = folded.select("*", "_first.*").drop("_first", "_occurrence")
    return Deduplicated(outside.unionByName(folded), schema, column)
