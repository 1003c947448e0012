"""The projection to the target schema over a stream: stateless, row by row, the same expressions as the batch union."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.operators.union import ORDINALS, SourceTable, UnionError, _matches, _project
from mergeloom.plans.contracts import Mapping, TargetSchema


def project_stream(stream: DataFrame, file: str, mapping: Mapping, schema: TargetSchema) -> DataFrame:
    """A stream of raw cells as target columns with their origin; there are no ordinals, for a stream has no order."""
    matches = _matches(mapping, file)
    lost = {m.column for m in matches.values() if m.column is not None} - set(stream.columns)
    if lost:
        raise UnionError(f"{file} has no column {', '.join(sorted(lost))}")
    return _project(SourceTable(file, file, stream.withColumn("_row_idx", F.lit(0).cast("long"))), matches, schema, 0).drop(*ORDINALS)
