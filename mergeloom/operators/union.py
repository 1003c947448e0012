"""Mapped vertical union: many tables, one schema, every value with its origin.

The merged table is one DataFrame: the target columns, _source_file, for each
target its source column (_p_<target>) and whether its cell did not fit
(_bad_<target>), and the ordinals that keep the order of files, sheets and rows.
Rows are never dropped; sorting is left to the sinks.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from pathlib import PurePath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.functions.coerce import LOGICAL_TYPES, coerce_columns
from mergeloom.plans.contracts import Mapping, SourceMatch, TargetSchema

ORDINALS = ["_file_idx", "_sheet_idx", "_row_idx"]


class UnionError(ValueError):
    """A plan that does not fit its schema or its sources."""


@dataclass
class SourceTable:
    """One table of a file.  df has the source's columns and, perhaps, _row_idx."""

    file: str
    label: str
    df: DataFrame
    sheet: int = 0

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != "_row_idx"]


@dataclass
class Merged:
    df: DataFrame
    schema: TargetSchema
    skipped: list[str] = field(default_factory=list)

    def failures(self) -> DataFrame:
        """One row: cells of each target that did not fit."""
        return self.df.agg(*[F.coalesce(F.sum(F.col(f"_bad_{t}").cast("long")), F.lit(0)).alias(t) for t in self.schema.names])

    def null_cells(self) -> DataFrame:
        """One row: NULL cells over all target columns."""
        nulls = [F.col(t).isNull().cast("long") for t in self.schema.names]
        return self.df.agg(F.coalesce(F.sum(reduce(lambda a, b: a + b, nulls)), F.lit(0)).alias("total_null_cells"))


def same_file(a: str, b: str) -> bool:
    return a == b or PurePath(a).name == PurePath(b).name


def _matches(mapping: Mapping, file: str) -> dict[str, SourceMatch]:
    """Target -> its match in a file.  Status is no concern here: the review guard stands before."""
    out: dict[str, SourceMatch] = {}
    for entry in mapping.entries:
        found = [s for s in entry.sources if same_file(s.file, file)]
        if len(found) > 1:
            raise UnionError(f"{entry.target}: {len(found)} matches for {file}")
        if found:
            out[entry.target] = found[0]
    return out


def check_agreement(mapping: Mapping, schema: TargetSchema) -> None:
    planned, wanted = {e.target for e in mapping.entries}, set(schema.names)
    if planned != wanted:
        raise UnionError(f"plan and schema differ; missing: {sorted(wanted - planned)}, unknown: {sorted(planned - wanted)}")


def check_unique_names(files: list[str]) -> None:
    names = [PurePath(f).name for f in files]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise UnionError(f"file names must be unique: {', '.join(twice)}")


def unify(tables: list[SourceTable], mapping: Mapping, schema: TargetSchema) -> Merged:
    """The union of all tables, projected to the schema by the plan.

    A table that has none of its file's mapped columns is skipped, if there are
    any; a mapped column that no table of its file has is an error, one that
    only this table lacks is NULL there, but still named as the origin.
    """
    check_agreement(mapping, schema)
    files = list(dict.fromkeys(t.file for t in tables))
    check_unique_names(files)
    parts, skipped = [], []
    for file in files:
        matches = _matches(mapping, file)
        mapped = {m.column for m in matches.values() if m.column is not None}
        own = [t for t in tables if t.file == file]
        lost = mapped - {c for t in own for c in t.columns}
        if lost:
            raise UnionError(f"{file} has no column {', '.join(sorted(lost))}")
        for table in own:
            if mapped and not mapped & set(table.columns):
                skipped.append(table.label)
                continue
            parts.append(_project(table, matches, schema, files.index(file)))
    if not parts:
        raise UnionError("there is no table to merge")
    return Merged(reduce(DataFrame.unionByName, parts), schema, skipped)


def _project(table: SourceTable, matches: dict[str, SourceMatch], schema: TargetSchema, file_idx: int) -> DataFrame:
    kinds = {f.name: f.dataType for f in table.df.schema.fields}
    row = F.col("_row_idx") if "_row_idx" in kinds else F.monotonically_increasing_id()
    ordinals = [F.lit(file_idx).alias("_file_idx"), F.lit(table.sheet).alias("_sheet_idx"), row.cast("long").alias("_row_idx")]
    columns = {c.name: (matches[c.name].column if c.name in matches else None) for c in schema.columns}
    # Source columns by number, as a target may have the name of another target's source.
    used = {name: f"__{i}" for i, name in enumerate(dict.fromkeys(k for k in columns.values() if k in kinds))}
    raw = table.df.select(*[F.col(f"`{k}`").alias(n) for k, n in used.items()], *ordinals)
    cells = {c.name: (F.col(used[columns[c.name]]), c.type, kinds[columns[c.name]]) for c in schema.columns if columns[c.name] in kinds}
    typed = coerce_columns(raw, cells)
    values = [(F.col(f"`{c.name}`") if c.name in cells else F.lit(None).cast(LOGICAL_TYPES[c.type])).alias(c.name) for c in schema.columns]
    origins = [F.lit(columns[c.name]).cast("string").alias(f"_p_{c.name}") for c in schema.columns]
    bads = [(F.col(f"`_bad_{c.name}`") if c.name in cells else F.lit(False)).alias(f"_bad_{c.name}") for c in schema.columns]
    return typed.select(*values, F.lit(table.label).alias("_source_file"), *origins, *bads, *ORDINALS)


def combined(df: DataFrame, schema: TargetSchema, provenance: bool = True) -> DataFrame:
    """The table as it is written: targets, origins, then what dedup added."""
    columns = [F.col(f"`{t}`") for t in schema.names]
    if provenance:
        columns += [F.col("_source_file"), *[F.col(f"`_p_{t}`").alias(f"{t}_source_column") for t in schema.names]]
    columns += [F.col(f"`{c}`") for c in df.columns if c in ("_entity_cluster_id", "_merged_row_count") or c.endswith("_original_value")]
    return df.select(*columns)
