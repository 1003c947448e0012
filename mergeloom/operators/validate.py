"""Checks of a merged table: one wide aggregate, one by source, one for outliers."""

from __future__ import annotations

import copy
import datetime
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.functions.coerce import LOGICAL_TYPES, bare, whole
from mergeloom.operators.union import ORDINALS, Merged
from mergeloom.plans.contracts import Mapping, SourceMatch
from mergeloom.runtime import written

# Decimals written the Turkish and the English way.
TR_DECIMAL = r"[+-]?(?:\d{1,3}(?:\.\d{3})*|\d+),\d+"
EN_DECIMAL = r"[+-]?(?:\d{1,3}(?:,\d{3})*|\d+)\.\d+"


@dataclass(frozen=True)
class Settings:
    null_ratio: float = 0.5
    error_ratio: float = 0.2
    iqr_factor: float = 3.0
    min_outlier_rows: int = 8
    min_year: int = 1900
    max_year: int | None = None

    def __post_init__(self) -> None:
        if not (0 <= self.null_ratio <= 1 and 0 <= self.error_ratio <= 1 and self.iqr_factor > 0 and self.min_outlier_rows >= 4):
            raise ValueError("ratios must be from 0 to 1, iqr_factor positive, min_outlier_rows at least 4")

    def last_year(self) -> int:
        return self.max_year if self.max_year is not None else datetime.date.today().year + 1


@dataclass
class Finding:
    check: str
    severity: str
    target: str
    message: str
    file: str | None = None
    column: str | None = None
    metric: float | None = None
    count: int | None = None
    samples: list = field(default_factory=list)

    def __str__(self) -> str:
        origin = f" ← {self.file}:{self.column}" if self.file else ""
        return f"[{self.check}] {self.target}{origin}: {self.message}"


@dataclass
class Report:
    findings: list[Finding]

    @property
    def errors(self) -> list[Finding]:
        return [f for f in self.findings if f.severity == "error"]

    @property
    def warnings(self) -> list[Finding]:
        return [f for f in self.findings if f.severity == "warning"]

    @property
    def blocking(self) -> bool:
        return bool(self.errors)

    def for_column(self, target: str) -> list[Finding]:
        return [f for f in self.findings if f.target == target]

    def verdict(self, target: str) -> str:
        found = self.for_column(target)
        n = [(sum(f.severity == s for f in found), s) for s in ("error", "warning")]
        return ", ".join(f"{k} {s}{'s' * (k > 1)}" for k, s in n if k) or "ok"


def nulls_by_source(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(target, _source_file, source_column, rows, nulls) of mapped rows; rows that dedup folded from several sources are left out."""
    cells = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"`_p_{t}`").alias("source_column"), F.col(f"`{t}`").isNull().alias("gone")) for t in targets])
    rows = df.where(~F.contains(F.col("_source_file"), F.lit("; "))).select("_source_file", F.inline(cells))
    rows = rows.where(F.col("source_column").isNotNull() & ~F.contains("source_column", F.lit("; ")))
    return rows.groupBy("target", "_source_file", "source_column").agg(F.count("*").alias("rows"), F.sum(F.col("gone").cast("long")).alias("nulls"))


def null_by_source(df: DataFrame, target: str) -> DataFrame:
    return nulls_by_source(df, [target]).drop("target")


def quartiles(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(target, rows, q1, q3) of the values of each target, interpolated between ranks.

    Values are counted, the counts range-partitioned by value, and a quartile's
    two ranks looked up in the range where they fall; so no task holds a column,
    and a value that is in many rows is one row.
    """
    cells = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"`{t}`").cast("double").alias("v")) for t in targets])
    counted = df.select(F.inline(cells)).where(F.col("v").isNotNull()).groupBy("target", "v").agg(F.count("*").alias("n"))
    ranged = written(counted.repartitionByRange("target", "v").withColumn("part", F.spark_partition_id()), "values")
    sizes = ranged.groupBy("target", "part").agg(F.sum("n").alias("size"))  # a row for each range
    upto = Window.partitionBy("target").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("target", "part", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("begin"), F.sum("size").over(Window.partitionBy("target")).alias("rows"))
    within = Window.partitionBy("target", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(begins), ["target", "part"])
    first = F.col("begin") + F.col("before")
    place = {q: (F.col("rows") - 1) * F.lit(q) for q in (0.25, 0.75)}

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= first) & (rank < first + F.col("n")), F.col("v")))

    def quartile(q: float, name: str) -> list[Column]:
        low = F.floor(place[q])
        return [at(low).alias(f"{name}_low"), at(F.least(low + 1, F.col("rows") - 1)).alias(f"{name}_high"), F.max(place[q] - low).alias(f"{name}_part")]

    found = placed.groupBy("target").agg(F.max("rows").alias("rows"), *quartile(0.25, "q1"), *quartile(0.75, "q3"))
    between = lambda n: F.col(f"{n}_low") * (1 - F.col(f"{n}_part")) + F.col(f"{n}_high") * F.col(f"{n}_part")
    return found.select("target", "rows", between("q1").alias("q1"), between("q3").alias("q3"))


@dataclass(frozen=True)
class Fences:
    rows: int
    q1: float
    q3: float
    low: float
    high: float


def fences(df: DataFrame, targets: Sequence[str], s: Settings) -> dict[str, Fences]:
    """Of each target that has enough values, and quartiles apart: what lies beyond is an outlier."""
    if not targets:
        return {}
    out = {}
    for r in quartiles(df, targets).collect():  # a row for each target
        spread = r["q3"] - r["q1"]
        out[r["target"]] = Fences(r["rows"], r["q1"], r["q3"], r["q1"] - s.iqr_factor * spread, r["q3"] + s.iqr_factor * spread)
    return out


def _outside(target: str, f: Fences, s: Settings) -> Column:
    v = F.col(f"`{target}`").cast("double")
    return F.lit(f.rows >= s.min_outlier_rows and f.q3 > f.q1) & ((v < f.low) | (v > f.high))


def numeric_outliers(df: DataFrame, target: str, s: Settings | None = None) -> DataFrame:
    """One row: rows, q1, q3, low and high fence, outliers and the largest of them in size."""
    s = s or Settings()
    f = fences(df, [target], s).get(target)
    known = [F.lit(x).cast(k).alias(n) for n, k, x in zip(
        ("rows", "q1", "q3", "low", "high"), ("long", *["double"] * 4), (f.rows, f.q1, f.q3, f.low, f.high) if f else (0, None, None, None, None))]
    out = _outside(target, f, s) if f else F.lit(False)
    v = F.col(f"`{target}`").cast("double")
    return df.agg(*known, F.coalesce(F.sum(out.cast("long")), F.lit(0)).alias("outliers"), F.max(F.when(out, F.abs(v))).alias("largest"))


_PLACE = "struct<a: double, b: double, c: double>"
#: Outliers that a finding shows: all of up to so many, else the first ones and the last.
SHOWN = 3


def shown(first: Sequence, last, count: int) -> list:
    return list(first[:count]) if count <= SHOWN else [*first[: SHOWN - 1], last]


def _outlier_samples(df: DataFrame, odd: dict[str, tuple[Column, Column, bool]]) -> dict[str, tuple[int, list[str], str, float | None]]:
    """Of each target its outliers: how many, the first ones, the last and the largest in size; odd: condition, order and whether it is a number, of each."""
    if not odd:
        return {}
    cells = F.array(*[
        F.struct(F.lit(t).alias("target"), out.alias("out"), order.alias("order"), F.col(f"`{t}`").cast("string").alias("text"),
                 F.abs(F.col(f"`{t}`").try_cast("double")).alias("size") if number else F.lit(None).cast("double").alias("size"))
        for t, (out, order, number) in odd.items()])
    found = df.select(F.inline(cells)).where("out")
    last = found.groupBy("target").agg(F.count("*").alias("n"), F.max_by("text", "order").alias("last"), F.max("size").alias("largest"))
    # Each task keeps its own first ones before any are dealt out.
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("order"))).where(F.col("rank") <= SHOWN)
    first = ranked.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("first"))
    return {r["target"]: (r["n"], [x["text"] for x in r["first"]], r["last"], r["largest"]) for r in last.join(first, "target").collect()}


def date_outlier(target: str, s: Settings) -> Column:
    year = F.year(F.col(f"`{target}`"))
    return (year < s.min_year) | (year > s.last_year())


def _usable(mapping: Mapping, target: str) -> list[SourceMatch]:
    return [m for e in mapping.entries if e.target == target for m in e.sources if m.column is not None and m.status != "unmatched"]


def validate(merged: Merged, mapping: Mapping, settings: Settings | None = None, df: DataFrame | None = None) -> Report:
    """Findings in schema order; for each target type, nulls, outliers, then required.

    df: the table after dedup, if there was one; conversion failures are those of
    the union before it.
    """
    s, df = settings or Settings(), merged.df if df is None else df
    columns = merged.schema.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    wide = []
    for c in columns:
        v = F.col(f"`{c.name}`")
        parts = [F.count(F.col(f"`_p_{c.name}`")).alias("mapped"), F.sum(v.isNull().cast("long")).alias("nulls")]
        if c.type == "string" and kinds[c.name] == LOGICAL_TYPES["string"]:
            for name, pattern in (("tr", TR_DECIMAL), ("en", EN_DECIMAL)):
                is_it = bare(v).rlike(whole(pattern))
                parts += [F.sum(is_it.cast("long")).alias(name), F.min_by(v, F.when(is_it, F.struct(*ORDINALS))).alias(f"{name}_sample")]
        wide.append(F.struct(*parts).alias(c.name))
    totals = df.agg(F.count("*").alias("__rows"), *wide).first().asDict(recursive=True)
    failures = merged.failures().first().asDict()
    by_source: dict[str, list] = {}
    for r in sorted(nulls_by_source(df, [c.name for c in columns]).collect()):  # a row for each target and source table
        by_source.setdefault(r["target"], []).append(r)
    numbers = [c.name for c in columns if c.type in ("integer", "decimal") and totals["__rows"] - (totals[c.name]["nulls"] or 0) >= s.min_outlier_rows]
    beyond = fences(df, numbers, s)
    place = F.struct(*[F.col(o).cast("double") for o in ORDINALS])
    by_value = lambda t: F.struct(F.col(f"`{t}`").cast("double"), *[F.lit(0.0)] * (len(ORDINALS) - 1))
    odd = {t: (_outside(t, f, s), by_value(t).cast(_PLACE), True) for t, f in beyond.items()}
    odd |= {c.name: (F.coalesce(date_outlier(c.name, s), F.lit(False)), place.cast(_PLACE), False) for c in columns if c.type == "date" and kinds[c.name] == LOGICAL_TYPES["date"]}
    outliers = _outlier_samples(df, odd)
    found: list[Finding] = []
    for c in columns:
        t, name, usable = totals[c.name], c.name, _usable(mapping, c.name)
        single = usable[0] if len(usable) == 1 else None
        blame = {"file": single.file, "column": single.column} if single else {}
        if kinds[name] != LOGICAL_TYPES[c.type]:
            found.append(Finding("type", "error", name, f"is {kinds[name].simpleString()}, not {c.type}"))
        bad = failures[name]
        if bad:
            ratio = bad / t["mapped"] if t["mapped"] else 1.0
            severity = "error" if ratio >= s.error_ratio else "warning"
            found.append(Finding("type", severity, name, f"{bad} cells are no {c.type}", metric=ratio, count=bad, **blame))
        if c.type == "string" and t["tr"] and t["en"]:
            samples = [t["tr_sample"], t["en_sample"]]
            found.append(Finding("type", "warning", name, "decimals in two notations", count=t["tr"] + t["en"], samples=samples, **blame))
        if t["mapped"] and t["nulls"]:
            for r in by_source.get(name, []):
                if r["nulls"] == r["rows"]:
                    found.append(Finding("null", "error", name, "is empty throughout", r["_source_file"], r["source_column"], 1.0, r["nulls"]))
                elif r["nulls"] / r["rows"] > s.null_ratio:
                    ratio = r["nulls"] / r["rows"]
                    found.append(Finding("null", "warning", name, f"{ratio:.0%} of the cells are empty", r["_source_file"], r["source_column"], ratio, r["nulls"]))
        if name in outliers:
            n, first, last, largest = outliers[name]
            samples = shown(first, last, n)
            if name in beyond:
                fence = beyond[name]
                found.append(Finding("outlier", "warning", name, f"{n} values lie beyond {fence.low:g} and {fence.high:g}", metric=largest, count=n, samples=[f"{float(x):g}" for x in samples], **blame))
            else:
                found.append(Finding("outlier", "warning", name, f"{n} dates lie outside {s.min_year} to {s.last_year()}", count=n, samples=samples, **blame))
        if c.required and not usable:
            found.append(Finding("required", "error", name, "is required and has no source"))
        elif c.required and t["nulls"]:
            found.append(Finding("required", "error", name, f"is required and empty in {t['nulls']} rows", count=t["nulls"], **blame))
    return Report(found)


def downgrade(mapping: Mapping, report: Report) -> Mapping:
    """The plan with the auto lines that errors blame set to review; the same object if there are none."""
    blamed = {(f.target, f.file.split("#")[0], f.column): f for f in reversed(report.errors) if f.file}
    if not blamed:
        return mapping
    out = copy.deepcopy(mapping)
    for e in out.entries:
        for m in e.sources:
            f = blamed.get((e.target, m.file, m.column)) or blamed.get((e.target, m.file.replace("\\", "/").rsplit("/", 1)[-1], m.column))
            if f and m.status == "auto":
                m.status = "review"
                m.reason = " | ".join(x for x in (m.reason, f"validator: {f.message}") if x)
    return out
