"""Column profiles: one aggregate over the cells of a table, whatever its number of columns."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergeloom.functions.coerce import DIGITS, SIGN, bare, grouped, marked, plain_number, to_date, whole
from mergeloom.operators.union import SourceTable
from mergeloom.sources.tables import read_tables

# Cells that profiles take for missing.
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)
# Words that make a column boolean; 1 and 0 do not.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "evet", "hayir", "hayır")

# The labels of formats.
DATE_PATTERNS = {
    "iso_date": r"\d{4}-\d{1,2}-\d{1,2}(?:[T ].*)?",
    "tr_date_dd.mm.yyyy": r"\d{1,2}\.\d{1,2}\.\d{4}",
    "date_dd/mm/yyyy": r"\d{1,2}/\d{1,2}/\d{4}",
}
NUMBER_PATTERNS = {
    "integer": SIGN + DIGITS,
    "tr_decimal_grouped": grouped(".", ","),
    "tr_decimal": marked(","),
    "en_decimal": marked("."),
}

PROFILE = T.StructType([
    T.StructField("table", T.StringType()), T.StructField("name", T.StringType()), T.StructField("inferred_type", T.StringType()),
    T.StructField("samples", T.ArrayType(T.StringType())), T.StructField("unique_count", T.LongType()),
    T.StructField("null_ratio", T.DoubleType()), T.StructField("min", T.StringType()), T.StructField("max", T.StringType()),
    T.StructField("format_pattern", T.StringType()),
])


def _label(text: Column, patterns: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(patterns.items()):
        out = F.when(text.rlike(whole(pattern)), name).otherwise(out)
    return out


def _moment(text: Column) -> Column:
    """The timestamp of a date cell, for the least and greatest."""
    iso = F.when(text.rlike(whole(r"\d{4}-\d{1,2}-\d{1,2}")), text.try_cast("date").cast("timestamp_ntz")).otherwise(text.try_cast("timestamp_ntz"))
    return F.when(text.rlike(whole(DATE_PATTERNS["iso_date"])), iso).otherwise(to_date(text).cast("timestamp_ntz"))


def _cells(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """(at, i, kind, cell): every cell as text, NULL if missing; kind is bool, number, date or text."""
    at = F.col("_row_idx") if "_row_idx" in df.columns else F.monotonically_increasing_id()
    numbered = df.withColumn("__at", at.cast("long"))
    rows = []
    for i, f in enumerate(fields):
        c, k = F.col(f"`{f.name}`"), f.dataType
        kind = "bool" if isinstance(k, T.BooleanType) else "number" if isinstance(k, T.NumericType) else "text"
        cell = c.cast("string")
        if isinstance(k, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kind, cell = "date", c.cast("timestamp_ntz").cast("string")
        elif isinstance(k, T.StringType):
            cell = F.when(~c.isin(*NA_WORDS), c)
        elif isinstance(k, (T.DoubleType, T.FloatType)):
            cell = F.when(~F.isnan(c), cell)
        elif isinstance(k, (T.ArrayType, T.MapType, T.StructType)):
            cell = F.to_json(c)
        rows.append(F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), cell.alias("cell")))
    return numbered.select(F.col("__at").alias("at"), F.inline(F.array(*rows)))


def profile_table(df: DataFrame, name: str, sample_size: int = 5) -> DataFrame:
    """One row for each column: type, samples, unique_count, null_ratio, min, max and format_pattern.

    Samples are the first cells with a value of the whole column.
    """
    if sample_size < 1:
        raise ValueError("sample_size must be at least 1")
    fields = [f for f in df.schema.fields if f.name != "_row_idx"]
    cell, kind = F.col("cell"), F.col("kind")
    cells = _cells(df, fields).withColumn("text", bare(cell)).withColumn("compact", F.translate("text", "\u00a0 ", ""))
    cells = cells.withColumns({
        "moment": F.when(kind == "date", F.col("text").try_cast("timestamp_ntz")).when(kind == "text", _moment(F.col("text"))),
        "number_label": F.when(kind == "number", F.when(cell.isNotNull(), "numeric")).when(kind == "text", _label(F.col("compact"), NUMBER_PATTERNS)),
    }).withColumns({
        "date_label": F.when(kind == "date", F.when(cell.isNotNull(), "excel_date")).when(F.col("moment").isNotNull(), _label(F.col("text"), DATE_PATTERNS)),
        "number": F.when(kind == "number", cell.try_cast("double")).when(F.col("number_label").isNotNull(), plain_number(F.col("compact")).try_cast("double")),
        "yes_no": (kind == "bool") | ((kind == "text") & F.lower("text").isin(*BOOLEAN_WORDS)),
    })
    there = cell.isNotNull()
    every = lambda c: F.coalesce(F.bool_and(F.when(there, c)), F.lit(False))
    shown_cell = F.when(kind == "date", F.replace(cell, F.lit(" "), F.lit("T"))).otherwise(cell)
    # Each task keeps its first sample_size cells of a column before any are dealt out.
    first = F.row_number().over(Window.partitionBy("i").orderBy("at")) <= sample_size
    head = _cells(df, fields).where(there).select("i", "at", shown_cell.alias("v"), first.alias("first")).where("first").groupBy("i").agg(
        F.sort_array(F.collect_list(F.struct("at", "v"))).alias("first")
    )
    by_column = cells.groupBy("i").agg(
        F.count("*").alias("rows"), F.count(cell).alias("filled"), F.count_distinct(cell).alias("unique_count"),
        every(F.col("yes_no")).alias("boolean"), every(F.col("date_label").isNotNull()).alias("date"),
        every(F.col("number_label").isNotNull()).alias("number"), every(F.col("number") == F.floor("number")).alias("whole"),
        F.collect_set("date_label").alias("date_labels"), F.collect_set("number_label").alias("number_labels"),
        F.min("moment").alias("first_date"), F.max("moment").alias("last_date"), F.min("number").alias("least"), F.max("number").alias("most"),
        F.bool_or(kind == "bool").alias("typed_bool"),
    )
    named = F.broadcast(df.sparkSession.createDataFrame([(i, f.name) for i, f in enumerate(fields)], "i int, name string"))
    # From the names, so that a table without rows has profiles too.
    rows = named.join(by_column, "i", "left").fillna(0, ["rows", "filled", "unique_count"]).withColumn("p", F.struct(*by_column.columns[1:])).join(head, "i", "left")
    one = lambda labels, mixed: F.when(F.size(labels) == 1, labels[0]).otherwise(mixed)
    p = F.col("p")
    found = (
        F.when(p["filled"] == 0, "string").when(p["boolean"], "boolean").when(p["date"], "date")
        .when(p["number"] & p["whole"], "integer").when(p["number"], "decimal").otherwise("string")
    )
    rows = rows.withColumn("inferred_type", found)
    k = F.col("inferred_type")
    day = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    shown = lambda c: F.when(k == "integer", F.col(f"p.{c}").cast("decimal(38,0)").cast("string")).when(k == "decimal", F.col(f"p.{c}").cast("string"))
    return rows.orderBy("i").select(
        F.lit(name).alias("table"), "name", "inferred_type",
        F.coalesce(F.transform("first", lambda x: x["v"]), F.array().cast("array<string>")).alias("samples"),
        p["unique_count"].alias("unique_count"),
        F.when(p["rows"] == 0, 0.0).otherwise((p["rows"] - p["filled"]) / p["rows"]).alias("null_ratio"),
        F.when(k == "date", day(p["first_date"])).otherwise(shown("least")).alias("min"),
        F.when(k == "date", day(p["last_date"])).otherwise(shown("most")).alias("max"),
        F.when(k == "boolean", F.when(p["filled"] == 0, None).when(p["typed_bool"], "boolean").otherwise("boolean_text"))
        .when(k == "date", one(p["date_labels"], "mixed_date"))
        .when(k.isin("integer", "decimal"), one(p["number_labels"], "mixed_numeric")).alias("format_pattern"),
    )


def profile_file(spark: SparkSession, path: str | Path, sheet: str | None = None, sample_size: int = 5) -> list[tuple[SourceTable, DataFrame]]:
    """Each table of a file with its profile; a CSV file may fall through to another encoding."""
    return [(t, profile_table(t.df, t.label, sample_size)) for t in read_tables(spark, path, sheet, fall_through=True)]
