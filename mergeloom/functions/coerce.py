"""Text cells to the five logical types, as Column expressions.

Every conversion gives a pair: the typed value, NULL where the cell is missing
or does not fit, and whether it was there but did not fit.  Digits are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOGICAL_TYPES = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "decimal": T.DoubleType(),
    "date": T.DateType(),
    "boolean": T.BooleanType(),
}

# Words read as booleans.
TRUE_WORDS = ("true", "yes", "evet", "1")
FALSE_WORDS = ("false", "no", "hayir", "hayır", "0")

#: White space of Unicode.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SIGN, DIGITS = "[+-]?", r"\d+"


def marked(point: str) -> str:
    """Numbers with a fraction behind a mark."""
    return rf"{SIGN}{DIGITS}[{point}]{DIGITS}"


def grouped(mark: str, point: str) -> str:
    """Numbers with a fraction, whose whole part is in groups of three."""
    return rf"{SIGN}\d{{1,3}}(?:[{mark}]\d{{3}})+[{point}]{DIGITS}"


def whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def bare(cell: Column) -> Column:
    """The cell without white space, of Unicode, at its ends."""
    return F.btrim(cell, F.lit(BLANKS))


def is_missing(cell: Column) -> Column:
    return cell.isNull() | (bare(cell) == "")


def plain_number(cell: Column) -> Column:
    """The number in point notation, NULL if the cell is no number.

    Which marks there are, and which comes first, leaves one notation to test.
    """
    text = F.translate(bare(cell), "\u00a0 ", "")
    comma, point = F.instr(text, ","), F.instr(text, ".")
    fits = lambda pattern: text.rlike(whole(pattern))
    return (
        F.when(comma == 0, F.when(fits(rf"{SIGN}{DIGITS}(?:[.]{DIGITS})?"), text))
        .when(point == 0, F.when(fits(marked(",")), F.translate(text, ",", ".")))
        .when(point < comma, F.when(fits(grouped(".", ",")), F.translate(text, ",.", ".")))
        .otherwise(F.when(fits(grouped(",", ".")), F.translate(text, ",", "")))
    )


def to_decimal(cell: Column) -> Column:
    return F.nullif(F.nullif(plain_number(cell).try_cast("double"), F.lit(float("inf"))), F.lit(float("-inf")))


def to_integer(cell: Column) -> Column:
    """Of numbers without a fraction; beyond 64 bits they do not fit."""
    return F.nullif(F.regexp_extract(plain_number(cell), whole(rf"({SIGN}{DIGITS})(?:[.]0+)?"), 1), F.lit("")).try_cast("bigint")


_CLOCK = r"(?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:[.]\d{3}(?:\d{3})?)?)?)?(?:Z|[+-]\d{2}:?\d{2})?"


def to_date(cell: Column) -> Column:
    """Day first with points or slashes, or ISO, with or without a time, whose zone moves no date."""
    text = bare(cell)
    day_first = lambda mark: F.when(text.rlike(whole(rf"\d{{1,2}}[{mark}]\d{{1,2}}[{mark}]\d{{4}}")), F.try_to_date(text, f"d{mark}M{mark}yyyy"))
    iso = F.when(text.rlike(whole(rf"\d{{4}}-\d{{2}}-\d{{2}}(?:[T ]{_CLOCK})?")), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    # An ISO date has its first mark in the fifth place.
    return F.when(F.substring(text, 5, 1) == "-", iso).when(F.instr(text, "/") > 0, day_first("/")).otherwise(day_first("."))


def to_boolean(cell: Column) -> Column:
    text = F.lower(bare(cell))
    return F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)


_CONVERT = {"string": lambda c: c, "integer": to_integer, "decimal": to_decimal, "date": to_date, "boolean": to_boolean}


def _value(cell: Column, logical: str) -> Column:
    """Of a text cell.  No conversion but text's takes a missing cell for a value."""
    return F.when(~is_missing(cell), cell) if logical == "string" else _CONVERT[logical](cell)


def coerce_columns(df: DataFrame, cells: dict[str, tuple[Column, str, T.DataType | None]]) -> DataFrame:
    """df with, for each name of cells, that column and _bad_<name>: what coerce gives, every cell and value worked out once.

    Each step is a projection of its own, whose columns the next one mentions
    more than once; such projections are not folded into each other.
    """
    held = df.withColumns({f"__cell_{n}": cell for n, (cell, _, _) in cells.items()})
    pairs = {n: coerce(F.col(f"`__cell_{n}`"), logical, kind) for n, (_, logical, kind) in cells.items()}
    text = lambda kind: kind is None or isinstance(kind, T.StringType)
    held = held.withColumns({n: value for n, (value, _) in pairs.items()})
    bads = {}
    for n, (_, _, kind) in cells.items():
        bads[f"_bad_{n}"] = (F.col(f"`{n}`").isNull() & ~is_missing(F.col(f"`__cell_{n}`"))) if text(kind) else pairs[n][1]
    return held.withColumns(bads).drop(*[f"__cell_{n}" for n in cells])


def coerce(cell: Column, logical: str, kind: T.DataType | None = None) -> tuple[Column, Column]:
    """(value, bad) of a cell.

    kind: the cell's Spark type, text by default.  Typed cells are cast where
    that loses nothing; a boolean is no number.
    """
    if logical not in _CONVERT:
        raise ValueError(f"unknown type {logical!r}")
    if kind is None or isinstance(kind, T.StringType):
        value = _value(cell, logical)
        return value, value.isNull() & ~is_missing(cell)
    gone = cell.isNull()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        gone = gone | F.isnan(cell)
    target = LOGICAL_TYPES[logical]
    if logical == "string":
        value = cell.cast("string")
    elif logical == "decimal" and isinstance(kind, T.NumericType):
        value = F.when(F.abs(cell.cast("double")) != F.lit(float("inf")), cell.cast("double"))
    elif logical == "integer" and isinstance(kind, T.IntegralType):
        value = cell.cast("bigint")
    elif logical == "integer" and isinstance(kind, T.NumericType):
        value = F.when(cell == F.floor(cell), cell.try_cast("bigint"))
    elif logical == "date" and isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        value = cell.cast("date")
    elif logical == "boolean" and isinstance(kind, T.BooleanType):
        value = cell
    elif isinstance(kind, T.BooleanType) and logical in ("integer", "decimal"):
        value = F.lit(None).cast(target)
    else:
        value = _CONVERT[logical](cell.cast("string"))
    value = F.when(~gone, value)
    return value, ~gone & value.isNull()
