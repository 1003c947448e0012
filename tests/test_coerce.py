import datetime
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from mergeloom.functions.coerce import coerce
from mergeloom.functions.keys import KeyTables, comparison_key


def values(spark, cells, logical):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, cell string")
    value, bad = coerce(F.col("cell"), logical)
    return [(r.v, r.b) for r in df.select("i", value.alias("v"), bad.alias("b")).orderBy("i").collect()]


@pytest.mark.parametrize("logical,cell,expected", [
    ("decimal", "12,50", 12.5), ("decimal", "1.234,56", 1234.56), ("decimal", "1,234.56", 1234.56), ("decimal", " 1 234,5 ", 1234.5),
    ("decimal", "1.500", 1.5), ("decimal", "1,234", 1.234), ("decimal", "-3", -3.0), ("integer", "12,0", 12), ("integer", "7", 7),
    ("date", "5.1.2024", datetime.date(2024, 1, 5)), ("date", "05/01/2024", datetime.date(2024, 1, 5)),
    ("date", "2024-01-05T23:59:59Z", datetime.date(2024, 1, 5)), ("date", "2024-01-05", datetime.date(2024, 1, 5)),
    ("boolean", " EVET", True), ("boolean", "hayır", False), ("boolean", "1", True), ("string", " x ", " x "),
])
def test_fits(spark, logical, cell, expected):
    assert values(spark, [cell], logical) == [(expected, False)]


@pytest.mark.parametrize("logical,cells", [
    ("decimal", ["1.234.567", ".5", "5.", "1e3", "₺5", "12,5\n6"]), ("integer", ["12,5", "99999999999999999999"]),
    ("date", ["2024-1-5", "2024", "2024-02-30", "31.02.2024", "2024-01-05T99", "5-1-2024"]), ("boolean", ["belki", "2"]),
])
def test_does_not_fit(spark, logical, cells):
    assert values(spark, cells, logical) == [(None, True)] * len(cells)


@pytest.mark.parametrize("logical", ["string", "decimal", "integer", "date", "boolean"])
def test_missing_is_not_bad(spark, logical):
    assert values(spark, [None, "", " \t ", " "], logical) == [(None, False)] * 4


def model(text):
    text = text.strip().replace(" ", "").replace(" ", "")
    for pattern, change in (
        (r"[+-]?\d+(\.\d+)?", lambda x: x), (r"[+-]?\d{1,3}(\.\d{3})+,\d+", lambda x: x.replace(".", "").replace(",", ".")),
        (r"[+-]?\d{1,3}(,\d{3})+\.\d+", lambda x: x.replace(",", "")), (r"[+-]?\d+,\d+", lambda x: x.replace(",", ".")),
    ):
        if re.fullmatch(pattern, text, re.A):
            return float(change(text))
    return None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("0123456789.,+- ", min_size=1, max_size=12), min_size=20, max_size=60))
def test_decimals_against_a_model(spark, cells):
    assert [v for v, _ in values(spark, cells, "decimal")] == [model(c) for c in cells]


@pytest.mark.parametrize("text,key", [
    ("Coca-Cola 330 ML", "coca cola 330ml"), ("COCA COLA 33cl", "coca cola 330ml"), ("Su 0,33 lt", "su 330ml"), ("Şeker 1.500 gr", "seker 1.5g"),
    ("X 1.500,00 ml", "x 1500ml"), ("1.234.567", "1234567"), ("İLAÇ 500 mg", "ilac 0.5g"), ("un 0.2 kg", "un 200g"), ("3lu paket", "3lu paket"),
    ("çay 5 ADT", "cay 5 adet"), ("IĞDIR büyük", "igdir buyuk"), ("  ", ""), (None, ""), ("a.b 1.5!", "a b 1.5"),
])
def test_keys(spark, text, key):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(comparison_key(F.col("t")).alias("k")).first().k == key


def test_key_tables_replace(spark):
    df = spark.createDataFrame([("2 kg pkt",)], "t string")
    own = KeyTables(units={}, abbreviations={"pkt": "p"})
    assert df.select(comparison_key(F.col("t"), own).alias("k")).first().k == "2 kg p"
