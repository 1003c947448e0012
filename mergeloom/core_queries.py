"""More registered queries: scoring, clusters, guards, proposals, findings and sinks, with inputs that do not fit as well."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.coerce import coerce_columns
from mergeloom.functions.keys import comparison_key
from mergeloom.operators import dedup, entity, validate
from mergeloom.operators.profile import profile_table
from mergeloom.operators.union import SourceTable, combined, unify
from mergeloom.plans.contracts import Clusters, Mapping, MappingEntry, SourceMatch, TargetColumn, TargetSchema
from mergeloom.plans.guards import apply_guards, currency_of, name_tokens
from mergeloom.plans.propose import FakeProvider, FileProfile, propose
from mergeloom.queries import _plan, _query, _table
from mergeloom.sources.sinks import create_statements, csv_line, insert_statements

# ---- coercion of cells in many notations -----------------------------------

#: (cell, what it is as a decimal or NULL), one for each remainder of a key.
DECIMALS = [
    ("1.500", "1.5"), ("12,5", "12.5"), ("1.234.567", None), (".5", None), ("1e3", None), ("-1.234,56", "-1234.56"), ("+1,234.5", "1234.5"),
    ("1,234,567", None), ("5.", None), (" 7 ", "7"), ("", None), ("12,34,5", None), ("1 234,5", "1234.5"), ("yok", None), ("0,0", "0"), ("12.34,5", None),
]
INTEGERS = [("12,0", "12"), ("12.50", None), ("7", "7"), ("-3,00", "-3"), ("1.234,0", "1234"), ("99999999999999999999", None), (" ", None), ("on", None)]
DATES = [
    ("5.1.2024", "2024-01-05"), ("31.02.2024", None), ("01/02/2023", "2023-02-01"), ("2024-01-05T23:59:59Z", "2024-01-05"), ("2024-02-30", None),
    ("2024-1-5", None), ("13/13/2024", None), ("2024-01-05 25:00", None), ("5-1-2024", None), ("", None), ("2024-12-31T00:00:00.123+03:00", "2024-12-31"), ("2024", None),
]
KEYS = [
    ("Coca-Cola 330 ML", "coca cola 330ml"), ("COCA COLA 33cl", "coca cola 330ml"), ("Şeker 1.500 gr", "seker 1.5g"), ("X 1.500,00 ml", "x 1500ml"),
    ("1.234.567", "1234567"), ("İLAÇ 500 mg", "ilac 0.5g"), ("un 0.2 kg", "un 200g"), ("3lu paket", "3lu paket"), ("çay 5 ADT", "cay 5 adet"),
    ("IĞDIR büyük 2 PK", "igdir buyuk 2 paket"), ("a.b 1.5!", "a b 1.5"), ("1,234,567 kt", "1234567 kutu"), ("12,34,5 x", "12 34 5 x"), ("Süt 1 Litre", "sut 1000ml"), (" ", ""),
]


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _case(key: str, pairs: list[tuple[str, str | None]], part: int) -> str:
    return f"CASE {key} % {len(pairs)} " + " ".join(f"WHEN {i} THEN {_quoted(p[part])}" for i, p in enumerate(pairs)) + " END"


def _forms(spark: SparkSession, sf_dir: str, pairs: list[tuple[str, str | None]], logical: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    cells = F.array(*[F.lit(p[0]) for p in pairs])[(F.col("o_orderkey") % len(pairs)).cast("int")]
    return coerce_columns(orders, {"value": (cells, logical, None)}).select("o_orderkey", "value", F.col("_bad_value").alias("bad"))


def _forms_sql(pairs: list[tuple[str, str | None]], kind: str) -> str:
    missing = [i for i, p in enumerate(pairs) if not p[0].strip()]
    there = f"o_orderkey % {len(pairs)} NOT IN ({', '.join(map(str, missing))})" if missing else "true"
    value = f"({_case('o_orderkey', pairs, 1)})::{kind}"
    return f"SELECT o_orderkey, {value} AS value, {value} IS NULL AND {there} AS bad FROM orders"


@_query(_forms_sql(DECIMALS, "DOUBLE"))
def coerce_decimal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir, DECIMALS, "decimal")


@_query(_forms_sql(INTEGERS, "BIGINT"))
def coerce_integer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir, INTEGERS, "integer")


@_query(_forms_sql(DATES, "VARCHAR"))
def coerce_date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir, DATES, "date").withColumn("value", F.col("value").cast("string"))


@_query(f"SELECT o_orderkey, ({_case('o_orderkey', KEYS, 1)}) AS key FROM orders")
def entity_key_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(*[F.lit(p[0]) for p in KEYS])[(F.col("o_orderkey") % len(KEYS)).cast("int")]
    return _table(spark, sf_dir, "orders").select("o_orderkey", comparison_key(cells).alias("key"))


# ---- profiles with samples -------------------------------------------------


@_query("""
WITH late AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey >= (SELECT count(*) - 100 FROM orders) AND o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR || ' EUR' END AS price,
  CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS priority FROM orders)
SELECT 'price' AS name, (SELECT string_agg(price, '|' ORDER BY pos) FROM (SELECT * FROM late WHERE price IS NOT NULL ORDER BY pos LIMIT 5)) AS samples, count(DISTINCT price) AS unique_count FROM late
UNION ALL SELECT 'priority', (SELECT string_agg(priority, '|' ORDER BY pos) FROM (SELECT * FROM late WHERE priority IS NOT NULL ORDER BY pos LIMIT 5)), count(DISTINCT priority) FROM late
UNION ALL SELECT 'nothing', '', 0""")
def column_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading values of whole columns, of one that begins late as well."""
    orders = _table(spark, sf_dir, "orders")
    first = orders.count() - 100
    key = F.col("o_orderkey")
    cells = orders.select(
        key.alias("_row_idx"), F.when((key >= first) & (key % 2 == 0), F.concat(key.cast("string"), F.lit(" EUR"))).alias("price"),
        F.when(key % 3 > 0, F.col("o_orderpriority")).alias("priority"), F.lit(None).cast("string").alias("nothing"))
    return profile_table(cells, "orders").select("name", F.array_join("samples", "|").alias("samples"), "unique_count")


@_query("""
SELECT 'c_name' AS name, 'string' AS inferred_type, 0.0::DOUBLE AS null_ratio, NULL AS format_pattern UNION ALL SELECT 'na', 'integer', 0.5, 'integer'
UNION ALL SELECT 'slash', 'date', 0.0, 'date_dd/mm/yyyy' UNION ALL SELECT 'grouped', 'decimal', 0.0, 'tr_decimal_grouped' UNION ALL SELECT 'empty', 'string', 1.0, NULL
UNION ALL SELECT 'flag', 'boolean', 0.0, 'boolean' UNION ALL SELECT 'point', 'decimal', 0.0, 'en_decimal' UNION ALL SELECT 'both', 'decimal', 0.0, 'mixed_numeric'""")
def type_inference_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("c_custkey") % 2 == 0
    cells = _table(spark, sf_dir, "customer").select(
        "c_name", F.when(even, F.col("c_custkey").cast("string")).otherwise("NA").alias("na"), F.lit("01/02/2024").alias("slash"), F.lit("1.234,5").alias("grouped"),
        F.lit("N/A").alias("empty"), even.alias("flag"), F.lit("7.25").alias("point"), F.when(even, "1,5").otherwise("1.5").alias("both"))
    return profile_table(cells, "customer").select("name", "inferred_type", "null_ratio", "format_pattern")


# ---- pairs and clusters ----------------------------------------------------


def letters(texts: list[str]) -> list[list[float]]:
    """An embedder that SQL can follow: how often each letter stands in a text."""
    return [[float(t.count(chr(97 + i))) for i in range(26)] for t in texts]


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of part names, numbered by code point, with how many rows have each."""
    return entity.value_frequency(_table(spark, sf_dir, "part"), "p_name")


_PARTS_SQL = """
WITH rec AS (SELECT row_number() OVER (ORDER BY p_name) - 1 AS idx, p_name AS value, count(*) AS row_count FROM part GROUP BY p_name
), vec AS (SELECT *, left(replace(value, ' ', ''), 3) AS block, list_transform(range(26), lambda i: (len(value) - len(replace(value, chr((97 + i)::INT), '')))::DOUBLE) AS v FROM rec
), pairs AS (SELECT a.block, a.idx AS left_idx, b.idx AS right_idx, a.value AS left_value, b.value AS right_value, greatest(0, least(1, list_cosine_similarity(a.v, b.v))) AS similarity
  FROM vec a JOIN vec b ON a.block = b.block AND a.idx < b.idx
), judged AS (SELECT *, CASE WHEN similarity >= 0.8 THEN 'same' WHEN similarity < 0.65 THEN 'different' ELSE 'undecided' END AS decision,
    CASE WHEN similarity >= 0.8 OR similarity < 0.65 THEN 'auto' ELSE 'review' END AS status, similarity >= 0.65 AND similarity < 0.8 AS grey FROM pairs
)
"""
_LIMITS = entity.Thresholds(0.8, 0.65)


def _decisions(spark: SparkSession, sf_dir: str, complete=None) -> DataFrame:
    blocked = entity.with_blocks(_parts(spark, sf_dir))
    return entity.resolve_pairs(blocked, letters, complete, _LIMITS, include_unblocked=False)


@_query(_PARTS_SQL + "SELECT left_idx, right_idx, left_value, right_value, round(similarity, 9) AS similarity, decision, status, grey FROM judged")
def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate pair of every block, embedded by its keys, scored and classified."""
    return _decisions(spark, sf_dir).select("left_idx", "right_idx", "left_value", "right_value", F.round("similarity", 9).alias("similarity"), "decision", "status", "grey")


@_query(_PARTS_SQL + "SELECT count(*) AS pairs, count(*) FILTER (grey) AS grey_pairs, count(*) FILTER (status = 'review') AS pending, round(avg(grey::INT), 9) AS grey_ratio FROM judged")
def pair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decisions(spark, sf_dir)
    counts = d.agg(F.count("*").alias("pairs"), F.count(F.when(F.col("grey"), 1)).alias("grey_pairs"), F.count(F.when(F.col("status") == "review", 1)).alias("pending"))
    return counts.crossJoin(entity.grey_ratio(d).select(F.round("grey_ratio", 9).alias("grey_ratio")))  # one row with one row


def same_end(system: str, user: str) -> str:
    """Advice by rule: the same if both texts end with one letter, less sure of long ones, and no JSON about some."""
    left, right = json.loads(user)
    if left.startswith("n"):
        return "who knows"
    return "```json\n" + json.dumps({"same": left[-1] == right[-1], "confidence": 0.9 if len(left) < 10 else 0.3, "reason": "its end"}) + "\n```"


@_query(_PARTS_SQL + """SELECT left_idx, right_idx, status, CASE WHEN left_value LIKE 'n%' OR len(left_value) >= 10 THEN 'undecided' WHEN right(left_value, 1) = right(right_value, 1) THEN 'same' ELSE 'different' END AS suggestion,
  CASE WHEN left_value LIKE 'n%' THEN NULL WHEN len(left_value) >= 10 THEN 0.3 ELSE 0.9 END::DOUBLE AS confidence FROM judged WHERE grey""")
def grey_zone_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice on the grey pairs only; no answer settles a pair."""
    return _decisions(spark, sf_dir, same_end).where("grey").select("left_idx", "right_idx", "status", "suggestion", "confidence")


_CLUSTERS_SQL = _PARTS_SQL.replace("WITH rec", "WITH RECURSIVE rec") + """, sure AS (
  SELECT left_idx AS a, right_idx AS b FROM judged WHERE decision = 'same' UNION SELECT right_idx, left_idx FROM judged WHERE decision = 'same'
), reach AS (SELECT left_idx AS idx, left_idx AS other FROM judged UNION SELECT right_idx, right_idx FROM judged UNION SELECT r.idx, s.b FROM reach r JOIN sure s ON r.other = s.a
), root AS (SELECT idx, min(other) AS root FROM reach GROUP BY idx
), member AS (SELECT root.root, rec.* FROM root JOIN rec USING (idx)
), doubt AS (SELECT j.*, l.root AS left_root, r.root AS right_root FROM judged j JOIN root l ON j.left_idx = l.idx JOIN root r ON j.right_idx = r.idx WHERE status = 'review'
), outer_ AS (SELECT least(left_root, right_root) AS root, CASE WHEN left_root < right_root THEN right_value ELSE left_value END AS value, max(similarity) AS similarity
  FROM doubt WHERE left_root <> right_root GROUP BY 1, 2
), inner_ AS (SELECT DISTINCT left_root AS root FROM doubt WHERE left_root = right_root
), kept AS (SELECT root, count(*) AS n FROM member GROUP BY root HAVING count(*) >= 2 OR root IN (SELECT root FROM outer_)
), numbered AS (SELECT root, n, 'c' || lpad((row_number() OVER (ORDER BY root))::VARCHAR, 3, '0') AS cluster_id,
    CASE WHEN root IN (SELECT root FROM outer_) OR root IN (SELECT root FROM inner_) THEN 'review' ELSE 'auto' END AS status FROM kept
)
"""


def _clusters(spark: SparkSession, sf_dir: str) -> Clusters:
    blocked = entity.with_blocks(_parts(spark, sf_dir))
    decisions = entity.resolve_pairs(blocked, letters, None, _LIMITS, include_unblocked=False)
    return entity.cluster_plan(decisions, blocked, "item")


@_query(_CLUSTERS_SQL + """SELECT cluster_id, status, value, row_count, value AS normalized,
  first_value(value) OVER (PARTITION BY cluster_id ORDER BY row_count DESC, len(value), value) AS canonical FROM member JOIN numbered USING (root)""")
def cluster_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with their numbers, statuses, elected spellings and members."""
    rows = [(c.cluster_id, c.status, c.canonical, m.value, m.row_count, m.normalized) for c in _clusters(spark, sf_dir).clusters for m in c.members]
    return spark.createDataFrame(rows, "cluster_id string, status string, canonical string, value string, row_count long, normalized string")


@_query(_CLUSTERS_SQL + """SELECT cluster_id, value, round(similarity, 6) AS similarity, 'undecided' AS suggestion, 'embedding' AS source,
  row_number() OVER (PARTITION BY cluster_id ORDER BY similarity DESC, value) AS place FROM outer_ JOIN numbered USING (root)""")
def cluster_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubtful neighbours of each cluster, best first."""
    rows = [(c["cluster_id"], k["value"], k["similarity"], k["suggestion"], k["source"], i)
            for c in _clusters(spark, sf_dir).to_document() for i, k in enumerate(c.get("candidates", []), 1)]
    return spark.createDataFrame(rows, "cluster_id string, value string, similarity double, suggestion string, source string, place long")


@_query(_CLUSTERS_SQL + """SELECT cluster_id, n::VARCHAR || ' values, ' || (SELECT count(*) FROM outer_ o WHERE o.root = numbered.root)::VARCHAR || ' doubtful' ||
  CASE WHEN root IN (SELECT root FROM inner_) THEN ', a doubtful link inside' ELSE '' END AS reason, status = 'review' AS pending FROM numbered""")
def cluster_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _clusters(spark, sf_dir)
    pending = {c.cluster_id for c in plan.pending()}
    return spark.createDataFrame([(c.cluster_id, c.reason, c.cluster_id in pending) for c in plan.clusters], "cluster_id string, reason string, pending boolean")


@_query("SELECT CASE WHEN c_custkey % 4 = 0 THEN '<unblocked>' ELSE lower(left(c_mktsegment, 2)) || '|' || c_nationkey::VARCHAR END AS block, count(*) AS n FROM customer GROUP BY 1")
def blocking_unblocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that lack a part of their block key are in no block."""
    rows = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("idx"), F.when(F.col("c_custkey") % 4 == 0, " - ").otherwise(F.col("c_mktsegment")).alias("value"), "c_nationkey")
    return entity.with_blocks(rows, ("prefix", "category"), prefix_length=2, category="c_nationkey").groupBy("block").agg(F.count("*").alias("n"))


@_query("""WITH b AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS block, count(*) AS n FROM customer GROUP BY 1)
SELECT (SELECT count(*) * (count(*) - 1) // 2 FROM customer)::BIGINT AS all_pairs, sum(n * (n - 1) // 2)::BIGINT AS with_unblocked, (sum(n * (n - 1) // 2) FILTER (block IS NOT NULL))::BIGINT AS blocked FROM b""")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_nationkey").cast("string")).alias("value"))
    blocked = entity.with_blocks(rows, ("brand",))
    every = entity.pair_count(blocked, include_unblocked=True).withColumnRenamed("pair_count", "with_unblocked")
    return every.crossJoin(entity.pair_count(blocked).withColumnRenamed("pair_count", "blocked")).withColumn("all_pairs", F.lit(entity.all_pairs_count(rows.count())))  # one row with one row


@_query("SELECT 'of two lengths' AS vectors, true AS refused UNION ALL SELECT 'with a null', true UNION ALL SELECT 'empty', true UNION ALL SELECT 'whole', false")
def vector_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one table as they are, and with some of another length, with a NULL, or empty."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    odd = F.col("vec_id") % 7 == 0
    kinds = {
        "of two lengths": F.when(odd, F.slice("vector", 1, 5)).otherwise(F.col("vector")),
        "with a null": F.when(odd, F.transform("vector", lambda x, i: F.when(i > 0, x))).otherwise(F.col("vector")),
        "empty": F.array().cast("array<double>"), "whole": F.col("vector"),
    }
    out = []
    for name, vector in kinds.items():
        try:
            entity.check_vectors(rows.select(vector.alias("vector")))
            out.append((name, False))
        except ValueError:
            out.append((name, True))
    return spark.createDataFrame(out, "vectors string, refused boolean")


@_query("""SELECT a.vec_id, CASE WHEN a.vec_id % 3 = 0 THEN NULL WHEN a.vec_id % 3 = 1 THEN 0.0 ELSE 1.0 END::DOUBLE AS similarity FROM embeddings a""")
def cosine_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of unequal lengths there is no similarity, a vector without length has 0, a vector with itself 1."""
    v = F.col("embedding").cast("array<double>")
    k = F.col("vec_id") % 3
    other = F.when(k == 0, F.slice(v, 1, 3)).when(k == 1, F.transform(v, lambda x: F.lit(0.0))).otherwise(v)
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(entity.cosine(v, other), 9).alias("similarity"))


# ---- plans, guards and proposals -------------------------------------------


def _nation_plan(spark: SparkSession, sf_dir: str) -> Mapping:
    names = [r["n_name"] for r in _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    column = ["Toplam Tutar {}", "Birim Fiyat (TL) {}", "price_usd {}", "sehir {}", "net {}"]
    sources = [SourceMatch(n, column[i % 5].format(n), 0.9, "unmatched" if i % 5 == 3 else "auto") for i, n in enumerate(names)]
    return Mapping([MappingEntry("unit_price", sources), MappingEntry("city", [SourceMatch(n, f"sehir {n}", 0.9, "auto") for n in names])])


@_query("""SELECT t.target, n_name AS file, CASE WHEN t.target = 'city' THEN 'auto' WHEN n_nationkey % 5 = 3 THEN 'unmatched' ELSE 'review' END AS status,
  CASE WHEN t.target = 'city' OR n_nationkey % 5 = 3 THEN 'none' WHEN n_nationkey % 5 IN (0, 4) THEN 'total' ELSE 'currency' END AS doubt
FROM nation, (VALUES ('unit_price'), ('city')) t(target)""")
def semantic_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals for a price of one item, and two currencies for one target, lose their trust; nothing else does."""
    out = []
    for e in apply_guards(_nation_plan(spark, sf_dir), {}).entries:
        for m in e.sources:
            doubt = "none" if not m.reason else "total" if "total" in m.reason else "currency" if "currencies" in m.reason else "other"
            out.append((e.target, m.file, m.status, doubt))
    return spark.createDataFrame(out, "target string, file string, status string, doubt string")


@_query("SELECT 'auto' AS status, (SELECT count(*) FROM nation) + (SELECT count(*) FILTER (n_nationkey % 5 <> 3) FROM nation) AS n UNION ALL SELECT 'review', 0 UNION ALL SELECT 'unmatched', (SELECT count(*) FILTER (n_nationkey % 5 = 3) FROM nation)")
def plan_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(_nation_plan(spark, sf_dir).status_counts().items()), "status string, n long")


@_query("SELECT n_name AS file FROM nation WHERE n_nationkey % 5 <> 3")
def pending_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = apply_guards(_nation_plan(spark, sf_dir), {}).pending()
    return spark.createDataFrame([(m.file,) for _, m in pending], "file string")


@_query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'TL' WHEN 2 THEN 'EUR' WHEN 3 THEN 'GBP' END AS currency,
  CASE n_nationkey % 5 WHEN 0 THEN 'price usd' WHEN 1 THEN 'fiyat' WHEN 2 THEN 'ucret euro' WHEN 3 THEN 'amount' ELSE 'isim' END AS words FROM nation""")
def currency_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By words of the name, by its signs, or by what the samples show; and the words of names."""
    cells = [("price_usd", []), ("Fiyat (₺)", []), ("ÜCRET-euro", ["5 $"]), ("amount", ["x", "12 £"]), ("İsim", ["dollars"])]
    keys = [r["n_nationkey"] for r in _table(spark, sf_dir, "nation").select("n_nationkey").collect()]  # 25 rows
    rows = [(k, currency_of(*cells[k % 5]), " ".join(name_tokens(cells[k % 5][0]))) for k in keys]
    return spark.createDataFrame(rows, "n_nationkey int, currency string, words string")


@_query("""SELECT 'f' || n_nationkey::VARCHAR AS file, t.target, CASE WHEN t.target = 'b' THEN CASE WHEN n_nationkey % 4 = 1 THEN 'review' ELSE 'unmatched' END
    WHEN t.target = 'c' THEN 'review' ELSE CASE n_nationkey % 4 WHEN 0 THEN 'auto' ELSE 'review' END END AS status,
  CASE WHEN t.target = 'a' AND n_nationkey % 4 IN (0, 2) THEN 'x' END AS "column" FROM nation, (VALUES ('a'), ('b'), ('c')) t(target)""")
def proposal_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call for each file; sure matches are auto, others and unusable answers wait for review, null is unmatched."""
    keys = [r["n_nationkey"] for r in _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    profile = {"name": "x", "samples": ["1"], "inferred_type": "string", "unique_count": 1, "null_ratio": 0.0, "min": None, "max": None, "format_pattern": None}
    match = lambda t, c, sure: {"target_column": t, "source_column": c, "confidence": sure, "reason": "r"}
    nothing = match("b", None, 0.9)
    answers = [
        json.dumps({"matches": [match("a", "x", 0.95), nothing]}), "no JSON", json.dumps({"matches": [match("a", "x", 0.5), nothing, match("c", "z", 0.99)]}),
        "```json\n" + json.dumps([match("a", "x", 7), nothing]) + "\n```",
    ]
    provider = FakeProvider(*[answers[k % 4] for k in keys])
    schema = TargetSchema([TargetColumn(n, "string") for n in "abc"])
    plan = propose([FileProfile(f"f{k}", [profile]) for k in keys], schema, provider)
    assert len(provider.calls) == len(keys)
    return spark.createDataFrame([(m.file, e.target, m.status, m.column) for e in plan.entries for m in e.sources], "file string, target string, status string, column string")


# ---- union and dedup at their edges ----------------------------------------

_CELL = TargetSchema([TargetColumn("key", "integer"), TargetColumn("amount", "decimal", True), TargetColumn("day", "date"), TargetColumn("note", "string")])


def _sheets(spark: SparkSession, sf_dir: str):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_row_idx"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.lit("2024-01-05").alias("d"))
    parts = [SourceTable("book", "book#Jan", orders.where("k % 3 = 0"), 0), SourceTable("book", "book#Feb", orders.where("k % 3 = 1").drop("v"), 1),
             SourceTable("book", "book#Towns", orders.select("_row_idx", F.lit("x").alias("town")), 2)]
    return unify(parts, _plan(key={"book": "k"}, amount={"book": "v"}, day={"book": "d"}, note={"book": None}), _CELL)


@_query("""SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS amount, '2024-01-05' AS day, CASE o_orderkey % 3 WHEN 0 THEN 'book#Jan' ELSE 'book#Feb' END AS _source_file,
  'v' AS amount_source_column, 'book#Towns' AS skipped FROM orders WHERE o_orderkey % 3 < 2""")
def sheets_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet without any mapped column is skipped; one without some has NULL there, its origin still named."""
    merged = _sheets(spark, sf_dir)
    out = combined(merged.df, _CELL).withColumn("skipped", F.lit("; ".join(merged.skipped)))
    return out.select("key", "amount", F.col("day").cast("string").alias("day"), "_source_file", "amount_source_column", "skipped")


@_query("SELECT o_orderkey % 3 AS sheet, row_number() OVER (ORDER BY o_orderkey % 3, o_orderkey) - 1 AS place, o_orderkey AS key FROM orders WHERE o_orderkey % 3 < 2")
def union_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order of files, sheets and rows."""
    from mergeloom.operators.numbering import number_rows

    merged = _sheets(spark, sf_dir).df.select("_file_idx", "_sheet_idx", "_row_idx", "key")
    placed = number_rows(merged, ("_file_idx", "_sheet_idx", "_row_idx"), "place")
    return placed.select(F.col("_sheet_idx").cast("long").alias("sheet"), "place", "key")


@_query("""WITH r AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'A' END AS name, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 20 END AS who FROM orders),
o AS (SELECT *, row_number() OVER (PARTITION BY who, name ORDER BY pos) AS occ FROM r)
SELECT 'a' AS name, who, count(*) AS merged, string_agg(name, '; ' ORDER BY pos) AS originals, min(pos) AS pos FROM o GROUP BY who, occ""")
def dedup_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL equals NULL in the key that is folded on."""
    from mergeloom.plans.contracts import Cluster, ClusterMember

    schema = TargetSchema([TargetColumn("name", "string"), TargetColumn("who", "integer")])
    rows = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("_row_idx"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("A").alias("name"),
        F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 20).alias("who"))
    merged = unify([SourceTable("f", "f", rows)], _plan(name={"f": "name"}, who={"f": "who"}), schema)
    clusters = Clusters([Cluster("c001", "name", "a", "auto", [ClusterMember("a", 1), ClusterMember("A", 1)])])
    out = dedup.deduplicate(merged, clusters).df
    return out.select("name", "who", F.col("_merged_row_count").alias("merged"), F.col("name_original_value").alias("originals"), F.col("_row_idx").alias("pos"))


# ---- findings and sinks ----------------------------------------------------

_ODD = TargetSchema([TargetColumn("amount", "decimal", True), TargetColumn("day", "date"), TargetColumn("code", "string"), TargetColumn("size", "integer"), TargetColumn("gone", "string", True)])
_ODD_PLAN = _plan(amount={"orders": "amount"}, day={"orders": "day"}, code={"orders": "code"}, size={"orders": "size"}, gone={"orders": None})


def _odd_report(spark: SparkSession, sf_dir: str) -> validate.Report:
    k = F.col("o_orderkey")
    cells = _table(spark, sf_dir, "orders").select(
        k.alias("_row_idx"), F.when(k % 10 == 0, "x").when(k % 1000 == 7, (k * 1000000).cast("string")).otherwise((k % 100).cast("string")).alias("amount"),
        F.when(k % 5000 == 1, "01.01.1700").when(k % 2 == 0, None).otherwise("2024-01-05").alias("day"),
        F.when(k % 3 == 0, "1.234,5").when(k % 3 == 1, "1,234.5").otherwise("C").alias("code"),
        F.when(k % 4 == 0, (k % 50).cast("string")).alias("size"))
    merged = unify([SourceTable("orders", "orders", cells)], _ODD_PLAN, _ODD)
    return validate.validate(merged, _ODD_PLAN, validate.Settings(max_year=2030, null_ratio=0.6))


_ODD_SQL = """
WITH c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 1000 = 7 THEN o_orderkey * 1000000 ELSE o_orderkey % 100 END::DOUBLE AS amount FROM orders
), q AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM c
), o AS (SELECT k, amount, row_number() OVER (ORDER BY amount) AS up, row_number() OVER (ORDER BY amount DESC) AS down FROM c, q WHERE amount < q1 - 3 * (q3 - q1) OR amount > q3 + 3 * (q3 - q1)
), d AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5000 = 1
), f AS (
  SELECT 'type' AS "check", 'warning' AS severity, 'amount' AS target, count(*) AS n, NULL AS samples FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT 'outlier', 'warning', 'amount', count(*), CASE WHEN count(*) <= 3 THEN string_agg(printf('%g', amount), ';' ORDER BY up) ELSE string_agg(printf('%g', amount), ';' ORDER BY up) FILTER (up <= 2 OR down = 1) END FROM o HAVING count(*) > 0
  UNION ALL SELECT 'required', 'error', 'amount', count(*), NULL FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT 'outlier', 'warning', 'day', count(*), array_to_string(list_transform(range(least(count(*), 3)), lambda i: '1700-01-01'), ';') FROM d HAVING count(*) > 0
  UNION ALL SELECT 'type', 'warning', 'code', count(*), '1.234,5;1,234.5' FROM orders WHERE o_orderkey % 3 < 2
  UNION ALL SELECT 'null', 'warning', 'size', count(*), NULL FROM orders WHERE o_orderkey % 4 > 0
  UNION ALL SELECT 'required', 'error', 'gone', NULL, NULL)
"""


@_query(_ODD_SQL + "SELECT * FROM f")
def validation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of finding, with its samples in order."""
    rows = [(f.check, f.severity, f.target, f.count, ";".join(map(str, f.samples)) or None) for f in _odd_report(spark, sf_dir).findings]
    return spark.createDataFrame(rows, "check string, severity string, target string, n long, samples string")


@_query(_ODD_SQL + """SELECT target, CASE WHEN e = 0 THEN '' ELSE e::VARCHAR || CASE WHEN e > 1 THEN ' errors' ELSE ' error' END END || CASE WHEN e > 0 AND w > 0 THEN ', ' ELSE '' END ||
  CASE WHEN w = 0 THEN '' ELSE w::VARCHAR || CASE WHEN w > 1 THEN ' warnings' ELSE ' warning' END END AS verdict FROM (SELECT target, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM f GROUP BY target)""")
def column_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _odd_report(spark, sf_dir)
    return spark.createDataFrame([(c, report.verdict(c)) for c in _ODD.names], "target string, verdict string")


@_query("SELECT 'amount' AS target, 'review' AS status UNION ALL SELECT 'day', 'auto' UNION ALL SELECT 'code', 'auto' UNION ALL SELECT 'size', 'auto' UNION ALL SELECT 'gone', 'unmatched'")
def plan_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the plan that errors blame wait for review again."""
    out = validate.downgrade(_ODD_PLAN, _odd_report(spark, sf_dir))
    return spark.createDataFrame([(e.target, e.sources[0].status) for e in out.entries], "target string, status string")


@_query("""SELECT target, n, q1, q3 FROM (SELECT 'totalprice' AS target, count(*) AS n, round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(quantile_cont(o_totalprice, 0.75), 6) AS q3 FROM orders
UNION ALL SELECT 'hot', count(*), 5.0, 5.0 FROM orders UNION ALL SELECT 'few', count(*) FILTER (o_orderkey < 6), 1.25, 3.75 FROM orders)""")
def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles of several targets at once, of one where most rows have one value."""
    k = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("totalprice"), F.when(k % 10 == 0, k).otherwise(5).alias("hot"), F.when(k < 6, k).alias("few"))
    out = validate.quartiles(rows, ["totalprice", "hot", "few"])
    return out.select("target", F.col("rows").alias("n"), F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"))


_DOUBLES = "CASE s_suppkey % 4 WHEN 0 THEN s_acctbal WHEN 1 THEN s_acctbal * 10000000 WHEN 2 THEN s_suppkey / 65536.0 ELSE s_suppkey * 1000.0 END::DOUBLE"


@_query(f"""SELECT 'INSERT INTO "t_" ("key", "key_2", "_2x", "s_name") VALUES (' || s_suppkey || ', ' || coalesce(({_DOUBLES})::VARCHAR, 'NULL') || ', ' || CASE WHEN s_suppkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END ||
  ', ''' || replace(s_name || '''s', '''', '''''') || ''');' AS line FROM supplier""")
def sql_script_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles as they are written shortest, booleans, quotes, and names that would be one."""
    k = F.col("s_suppkey")
    double = F.when(k % 4 == 0, F.col("s_acctbal")).when(k % 4 == 1, F.col("s_acctbal") * 10000000).when(k % 4 == 2, k / 65536.0).otherwise(k * 1000.0)
    rows = _table(spark, sf_dir, "supplier").select(k.alias("key"), double.alias("key "), (k % 2 == 0).alias("2x"), F.concat("s_name", F.lit("'s")).alias("s_name"))
    return rows.select(insert_statements(rows, "t%").alias("line"))


@_query("""SELECT n_nationkey::VARCHAR || ',' || CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN '"a, ' || n_name || '"' WHEN 2 THEN '"say ""' || n_name || repeat(chr(34), 3) ELSE '' END || ',' ||
  CASE WHEN n_nationkey % 2 = 0 THEN 'True' ELSE 'False' END || ',' || (n_nationkey / 2.0::DOUBLE)::VARCHAR AS line FROM nation""")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    name = F.when(k % 4 == 0, F.col("n_name")).when(k % 4 == 1, F.concat(F.lit("a, "), "n_name")).when(k % 4 == 2, F.concat(F.lit('say "'), "n_name", F.lit('"')))
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", name.alias("name"), (k % 2 == 0).alias("even"), (k / 2.0).alias("half"))
    return rows.select(csv_line(rows).alias("line"))


@_query("""SELECT 'DROP TABLE IF EXISTS "orders_2024";' AS line UNION ALL SELECT 'CREATE TABLE "orders_2024" (' || chr(10) || '  "key" INTEGER,' || chr(10) || '  "amount" REAL,' || chr(10) || '  "_source_file" TEXT,' || chr(10) || '  "_merged_row_count" INTEGER' || chr(10) || ');'""")
def sql_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.lit(1).alias("key"), F.lit(1.0).alias("amount"), F.lit("x").alias("_source_file"), F.lit(1).alias("_merged_row_count"))
    return spark.createDataFrame([(x,) for x in create_statements(rows, "orders 2024", {"key": "INTEGER", "amount": "REAL"})], "line string")
