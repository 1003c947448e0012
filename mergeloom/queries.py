"""The registered queries over the table engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergeloom.functions.coerce import coerce, is_missing
from mergeloom.functions.keys import comparison_key
from mergeloom.operators import dedup, entity, validate
from mergeloom.operators.components import components
from mergeloom.operators.profile import profile_table
from mergeloom.operators.union import Merged, SourceTable, combined, unify
from mergeloom.plans.contracts import Cluster, ClusterMember, Clusters, Mapping, MappingEntry, SourceMatch, TargetColumn, TargetSchema
from mergeloom.sources.sinks import insert_statements

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plan(**targets: dict[str, str | None]) -> Mapping:
    return Mapping([MappingEntry(t, [SourceMatch(f, c, 1.0, "auto" if c else "unmatched") for f, c in by.items()]) for t, by in targets.items()])


# ---- union -----------------------------------------------------------------

_PARTY = TargetSchema([TargetColumn("party_name", "string", True), TargetColumn("nation", "integer"), TargetColumn("balance", "decimal")])
_PARTY_PLAN = _plan(
    party_name={"customer": "c_name", "supplier": "s_name"},
    nation={"customer": "c_nationkey", "supplier": "s_nationkey"},
    balance={"customer": "c_acctbal", "supplier": "s_acctbal"},
)
_PARTY_SQL = """
SELECT c_name AS party_name, c_nationkey::BIGINT AS nation, c_acctbal AS balance, 'customer' AS src, 'c_name' AS p_name, 'c_acctbal' AS p_balance FROM customer
UNION ALL SELECT s_name, s_nationkey::BIGINT, s_acctbal, 'supplier', 's_name', 's_acctbal' FROM supplier"""


def _parties(spark: SparkSession, sf_dir: str) -> Merged:
    tables = [SourceTable(n, n, _table(spark, sf_dir, n)) for n in ("customer", "supplier")]
    return unify(tables, _PARTY_PLAN, _PARTY)


@_query(f"""SELECT party_name, nation, balance, src AS _source_file, p_name AS party_name_source_column,
  CASE src WHEN 'customer' THEN 'c_nationkey' ELSE 's_nationkey' END AS nation_source_column, p_balance AS balance_source_column FROM ({_PARTY_SQL})""")
def mapped_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combined(_parties(spark, sf_dir).df, _PARTY)


_ITEM = TargetSchema([TargetColumn("item", "string", True), TargetColumn("amount", "decimal"), TargetColumn("brand", "string", True)])


def _items(spark: SparkSession, sf_dir: str) -> Merged:
    plan = _plan(
        item={"customer": "c_name", "supplier": "s_name", "part": "p_name"},
        amount={"customer": "c_acctbal", "supplier": None, "part": "p_retailprice"},
        brand={"customer": None, "supplier": None, "part": "p_brand"},
    )
    return unify([SourceTable(n, n, _table(spark, sf_dir, n)) for n in ("customer", "supplier", "part")], plan, _ITEM)


_ITEMS_SQL = """
SELECT c_name AS item, c_acctbal AS amount, NULL::VARCHAR AS brand, 'customer' AS src, 'c_acctbal' AS p_amount, NULL::VARCHAR AS p_brand FROM customer
UNION ALL SELECT s_name, NULL, NULL, 'supplier', NULL, NULL FROM supplier
UNION ALL SELECT p_name, p_retailprice, p_brand, 'part', 'p_retailprice', 'p_brand' FROM part"""


@_query(f"SELECT item, amount, brand, src AS _source_file, p_amount AS amount_source_column, p_brand AS brand_source_column FROM ({_ITEMS_SQL})")
def union_partial_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combined(_items(spark, sf_dir).df, _ITEM).drop("item_source_column")


@_query(f"SELECT 0::BIGINT AS party_name, 0::BIGINT AS nation, 0::BIGINT AS balance, (SELECT count(*) FROM ({_PARTY_SQL})) AS merged_rows")
def clean_union_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _parties(spark, sf_dir)
    return merged.failures().crossJoin(merged.df.agg(F.count("*").alias("merged_rows")))  # one row with one row


# ---- coercion --------------------------------------------------------------


def _lineitem_text(spark: SparkSession, sf_dir: str, text: F.Column, *keys: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(*keys, text.alias("cell"))


def _price_cents() -> F.Column:
    return F.round(F.col("l_extendedprice") * 100).cast("bigint")


def _grouped(cents: F.Column, group: str, point: str) -> F.Column:
    units = F.floor(cents / 100).cast("string")
    grouped = F.reverse(F.regexp_replace(F.reverse(units), r"(\d{3})(?=\d)", f"$1{group}"))
    return F.concat(grouped, F.lit(point), F.lpad((cents % 100).cast("string"), 2, "0"))


_CENTS = "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 100)::BIGINT / 100.0 AS value, false AS bad FROM lineitem"


@_query(_CENTS)
def coerce_decimal_tr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _lineitem_text(spark, sf_dir, _grouped(_price_cents(), ".", ","), "l_orderkey", "l_linenumber")
    value, bad = coerce(F.col("cell"), "decimal")
    return df.select("l_orderkey", "l_linenumber", value.alias("value"), bad.alias("bad"))


@_query(_CENTS)
def coerce_decimal_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _lineitem_text(spark, sf_dir, F.concat(F.lit(" "), _grouped(_price_cents(), ",", ".")), "l_orderkey", "l_linenumber")
    value, bad = coerce(F.col("cell"), "decimal")
    return df.select("l_orderkey", "l_linenumber", value.alias("value"), bad.alias("bad"))


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::BIGINT END AS value, l_linenumber % 2 <> 0 AS bad FROM lineitem")
def coerce_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ",0").otherwise(",5"))
    value, bad = coerce(F.col("cell"), "integer")
    df = _lineitem_text(spark, sf_dir, text, "l_orderkey", "l_linenumber")
    return df.select("l_orderkey", "l_linenumber", value.alias("value"), bad.alias("bad"))


def _dates(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    value, bad = coerce(F.date_format("o_orderdate", pattern), "date")
    return _table(spark, sf_dir, "orders").select("o_orderkey", value.cast("string").alias("value"), bad.alias("bad"))


_DATES = "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS value, false AS bad FROM orders"


@_query(_DATES)
def coerce_date_tr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir, "d.M.yyyy")


@_query(_DATES)
def coerce_date_slash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir, "dd/MM/yyyy")


@_query(_DATES)
def coerce_date_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir, "yyyy-MM-dd'T'HH:mm:ss'Z'")


@_query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS value, o_orderstatus NOT IN ('F', 'O') AS bad FROM orders")
def coerce_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    value, bad = coerce(F.when(status == "F", " EVET").when(status == "O", "hayır ").otherwise("belki"), "boolean")
    return _table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"), bad.alias("bad"))


@_query("SELECT event_type, count(*) FILTER (event_type IS NOT NULL AND trim(event_type) <> '') AS bad, count(*) AS n_rows FROM events GROUP BY event_type")
def conversion_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = coerce(F.col("event_type"), "decimal")
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(bad.cast("long")).alias("bad"), F.count("*").alias("n_rows"))


@_query("SELECT o_orderkey, o_orderkey % 3 <> 0 AS missing FROM orders")
def null_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    cell = F.when(key % 3 == 0, " x ").when(key % 3 == 1, "  \t")
    return _table(spark, sf_dir, "orders").select("o_orderkey", is_missing(cell).alias("missing"))


# ---- profiles --------------------------------------------------------------


@_query("""
SELECT 'o_custkey' AS name, 'integer' AS inferred_type, count(DISTINCT o_custkey) AS unique_count, 0.0::DOUBLE AS null_ratio, min(o_custkey)::VARCHAR AS min, max(o_custkey)::VARCHAR AS max, 'numeric' AS format_pattern FROM orders
UNION ALL SELECT 'o_orderdate', 'date', count(DISTINCT o_orderdate), 0.0, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S'), strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S'), 'excel_date' FROM orders
UNION ALL SELECT 'o_orderpriority', 'string', count(DISTINCT o_orderpriority), 0.0, NULL, NULL, NULL FROM orders""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority")
    return profile_table(orders, "orders").drop("table", "samples")


@_query("""
SELECT 'amount' AS name, 'decimal' AS inferred_type, 'tr_decimal' AS format_pattern UNION ALL SELECT 'day', 'date', 'tr_date_dd.mm.yyyy'
UNION ALL SELECT 'whole', 'integer', 'integer' UNION ALL SELECT 'flag', 'boolean', 'boolean_text' UNION ALL SELECT 'mixed_day', 'date', 'mixed_date' UNION ALL SELECT 'words', 'string', NULL""")
def type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("o_orderkey") % 2 == 0
    cells = _table(spark, sf_dir, "orders").select(
        F.concat(F.col("o_custkey").cast("string"), F.lit(",25")).alias("amount"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"),
        F.col("o_custkey").cast("string").alias("whole"), F.when(even, "evet").otherwise("No").alias("flag"),
        F.when(even, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("mixed_day"),
        F.col("o_orderpriority").alias("words"),
    )
    return profile_table(cells, "orders").select("name", "inferred_type", "format_pattern")


# ---- entities --------------------------------------------------------------


@_query("SELECT p_name AS value, count(*) AS row_count FROM part WHERE trim(p_name) <> '' GROUP BY p_name")
def value_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.value_frequency(_table(spark, sf_dir, "part"), "p_name").select("value", "row_count")


@_query("SELECT p_partkey, (p_size * 10)::VARCHAR || 'ml kutu ' || p_partkey::VARCHAR AS key FROM part")
def entity_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.col("p_size").cast("string"), F.lit(",0 CL (KT)  № "), F.col("p_partkey").cast("string"))
    return _table(spark, sf_dir, "part").select("p_partkey", comparison_key(value).alias("key"))


def _customers(spark: SparkSession, sf_dir: str, *strategy: str, **columns: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.concat("c_mktsegment", F.lit(" "), "c_name").alias("value"), "c_mktsegment", "c_nationkey")
    return entity.with_blocks(rows, strategy, **columns)


_SEGMENT = "lower(c_mktsegment)"


@_query(f"SELECT c_custkey AS idx, left({_SEGMENT}, 3) AS block FROM customer")
def blocking_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir, "prefix").select("idx", "block")


@_query(f"SELECT c_custkey AS idx, {_SEGMENT} AS block FROM customer")
def blocking_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir, "brand").select("idx", "block")


_BLOCK = f"left({_SEGMENT}, 3) || '|' || {_SEGMENT} || '|' || c_nationkey::VARCHAR"


@_query(f"SELECT c_custkey AS idx, {_BLOCK} AS block FROM customer")
def blocking_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir, "prefix", "brand", "category", category="c_nationkey").select("idx", "block")


@_query(f"SELECT sum(n * (n - 1) // 2)::BIGINT AS pair_count FROM (SELECT count(*) AS n FROM customer GROUP BY {_SEGMENT})")
def pair_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.pair_count(_customers(spark, sf_dir, "brand"))


@_query(f"""WITH b AS (SELECT c_custkey AS idx, {_BLOCK} AS block FROM customer)
SELECT a.block, a.idx AS left_idx, c.idx AS right_idx FROM b a JOIN b c ON a.block = c.block AND a.idx < c.idx""")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = _customers(spark, sf_dir, "prefix", "brand", "category", category="c_nationkey")
    return entity.candidate_pairs(blocked).select("block", "left_idx", "right_idx")


def _vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbours by vec_id within a label: as many as rows."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    w = Window.partitionBy("label").orderBy("vec_id")
    pairs = rows.withColumns({"right_idx": F.lead("vec_id").over(w), "other": F.lead("v").over(w)}).where(F.col("right_idx").isNotNull())
    return pairs.select(F.col("vec_id").alias("left_idx"), "right_idx", entity.cosine(F.col("v"), F.col("other")).alias("similarity"))


_COSINE = """WITH p AS (SELECT vec_id AS left_idx, lead(vec_id) OVER w AS right_idx, embedding::DOUBLE[] AS a, lead(embedding::DOUBLE[]) OVER w AS b
  FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
s AS (SELECT left_idx, right_idx, greatest(0.0, least(1.0, list_cosine_similarity(a, b))) AS similarity FROM p WHERE right_idx IS NOT NULL)
"""
_T = entity.Thresholds(0.3, 0.1)


@_query(_COSINE + "SELECT left_idx, right_idx, round(similarity, 6) AS similarity FROM s")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_pairs(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@_query(_COSINE + """SELECT left_idx, right_idx, CASE WHEN similarity >= 0.3 THEN 'same' WHEN similarity < 0.1 THEN 'different' ELSE 'undecided' END AS decision,
  CASE WHEN similarity >= 0.3 OR similarity < 0.1 THEN 'auto' ELSE 'review' END AS status, similarity >= 0.1 AND similarity < 0.3 AS grey FROM s""")
def classify_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.classify(_vector_pairs(spark, sf_dir), _T).drop("similarity", "source")


@_query(_COSINE + "SELECT round(avg((similarity >= 0.1 AND similarity < 0.3)::INT), 9) AS grey_ratio FROM s")
def grey_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = entity.grey_ratio(entity.classify(_vector_pairs(spark, sf_dir), _T))
    return out.select(F.round("grey_ratio", 9).alias("grey_ratio"))


def _customer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with the next of its nation and segment: a chain for each of them."""
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.lead("c_custkey").over(w).alias("next"))
    return rows.where(F.col("next").isNotNull())


_CHAINS = """SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS component,
  count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n, c_name FROM customer"""


@_query(f"SELECT node, component FROM ({_CHAINS}) WHERE n > 1")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(_customer_edges(spark, sf_dir))


@_query(f"SELECT component AS root, arg_min(c_name, (-(node % 7), length(c_name), c_name)) AS canonical FROM ({_CHAINS}) WHERE n > 1 GROUP BY component")
def canonical_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = components(_customer_edges(spark, sf_dir)).join(_table(spark, sf_dir, "customer"), F.col("node") == F.col("c_custkey"))
    return entity.elect(members.select(F.col("component").alias("root"), F.col("c_name").alias("value"), (F.col("node") % 7).alias("row_count")))


# ---- dedup -----------------------------------------------------------------

_PRIORITIES = Clusters([
    Cluster("c001", "priority", "1-URGENT", "auto", [ClusterMember("1-URGENT", 1), ClusterMember("2-HIGH", 1)]),
    Cluster("c002", "priority", "4-NOT SPECIFIED", "auto", [ClusterMember("4-NOT SPECIFIED", 1), ClusterMember("5-LOW", 1)]),
    Cluster("c003", "priority", "3-MEDIUM", "review", [ClusterMember("3-MEDIUM", 1)]),
])
_ORDER = TargetSchema([TargetColumn("priority", "string"), TargetColumn("status", "string"), TargetColumn("customer", "integer")])


def _priorities(spark: SparkSession, sf_dir: str) -> Merged:
    plan = _plan(priority={"orders": "o_orderpriority"}, status={"orders": "o_orderstatus"}, customer={"orders": "bucket"})
    orders = _table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 50).alias("bucket"), F.col("o_orderkey").alias("_row_idx"))
    return unify([SourceTable("orders", "orders", orders)], plan, _ORDER)


_REWRITTEN = """SELECT o_orderkey, o_orderstatus AS status, o_custkey % 50 AS customer, o_orderpriority AS original,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'c001' WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'c002' END AS cluster,
  CASE WHEN o_orderpriority = '2-HIGH' THEN '1-URGENT' WHEN o_orderpriority = '5-LOW' THEN '4-NOT SPECIFIED' ELSE o_orderpriority END AS priority FROM orders"""


@_query(f"SELECT o_orderkey AS _row_idx, priority, CASE WHEN cluster IS NOT NULL THEN original END AS priority_original_value, cluster AS _entity_cluster_id FROM ({_REWRITTEN})")
def canonical_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _priorities(spark, sf_dir)
    out = dedup.rewrite(merged.df, "priority", dedup.canonical_map(merged.df, _PRIORITIES))
    return out.select("_row_idx", "priority", "priority_original_value", "_entity_cluster_id")


_FOLDED = f"""WITH r AS ({_REWRITTEN}), o AS (SELECT *, row_number() OVER (PARTITION BY cluster, priority, status, customer, original ORDER BY o_orderkey) AS occ FROM r WHERE cluster IS NOT NULL),
f AS (SELECT cluster, priority, status, customer, min(o_orderkey) AS row_idx, count(*) AS merged, string_agg(original, '; ' ORDER BY o_orderkey) AS originals, sum((original <> priority)::INT) AS changed
  FROM o GROUP BY cluster, priority, status, customer, occ UNION ALL
  SELECT NULL, priority, status, customer, o_orderkey, 1, NULL, 0 FROM r WHERE cluster IS NULL)
"""


@_query(_FOLDED + "SELECT priority, status, customer, 'orders' AS _source_file, cluster AS _entity_cluster_id, originals AS priority_original_value, merged AS _merged_row_count, row_idx AS _row_idx FROM f")
def entity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.deduplicate(_priorities(spark, sf_dir), _PRIORITIES).df
    return out.select("priority", "status", "customer", "_source_file", "_entity_cluster_id", "priority_original_value", "_merged_row_count", "_row_idx")


@_query(_FOLDED + "SELECT count(DISTINCT cluster) AS merged_cluster_count, sum(merged - 1)::BIGINT AS duplicate_row_count, sum(changed)::BIGINT AS canonicalized_count FROM f")
def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(_priorities(spark, sf_dir), _PRIORITIES).summary()


# ---- validation and sinks --------------------------------------------------


@_query(f"SELECT src AS _source_file, p_amount AS source_column, count(*) AS n_rows, count(*) FILTER (amount IS NULL) AS nulls FROM ({_ITEMS_SQL}) WHERE p_amount IS NOT NULL GROUP BY 1, 2")
def null_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.null_by_source(_items(spark, sf_dir).df, "amount").withColumnRenamed("rows", "n_rows")


@_query("""WITH q AS (SELECT count(v) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM (SELECT o_totalprice AS v FROM orders)),
f AS (SELECT *, q1 - 0.5 * (q3 - q1) AS low, q3 + 0.5 * (q3 - q1) AS high FROM q)
SELECT any_value(n) AS n_rows, round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3, count(*) FILTER (o_totalprice < low OR o_totalprice > high) AS outliers,
  max(CASE WHEN o_totalprice < low OR o_totalprice > high THEN abs(o_totalprice) END) AS largest FROM orders, f""")
def numeric_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate.numeric_outliers(_table(spark, sf_dir, "orders"), "o_totalprice", validate.Settings(iqr_factor=0.5))
    return out.select(F.col("rows").alias("n_rows"), F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"), "outliers", "largest")


@_query("SELECT l_orderkey, l_linenumber, l_shipdate::DATE::VARCHAR AS day FROM lineitem WHERE year(l_shipdate) < 1993 OR year(l_shipdate) > 1997")
def date_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = validate.date_outlier("l_shipdate", validate.Settings(min_year=1993, max_year=1997))
    return _table(spark, sf_dir, "lineitem").where(odd).select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").cast("string").alias("day"))


def _cells_report(spark: SparkSession, sf_dir: str) -> validate.Report:
    merged = _items(spark, sf_dir)
    plan = _plan(item={"customer": "c_name"}, amount={"part": "p_retailprice"}, brand={"part": "p_brand"})
    return validate.validate(merged, plan, validate.Settings(max_year=2030))


@_query(f"SELECT 'required' AS \"check\", 'error' AS severity, 'brand' AS target, count(*) FILTER (brand IS NULL) AS n FROM ({_ITEMS_SQL}) HAVING count(*) FILTER (brand IS NULL) > 0")
def required_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(f.check, f.severity, f.target, f.count) for f in _cells_report(spark, sf_dir).findings if f.check == "required"]
    return spark.createDataFrame(rows, "check string, severity string, target string, n long")


@_query("SELECT count(*) FILTER (o_orderkey % 2 = 0) AS tr, count(*) FILTER (o_orderkey % 2 <> 0) AS en FROM orders")
def mixed_decimal_notation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.when(F.col("o_orderkey") % 2 == 0, "1.234,5").otherwise("1,234.5")
    hits = lambda p: F.sum(cell.rlike(validate.whole(p)).cast("long"))
    return _table(spark, sf_dir, "orders").agg(hits(validate.TR_DECIMAL).alias("tr"), hits(validate.EN_DECIMAL).alias("en"))


@_query("""SELECT 'null' AS "check", 'error' AS severity, 'note' AS target, count(*) AS n FROM orders
UNION ALL SELECT 'type', 'error', 'amount', count(*) FILTER (o_orderpriority <> '5-LOW') FROM orders
UNION ALL SELECT 'required', 'error', 'amount', count(*) FILTER (o_orderpriority <> '5-LOW') FROM orders""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = TargetSchema([TargetColumn("amount", "decimal", True), TargetColumn("note", "string")])
    plan = _plan(amount={"orders": "cell"}, note={"orders": "blank"})
    cells = _table(spark, sf_dir, "orders").select(F.when(F.col("o_orderpriority") == "5-LOW", "7,5").otherwise(F.col("o_orderpriority")).alias("cell"), F.lit(" ").alias("blank"))
    report = validate.validate(unify([SourceTable("orders", "orders", cells)], plan, schema), plan)
    rows = [(f.check, f.severity, f.target, f.count) for f in report.findings if f.severity == "error"]
    return spark.createDataFrame(rows, "check string, severity string, target string, n long")


@_query(f"SELECT count(*) AS merged_rows, sum((amount IS NULL)::INT + (brand IS NULL)::INT + (item IS NULL)::INT)::BIGINT AS total_null_cells FROM ({_ITEMS_SQL})")
def merge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _items(spark, sf_dir)
    return merged.df.agg(F.count("*").alias("merged_rows")).crossJoin(merged.null_cells())  # one row with one row


@_query("""SELECT 'INSERT INTO "nation" ("n_nationkey", "n_name", "n_regionkey") VALUES (' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''', ' || n_regionkey || ');' AS line FROM nation""")
def sql_script_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return nation.select(insert_statements(nation, "nation").alias("line"))


def _registered() -> None:
    from mergeloom import core_queries  # noqa: F401  registers its queries


def queries() -> dict[str, Query]:
    _registered()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _registered()
    return dict(_SQL)
