"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0 to 1, piecewise linear
between equally spaced knots.  Its integral, scaled so that the whole schedule
asks for the source's target, is the source's cumulative token demand; a
document's place in its source's stream is a demand, and inverting the integral
there gives its training position.  Documents are range-sorted by position.
Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.runtime import written

WORD = r"[^\x20\x09-\x0D]+"
#: Relative weights at the knots of the schedules, for weight 5, 2 and 1.
SHAPES = {5: (1.5, 1.0, 0.5), 2: (1.0, 1.0, 1.0), 1: (0.5, 1.0, 1.5)}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: float = 1.5, most: int = 2
) -> DataFrame:
    """(source, weight, source_size, target) from (source, source_size), one row per source.

    Targets share epochs x all sizes by weight; they stop at ``most`` x the
    source's size, and the excess is reshared by weight among the others until
    none is above.  That ends at the water level: sources in the order of
    size/weight are full as long as the level, what is left over the weights
    that are left, reaches their cap.
    """
    everyone = Window.partitionBy(F.lit(0))  # a row per source, after the aggregate
    by_name = everyone.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", cycle.cast("long")).withColumn("cap", F.col("source_size") * most)
    by_level = everyone.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.withColumns({
        "left": F.sum("source_size").over(everyone) * F.lit(float(epochs)) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weights_left": F.sum("weight").over(after),
    }).withColumn("full", F.col("weight") * F.col("left") >= F.col("cap") * F.col("weights_left"))
    first = everyone.orderBy("full", F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    ranked = ranked.withColumns({"level_left": F.first("left").over(first), "level_weights": F.first("weights_left").over(first)})
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level_left") / F.col("level_weights"))
    return ranked.select("source", "weight", "source_size", target.alias("target"))


def invert_schedule(shape: Column, share: Column) -> Column:
    """The time in 0 to 1 by which the schedule has asked for ``share`` of its whole demand.

    shape: weights at equally spaced knots, two or more, positive.
    """
    n = F.size(shape) - 1
    area = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda i: (shape[i] + shape[i + 1]) / 2), F.lit(0.0), lambda a, x: a + x)
    # (segments passed, demand still to meet) in units of one segment
    state = F.aggregate(
        F.sequence(F.lit(0), n - 2),
        F.struct(F.lit(0).alias("i"), (share * area).alias("rest")),
        lambda s, i: F.when(
            (s["i"] == i) & (s["rest"] > (shape[i] + shape[i + 1]) / 2),
            F.struct((i + 1).alias("i"), (s["rest"] - (shape[i] + shape[i + 1]) / 2).alias("rest")),
        ).otherwise(s),
    )
    low, high, rest = shape[state["i"]], shape[state["i"] + 1], state["rest"]
    root = F.sqrt(F.greatest(low * low + 2 * (high - low) * rest, F.lit(0.0)))
    return (state["i"] + F.least(F.lit(1.0), 2 * rest / (low + root))) / n


def _with_key(df: DataFrame) -> DataFrame:
    """__src: the source as a key that is never null."""
    return df.withColumn("__src", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source")))


def _join_sources(rows: DataFrame, per_source: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """Rows with what is known of their source; broadcast only once the number of sources is seen to be small."""
    if per_source.limit(broadcast_rows + 1).count() <= broadcast_rows:
        per_source = F.broadcast(per_source)
    return rows.join(per_source, "__src")


def mix_sources(docs: DataFrame, most: int = 2, shapes: dict = SHAPES, **shares) -> DataFrame:
    """docs with size, source_size, target, copies, taken and positions (an array, one for each copy) added.

    A source's documents stand in the order of md5(doc_id); the mix takes the
    stream that repeats them, document by document, until it comes nearest to
    the target, so a source misses its target by half a document at most: a
    document whose middle the stream passes before its end is taken.  Each time
    it is, the demand met by then gives its training position.  The order is cut
    into 4096 cells of the hash: sums of cells first, then the order within each
    cell, so that no task holds a source.

    shapes: the schedule of each weight; a weight without one is an error.

    A null text has no words; documents without words are never taken.  Null is
    a source of its own, the last.  Repeated rows are documents of their own,
    next to each other in the order.  Columns of docs with the names above are
    replaced, others pass.  An empty table gives an empty table.
    """
    added = ("size", "source_size", "target", "copies", "taken", "positions")
    if missing := set(shares.get("weights", (5, 2, 1))) - set(shapes):
        raise ValueError(f"no schedule for weights {sorted(missing)}")
    sized = _with_key(docs.drop(*added)).withColumns({
        "size": word_count(F.col("text")),
        "__key": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
    })
    head = F.conv(F.substring("__key", 1, 10), 16, 10).cast("long")
    # One pass over the texts gives the sums of fine cells of the hash order; buckets are runs of cells.
    cell = sized.groupBy("__src", "source", F.shiftright(head, 28).alias("__cell")).agg(
        F.sum("size").alias("__sum"), F.count("*").alias("__rows")
    )
    cell = written(cell, "cells")
    upto = Window.partitionBy("__src").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cell = cell.withColumn("__offset", F.coalesce(F.sum("__sum").over(upto), F.lit(0)))
    sizes = cell.groupBy("__src", "source").agg(F.sum("__sum").alias("source_size"))
    targets = _with_key(source_targets(sizes.drop("__src"), most=most, **shares)).drop("source")
    targets = written(targets.withColumnRenamed("weight", "__weight"), "targets")
    within = Window.partitionBy("__src", "__cell").orderBy("__key", "__text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumns({"__cell": F.shiftright(head, 28), "__text_hash": F.xxhash64("text")})
    placed = placed.withColumn("__before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(cell.select("__src", "__cell", "__offset"), ["__src", "__cell"])
    placed = _join_sources(placed, targets)
    # The demand that the stream has met at the middle of the document, the first time it passes.
    met = F.col("__offset") + F.col("__before") + F.col("size") / 2
    times = F.when(F.col("size") == 0, 0).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(most), F.floor((F.col("target") - met) / F.col("source_size")) + 1))
    )
    shape = F.lit(None)
    for weight, knots in shapes.items():
        shape = F.when(F.col("__weight") == weight, F.array(*map(F.lit, knots))).otherwise(shape)
    placed = placed.withColumns({"__times": times.cast("int"), "__met": met, "__shape": shape})
    placed = placed.withColumn("positions", F.when(F.col("__times") > 0, F.transform(
        F.sequence(F.lit(0), F.col("__times") - 1),
        lambda e: invert_schedule(F.col("__shape"), (e * F.col("source_size") + F.col("__met")) / F.col("target")),
    )).otherwise(F.array().cast("array<double>")))
    placed = placed.withColumn("copies", F.size("positions")).withColumn("taken", F.col("copies") * F.col("size"))
    return placed.select(*docs.drop(*added).columns, "size", "source_size", "target", "copies", "taken", "positions")


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs, once for each copy, range-sorted by training position."""
    mixed = mix_sources(docs, **options)
    names = [c for c in docs.columns if c in mixed.columns]
    copies = mixed.select(*names, F.explode("positions").alias("position"))
    return copies.orderBy("position", F.col("doc_id").asc_nulls_last())


def mix_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and its first and last training position, in whose order the rows are.

    taken is what stands at these positions; documents that the mix leaves out
    have none and come last.
    """
    mixed = mix_sources(docs.select("doc_id", "source", "text"))
    ends = {"first_position": F.get("positions", F.lit(0)), "last_position": F.get("positions", F.col("copies") - 1)}
    placed = mixed.select("doc_id", "size", "source_size", "target", "taken", *[c.alias(n) for n, c in ends.items()])
    return placed.orderBy(F.col("first_position").asc_nulls_last(), F.col("doc_id").asc_nulls_last())


MIX_SQL = r"""
WITH sized AS (
  SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {source}
), source_sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, 2 * source_size AS cap, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM source_sizes
), leveled AS (
  SELECT *, cap::DOUBLE / weight AS ratio,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
    (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS weights_left
  FROM ranked
), level AS (
  SELECT *, weight * rest >= cap * weights_left AS is_full FROM leveled
), water AS (SELECT rest, weights_left FROM level WHERE NOT is_full ORDER BY ratio, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, weight, source_size,
    CASE WHEN is_full THEN cap::DOUBLE ELSE weight * (SELECT rest FROM water) / (SELECT weights_left FROM water) END AS target
  FROM level
), placed AS (
  SELECT s.*, t.weight, t.source_size, t.target,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + size / 2.0::DOUBLE AS middle
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), mixed AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE greatest(0, least(2, floor((target - middle) / source_size)::BIGINT + 1)) END AS copies FROM placed
), timed AS (
  SELECT *, 1.0::DOUBLE AS k1, (CASE weight WHEN 5 THEN 1.5 WHEN 2 THEN 1.0 ELSE 0.5 END)::DOUBLE AS k0,
    (CASE weight WHEN 5 THEN 0.5 WHEN 2 THEN 1.0 ELSE 1.5 END)::DOUBLE AS k2,
    list_transform(range(copies), lambda e: (e * source_size + middle) / target * 2.0::DOUBLE) AS rests FROM mixed
), positioned AS (
  SELECT *, list_transform(rests, lambda r: CASE WHEN r > (k0 + k1) / 2
    THEN (1.0::DOUBLE + least(1.0::DOUBLE, 2 * (r - (k0 + k1) / 2) / (k1 + sqrt(greatest(k1 * k1 + 2 * (k2 - k1) * (r - (k0 + k1) / 2), 0.0::DOUBLE))))) / 2
    ELSE least(1.0::DOUBLE, 2 * r / (k0 + sqrt(greatest(k0 * k0 + 2 * (k1 - k0) * r, 0.0::DOUBLE)))) / 2 END) AS positions FROM timed
)
"""
SQL = MIX_SQL.format(source="documents") + """
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, positions[1] AS first_position, positions[-1] AS last_position FROM positioned"""
