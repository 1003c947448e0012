"""Exact top-k search with multi-resolution segment statistics.

A vector is cut into equal segments at several resolutions; each segment has a
mean and a deviation.  With segments of length L, the squared distance of two
vectors is at least the sum of L((mean difference)**2 + (deviation
difference)**2), so with both norms known an inner product is bounded from
above.  Blocks of queries meet blocks of rows; in each, rows that the coarse
bound cannot rule out get the finer ones, and only what survives these gets its
exact product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 64
#: Segments at each resolution, coarse to fine; those that do not fit in a vector's length are left out.
RESOLUTIONS = (1, 4, 16)


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments of each row, both times the root of the segment's length."""
    parts = np.array_split(np.arange(x.shape[1]), segments)
    cuts = [p[0] for p in parts]
    length = np.array([len(p) for p in parts])
    mean = np.add.reduceat(x, cuts, axis=1) / length
    square = np.add.reduceat(x * x, cuts, axis=1) / length
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.concatenate((mean, deviation), axis=1) * np.sqrt(np.concatenate((length, length)))


def bounded_distance(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The lower bound of squared distances, from the statistics of one query and of rows."""
    return ((x - q) ** 2).sum(axis=1)


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows of the block, by place: all integers, ties to smaller ids; rows of the query's own id are none."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    width = rows.shape[1]
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * width
    exact = np.float64 if largest < 2**53 else np.int64  # products of float64 are exact up to there
    x, q = rows.astype(exact), queries.astype(exact)
    xf, qf = rows.astype(np.float64), queries.astype(np.float64)
    levels = [s for s in RESOLUTIONS if s < width]
    stats = [(segment_statistics(qf, s), segment_statistics(xf, s)) for s in levels]
    norm, q_norm = (xf * xf).sum(axis=1), (qf * qf).sum(axis=1)
    slack = 1e-9 * (1 + float(norm.max(initial=0)) + float(q_norm.max(initial=0)))  # rounding of the bounds
    for i in range(len(query_ids)):
        left = np.flatnonzero(ids != query_ids[i])
        least = -np.inf
        for level, (sq, sx) in enumerate(stats):
            upper = (q_norm[i] + norm[left] - bounded_distance(sq[i], sx[left])) / 2 + slack
            if len(left) > k:
                # The exact scores of the k most promising rows say what the others must reach.
                best = left[np.argpartition(upper, -k)[-k:]]
                least = max(least, float((x[best] @ q[i]).min()))
            left = left[upper >= least]
        score = (x[left] @ q[i]).astype(np.int64)
        order = np.lexsort((ids[left], -score))[:k]
        found.append((np.full(len(order), i), left[order], score[order]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(part) for part in zip(*found))


def top_products(
    vectors: DataFrame, every: int = 20, k: int = 20, scale: int = SCALE, query_rows: int = 2048, block_rows: int = 4096
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by ``every``, the k best inner products.

    Components are floor(scale * x), x as double; scores must fit a long.
    Candidates are all rows but those of the query's own vec_id.  Vectors that
    are null, empty, or hold null or non-finite components take no part, nor do
    rows without vec_id; vectors of another length than the query's are no
    candidates for it.  Rows that repeat whole are candidates, and queries, as
    often as they stand there: each is compared once and its results are
    repeated, for which k copies are enough.  A vec_id with different vectors is
    a candidate with each, and has one ranking over all its query rows.  Fewer
    candidates than k give fewer rows; an empty table gives an empty table;
    other columns are not read.
    """
    whole = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = (
        vectors.where(F.col("vec_id").isNotNull() & F.coalesce((F.size("embedding") > 0) & sound, F.lit(False)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
        .groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("copies"))
        .withColumn("width", F.size("v"))
    )
    sizes = {r["width"]: (r["n"], r["q"]) for r in rows.groupBy("width").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).collect()}
    blocks = lambda pick, size: F.coalesce(*[F.when(F.col("width") == w, max(1, -(-n[pick] // size))) for w, n in sizes.items()], F.lit(1))
    packed = F.sort_array(F.collect_list(F.struct("vec_id", "v", "copies")))  # about a block's rows
    deal = F.xxhash64("vec_id", "v")  # rows of one vec_id are dealt out, too
    q_block, c_block = F.pmod(deal, blocks(1, query_rows)).cast("int"), F.pmod(deal, blocks(0, block_rows)).cast("int")
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = asked.groupBy("width", q_block.alias("q")).agg(packed.alias("rows"))
    queries = queries.select("width", "q", F.explode(F.sequence(F.lit(0), blocks(0, block_rows) - 1)).alias("c"), F.lit(0).alias("side"), "rows")
    held = rows.groupBy("width", c_block.alias("c")).agg(packed.alias("rows"))
    held = held.select("width", F.explode(F.sequence(F.lit(0), blocks(1, query_rows) - 1)).alias("q"), "c", F.lit(1).alias("side"), "rows")

    def unpack(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = rows.flatten()
        ids, copies = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "copies"))
        return ids, flat.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1), copies

    def meet(table: pa.Table) -> pa.Table:
        side = table.column("side").to_pylist()
        if 0 not in side or 1 not in side:
            return pa.table({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score", "copies")})
        (query_ids, asked, asked_copies), (ids, held, held_copies) = (unpack(table.column("rows").slice(side.index(i), 1).combine_chunks()) for i in (0, 1))
        query, row, score = search_block(query_ids, asked, ids, held, k)
        found = (query_ids[query], ids[row], score, asked_copies[query] * held_copies[row])
        return pa.table(dict(zip(("query_id", "vec_id", "score", "copies"), map(pa.array, found))))

    both = queries.unionByName(held)
    n_pairs = sum(max(1, -(-n // block_rows)) * max(1, -(-q // query_rows)) for n, q in sizes.values())
    both = both.repartition(max(1, min(n_pairs, 8192)), "width", "q", "c")
    partial = both.groupBy("width", "q", "c").applyInArrow(meet, "query_id long, vec_id long, score long, copies long")
    each = partial.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
