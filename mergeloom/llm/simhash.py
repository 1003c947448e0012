"""SimHash near-dedup: tiled exact comparison of fingerprints.

Distinct fingerprints are dealt into tiles of one population count each.  Two
tiles meet only if their counts differ by no more than the radius, for a
difference in count is a lower bound of the distance; tiles that meet are
compared whole by numpy exclusive-or and bit counts.  A pair of tiles gives a
spanning forest of its links, not the links: no more rows than fingerprints.
Components of the forests are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.llm.text import LOWER, Texts, chunks, gather, trimmed
from mergeloom.operators.components import components
from mergeloom.runtime import written

SEED = 42


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shingle_fingerprints(column: pa.Array, width: int) -> np.ndarray:
    """The fingerprint of every text."""
    out = np.zeros(len(column), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, j, data, offsets in chunks(column):
        texts = Texts(LOWER[data], offsets)
        # The words with one space after each; shingles are slices of it.
        spaced, begin = gather(texts.data, texts.start, texts.end, after=b" ")
        spaced = spaced.tobytes()
        first = texts.first
        last_start = np.maximum(first[1:] - width, first[:-1])  # of the last shingle
        n_shingles = np.where(first[1:] > first[:-1], last_start - first[:-1] + 1, 0)
        starts = np.repeat(first[:-1] - np.concatenate((np.zeros(1, np.int64), np.cumsum(n_shingles)[:-1])), n_shingles) + np.arange(n_shingles.sum())
        ends = np.minimum(starts + width, np.repeat(first[1:], n_shingles))
        hashes = np.fromiter(
            (digest(spaced[a:b], SEED) for a, b in zip(begin[starts].tolist(), (begin[ends] - 1).tolist())), np.uint64, len(starts)
        )
        cut = np.concatenate((np.zeros(1, np.int64), np.cumsum(n_shingles)))
        for k in range(j - i):
            out[i + k] = fingerprint(hashes[cut[k] : cut[k + 1]])
    return out


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = shingle_fingerprints(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, fp long")


def forest(a: np.ndarray, b: np.ndarray, radius: int, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, root) of the links between and at fingerprints of a and b (uint64)."""
    nodes = np.concatenate((a, b))
    parent = np.arange(len(nodes))
    half = np.bitwise_count(b >> np.uint64(32))
    order = np.argsort(half, kind="stable")
    half = half[order]
    a_order = np.argsort(np.bitwise_count(a >> np.uint64(32)), kind="stable")
    a_half = np.bitwise_count(a >> np.uint64(32)).astype(int)[a_order]
    for i in range(0, len(a), block):
        rows = a_order[i : i + block]
        lo = np.searchsorted(half, max(0, a_half[i] - radius))
        hi = np.searchsorted(half, a_half[min(i + block, len(a)) - 1] + radius, side="right")
        for j in range(lo, hi, 8192):
            columns = order[j : min(j + 8192, hi)]
            near = np.bitwise_count(a[rows][:, None] ^ b[columns][None, :]) <= radius
            for r in np.flatnonzero(near.any(axis=1)):
                met = np.append(columns[near[r]] + len(a), rows[r])
                root = parent[met]
                while (up := parent[root]).tolist() != root.tolist():
                    root = up
                least = root.min()
                parent[root] = least
                parent[met] = least
    while (up := parent[parent]).tolist() != parent.tolist():
        parent = up
    return nodes, nodes[parent]


def near_links(distinct: DataFrame, radius: int = 4, tiles: int = 64, tile_rows: tuple[int, int] = (1024, 131072)) -> DataFrame:
    """(u, v): forests that connect the fingerprints (column fp, distinct) at most radius bits apart.

    There are about ``tiles`` tiles while their size is within tile_rows.
    """
    counted = distinct.withColumn("ones", F.bit_count("fp").cast("int"))
    n = dict(counted.groupBy("ones").count().collect())  # 65 rows at most
    size = min(max(sum(n.values()) // tiles, tile_rows[0]), tile_rows[1])
    blocks = {k: -(-v // size) for k, v in n.items()}
    base, total = {}, 0
    for k in sorted(blocks):
        base[k], total = total, total + blocks[k]
    table = F.create_map(*[F.lit(x) for k in sorted(blocks) for x in (k, F.struct(F.lit(base[k]), F.lit(blocks[k])))]) if blocks else None
    if table is None:
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    at = counted.withColumn("deal", table[F.col("ones")])
    at = at.withColumn("tile", (F.col("deal.col1") + F.pmod(F.xxhash64("fp"), F.col("deal.col2"))).cast("int"))
    tile = at.groupBy("tile", "ones").agg(F.collect_list("fp").alias("fps"))  # size rows, give or take the hash
    # Tiles are numbered by count, so those that meet tile t are a range up to it and a range from it.
    low = {k: min(base[x] for x in blocks if x >= k - radius) for k in blocks}
    high = {k: max(base[x] + blocks[x] for x in blocks if x <= k + radius) for k in blocks}
    span = F.create_map(*[F.lit(x) for k in sorted(blocks) for x in (k, F.struct(F.lit(low[k]), F.lit(high[k] - 1)))])
    met = tile.withColumn("span", span[F.col("ones")]).select("tile", "fps", F.explode(F.sequence("span.col1", "span.col2")).alias("other"))
    pairs = met.select(F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "fps", "tile")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        sides = [np.asarray(x, np.int64).view(np.uint64) for x in table.sort_by("tile").column("fps").combine_chunks().to_numpy(zero_copy_only=False)]
        node, root = forest(sides[0], sides[-1], radius)
        linked = node != root
        return pa.table({"u": node[linked].view(np.int64), "v": root[linked].view(np.int64)})

    parts = max(1, min(4096, total * (total + 1) // 4))
    return pairs.repartition(parts, "p", "q").groupBy("p", "q").applyInArrow(compare, "u long, v long")


def near_components(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    A null or empty text, or one of white space, has fingerprint zero, which is
    linked like any other.  Texts of fewer words than ``width`` have one
    shingle, the whole sequence.  A null doc_id keeps its row; component_id is
    null only if no document of the component has an id.  Repeated rows come
    back as often as they were given.  An empty table gives an empty table;
    other columns of docs are not read.
    """
    prints = written(fingerprints(docs, width), "fingerprints")
    least = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = near_links(least.select("fp"), radius)
    joined = components(links)  # (node, component), of fingerprints that have a link
    members = joined.join(least, F.col("node") == F.col("fp"))
    ids = members.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = joined.join(ids, "component").select(F.col("node").alias("fp"), "component_id")
    known = written(
        least.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "known"
    )
    return prints.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """docs without those whose component holds a smaller doc_id; all columns stay.

    Rows of one doc_id stay or go together; a row without doc_id goes if its
    component has a document with one.
    """
    found = near_components(docs.select("doc_id", "text"), width, radius)
    spare = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(spare, docs["doc_id"].eqNullSafe(spare["doc_id"]), "left_anti")
