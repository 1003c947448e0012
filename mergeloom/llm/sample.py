"""A bounded sample of labelled rows, for fitting classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.llm.text import trimmed
from mergeloom.runtime import written


def fold(doc_id: Column, parts: int) -> Column:
    """crc32(doc_id as text) mod parts; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def labelled_ids(labels: DataFrame, label: str, learn: Column, per_class: int) -> DataFrame:
    """(doc_id, y) of up to per_class rows of each class, 0 and 1: those of the least xxhash64(doc_id).

    A doc_id labelled both ways is in both classes.
    """
    known = labels.select("doc_id", F.col(label).alias("y")).where(learn & F.col("doc_id").isNotNull())
    first = [known.where(F.col("y") == y).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return first[0].union(first[1])


def within(sizes: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Which rows stay: of each group, the first, in the order given, until they reach ``most`` bytes together."""
    keep = np.zeros(len(sizes), bool)
    for g in np.unique(group):
        rows = np.flatnonzero(group == g)
        before = np.cumsum(sizes[rows]) - sizes[rows]
        keep[rows[before < most]] = True
    return keep


def bounded(found: DataFrame, name: str, most: int) -> DataFrame:
    """(at, doc_id, text, <name>) of found: in the order of at, xxhash64(doc_id), each class as long as its texts stay below ``most`` bytes.

    The text that passes the bound is still in: a text is left out for its
    place in the order, never for its length.  A doc_id counts once in a class,
    with the least of its texts.
    """
    held = written(found.groupBy("doc_id", name).agg(F.min("text").alias("text")).withColumn("at", F.xxhash64("doc_id")), "sample")
    sizes = held.select("at", "doc_id", name, F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).toArrow().sort_by(_order(name))
    _, group = np.unique(np.array(sizes.column(name).to_pylist()), return_inverse=True)
    keep = within(sizes.column("bytes").to_numpy(), group, most)
    if not keep.all():
        chosen = held.sparkSession.createDataFrame(sizes.select(["doc_id", name]).filter(pa.array(keep)))
        held = held.join(F.broadcast(chosen), ["doc_id", name])  # rows of two values
    return held.select("at", "doc_id", "text", name)


def _order(name: str) -> list[tuple[str, str]]:
    return [(c, "ascending") for c in ("at", "doc_id", name)]


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, class_bytes: int) -> DataFrame:
    """As bounded() gives them: texts and y, their 0/1 label, of up to per_class rows of each class, those of the least xxhash64(doc_id).

    learn: a condition on doc_id.  A class ends with the text that brings it to
    class_bytes, so that all have 2 x class_bytes and two texts at most.  Rows
    that repeat a doc_id count once.
    """
    ids = labelled_ids(labels, label, learn, per_class)
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # 2 x per_class rows of two numbers
    return bounded(found, "y", class_bytes)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, class_bytes: int) -> tuple[pa.ChunkedArray, np.ndarray]:
    """labelled_rows() on the driver: texts and labels."""
    table = labelled_rows(docs, labels, label, learn, per_class, class_bytes).toArrow().sort_by(_order("y"))
    return table.column("text"), table.column("y").to_numpy().astype(np.int64)


def fitted(sample: DataFrame, name: str, fit: Callable[[pa.Array, list], Any]) -> Any:
    """fit(texts, classes) of a bounded sample, worked out by one task, so that the driver holds the model only and a lost executor costs a retry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        table = pa.Table.from_batches(rows).sort_by(_order(name)) if rows else pa.table({"text": pa.array([], pa.string()), name: pa.array([], pa.int64())})
        rows.clear()
        classes, texts = table.column(name).to_pylist(), [table.column("text").combine_chunks()]
        del table
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts.pop(), classes))], pa.binary())], ["model"])

    model = sample.coalesce(1).mapInArrow(trimmed(run), "model binary").collect()
    return pickle.loads(model[0][0]) if model else fit(pa.array([], pa.string()), [])
