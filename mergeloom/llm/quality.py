"""Quality by naive Bayes support vectors.

Features are indicators of a text's words and word pairs, hashed.  Each is
scaled by its class log-count ratio, and a linear hinge-loss model is fitted to
the scaled indicators by dual coordinate descent.  Its margin, through a
logistic curve fitted to the sample, is the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.llm.sample import fitted, fold, labelled_rows
from mergeloom.llm.text import RollingHash, Texts, chunks, mix, trimmed


@dataclass
class Settings:
    features_log2: int = 20
    #: Added to each class's count of a feature.
    smoothing: float = 1.0
    #: The bound of the dual variables.
    cost: float = 1.0
    epochs: int = 20
    #: Bounds of the labelled sample, of each class: documents, and bytes at which it ends.
    per_class: int = 2500
    class_bytes: int = 24_000_000


#: Kinds of bytes: A-Z, a-z and others of letters, digits, and each other byte its own.
KIND = np.arange(256, dtype=np.uint8)
KIND[65:91] = 65
KIND[97:123] = 97
KIND[128:] = 97
KIND[48:58] = 48


def indicators(data: np.ndarray, offsets: np.ndarray, features_log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of some texts, and where those of each text begin.

    Words, pairs of neighbouring words, the shapes of words (runs of a kind of
    byte once) and pairs of neighbouring shapes.
    """
    texts = Texts(data, offsets)
    n, doc = len(texts.start), texts.doc
    hashes = RollingHash(data)(texts.start, texts.end)
    kind = KIND[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[texts.start] = True
    # Shapes: the kinds where they change.
    at = np.cumsum(change)
    kinds = kind[change]
    shapes = RollingHash(kinds)(at[texts.start] - 1, at[texts.end - 1]) if n else hashes
    with np.errstate(over="ignore"):
        shapes = mix(shapes + np.uint64(1))
        same = doc[1:] == doc[:-1]
        pairs = [mix(h[:-1] * np.uint64(3) + h[1:])[same] for h in (hashes, shapes)]
    docs = [doc, doc, doc[1:][same], doc[1:][same]]
    feature = np.concatenate([hashes, shapes, *pairs]) >> np.uint64(64 - features_log2)
    key = np.unique(np.concatenate(docs).astype(np.int64) << features_log2 | feature.astype(np.int64))
    return (key & ((1 << features_log2) - 1)).astype(np.int32), np.searchsorted(key, np.arange(len(texts) + 1) << features_log2)


def train(column: pa.Array, y: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Per feature, ratio times hinge-loss weight and the ratio's square; the logistic curve's slope and offset."""
    size = 1 << settings.features_log2
    if len(set(y.tolist())) < 2:
        return np.zeros(size, np.float32), np.zeros(size, np.float32), 1.0, float(y.mean() * 8 - 4) if len(y) else 0.0
    rows: list[np.ndarray] = []
    for _, _, data, offsets in chunks(column, 1 << 20):
        feature, first = indicators(data, offsets, settings.features_log2)
        rows += np.split(feature, first[1:-1])
    count = np.full((2, size), settings.smoothing)
    for row, label in zip(rows, y):
        count[label, row] += 1
    count /= count.sum(axis=1, keepdims=True)
    ratio = np.log(count[1] / count[0]).astype(np.float32)
    # Rows are scaled to unit length, so that texts of any length have margins of one size.
    sign = np.where(y == 1, 1.0, -1.0)
    values = []
    for row in rows:
        v = ratio[row]
        values.append(v / (float(np.sqrt((v * v).sum())) or 1.0))
    cost = settings.cost * len(y) / 2 / np.bincount(y, minlength=2)  # classes weigh the same
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(y))
    rng = np.random.default_rng(11)
    for _ in range(settings.epochs):
        for i in rng.permutation(len(y)):
            row, v = rows[i], values[i]
            gradient = sign[i] * (w[row] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / 2, 0.0), cost[y[i]])  # squared norm: 1, and 1 for the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[row] += step * v
                bias += step
                alpha[i] = new
    margin = np.array([w[row] @ v for row, v in zip(rows, values)]) + bias
    slope, offset = _logistic(margin, y)
    return (w * ratio).astype(np.float32), ratio * ratio, slope, offset + slope * bias


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margins to classes of equal weight, by Newton's steps."""
    weight = (len(y) / 2 / np.bincount(y, minlength=2))[y]
    target = np.where(y == 1, 1 - 1e-2, 1e-2)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = weight * (p - target)
        h = weight * p * (1 - p) + 1e-9
        hessian = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, np.array([(g * margin).sum(), g.sum()]))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def score_texts(column: pa.Array, weight: np.ndarray, ratio_square: np.ndarray, slope: float, offset: float) -> np.ndarray:
    """The score of every text."""
    margin = np.zeros(len(column))
    size_log2 = len(weight).bit_length() - 1
    for i, j, data, offsets in chunks(column):
        feature, first = indicators(data, offsets, size_log2)
        sums = np.stack([np.concatenate((np.zeros(1), np.cumsum(v[feature], dtype=float))) for v in (weight, ratio_square)])
        product, square = np.diff(sums[:, first], axis=1)
        margin[i:j] = product / np.sqrt(np.where(square > 1e-12, square, 1.0))
    return 1 / (1 + np.exp(-np.clip(slope * margin + offset, -60, 60)))


def score_quality(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, parts: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted.

    Labels are learned from documents outside the held-out fold, crc32(doc_id as
    text) mod parts = held; at most settings.per_class of each class, those of
    the least hash, up to the one that brings the class to settings.class_bytes.
    Labels of one class only, or none, give all texts one score.  Null, empty and
    blank texts have no features: their score is that of the curve's offset.  A
    text of any length is scored whole; a score that ties with the threshold is
    predicted 1.  Repeated rows get equal scores; other columns are not
    read.  An empty table gives an empty table.
    """
    settings = settings or Settings()
    learn = fold(F.col("doc_id"), parts) != held
    rows = labelled_rows(docs, labels, "quality", learn, settings.per_class, settings.class_bytes)
    trained = fitted(rows, "y", lambda texts, y: train(texts, np.array(y, np.int64), settings))
    model = docs.sparkSession.sparkContext.broadcast(trained)  # 2**features_log2 pairs of floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_texts(batch.column(1), *model.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, score double")
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), parts) == held).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
