"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's bag holds the n-grams of its bytes between word marks, and the word
itself, each hashed to one of the rows of an embedding table.  Averages over the
bags of a few neighbouring words go through a linear softmax of two classes;
a text is as toxic as the worst of its windows.  Embeddings and softmax are
trained together in numpy, first on the words of labelled documents, then on
each document's worst window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.llm.sample import fitted, fold, labelled_rows
from mergeloom.llm.text import LOWER, SPACE, RollingHash, Texts, chunks, gather, trim, trimmed

#: Bytes that end a word: white space and marks.
ENDS = SPACE.copy()
ENDS[list(b'.,;:!?"()[]|')] = True
NGRAMS = (3, 4, 5, 6)


@dataclass
class Settings:
    buckets_log2: int = 18
    dim: int = 8
    window: int = 3
    word_epochs: int = 6
    #: Steps on words, at least; a small sample is gone through more often.
    least_steps: int = 120
    window_epochs: int = 60
    #: Words of fewer documents teach no class by themselves.
    least_docs: int = 3
    #: Worst windows of each document of class 0 and of class 1 that are trained on.
    worst: tuple[int, int] = (4, 2)
    rate: float = 0.05
    #: Bounds of the labelled sample, of each class: documents, and bytes at which it ends.
    per_class: int = 4000
    class_bytes: int = 24_000_000


def subwords(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, buckets_log2: int, ngrams: tuple[int, ...] = NGRAMS
) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's bag, word by word, and where each bag begins."""
    marked, offsets = gather(data, start, end, b"<", b">")
    rolled = RollingHash(marked)
    words, starts, ends = [np.arange(len(start))], [offsets[:-1]], [offsets[1:]]
    length = np.diff(offsets)
    for n in ngrams:
        count = np.maximum(length - n + 1, 0)
        count[length == n] = 0  # that is the word itself
        first = np.repeat(offsets[:-1] - np.concatenate((np.zeros(1, np.int64), np.cumsum(count)[:-1])), count) if len(count) else count
        at = first + np.arange(count.sum())
        words.append(np.repeat(np.arange(len(start)), count))
        starts.append(at)
        ends.append(at + n)
    word = np.concatenate(words).astype(np.int32)
    bucket = (rolled(np.concatenate(starts), np.concatenate(ends)) >> np.uint64(64 - buckets_log2)).astype(np.int32)
    order = np.argsort(word, kind="stable")
    return bucket[order], np.searchsorted(word[order], np.arange(len(start) + 1))


def bag_means(values: np.ndarray, bucket: np.ndarray, first: np.ndarray, together: int = 1 << 20) -> np.ndarray:
    """The mean of values over each bag, some bags at a time; no bag is empty."""
    out = np.empty((len(first) - 1, *values.shape[1:]), values.dtype)
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(first, first[i] + together, side="right")) - 1)
        sums = np.add.reduceat(values[bucket[first[i] : first[j]]], first[i:j] - first[i], axis=0)
        out[i:j] = sums / np.diff(first[i : j + 1]).reshape(-1, *[1] * (values.ndim - 1))
        i = j
    return out


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts one after another; each is let go once it is copied."""
    out = np.empty(sum(map(len, parts)), parts[0].dtype if parts else np.int32)
    end = len(out)
    while parts:
        part = parts.pop()
        out[end - len(part) : end] = part
        end -= len(part)
    return out


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.state = rate, 0, {}

    def __call__(self, name: str, value: np.ndarray, gradient: np.ndarray) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (gradient - m)
        v += 0.001 * (gradient * gradient - v)
        scale = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        value -= self.rate * scale * m / (np.sqrt(v) + 1e-8)


def train(column: pa.Array, y: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """The margin that each bucket adds to class 1 over class 0 (its embedding times the softmax), and the bias."""
    s, size = settings, 1 << settings.buckets_log2
    if len(set(y.tolist())) < 2:
        return np.zeros(size, np.float32), -20.0
    # The sample's distinct words over all its chunks, and each document's words in order.
    at, hashes, data, spans, docs = 0, [], [], [], []
    for i, j, raw, offsets in chunks(column):
        texts = Texts(LOWER[raw], offsets, ENDS)
        h, one, which = texts.distinct()
        part, begin = gather(texts.data, texts.start[one], texts.end[one])
        data.append(part)
        spans.append(np.stack((begin[:-1] + at, begin[1:] + at)))
        at += len(part)
        hashes.append(h)
        which = which.astype(np.int32)
        docs += [(len(hashes) - 1, which[texts.first[k] : texts.first[k + 1]]) for k in range(j - i)]
    del column  # the caller has let go of the texts
    trim()
    data, spans = joined(data), np.concatenate(spans, axis=1)
    base = np.concatenate(([0], np.cumsum([len(h) for h in hashes])))
    _, one, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    which = which.astype(np.int32)
    docs = [which[base[c] : base[c + 1]][w] for c, w in docs]
    bags, first = [], [np.zeros(1, np.int64)]
    for i in range(0, len(one), 1 << 15):  # some words at a time: their n-grams take far more room than the bags
        part, begin = subwords(data, *spans[:, one[i : i + (1 << 15)]], s.buckets_log2)
        first.append(begin[1:] + first[-1][-1])
        bags.append(part)
    bucket, first = joined(bags), joined(first)
    del data, spans, hashes
    trim()
    seen = np.zeros((len(one), 2))
    for words, label in zip(docs, y):
        seen[np.unique(words), label] += 1
    common = np.flatnonzero(seen.sum(axis=1) >= s.least_docs)
    seen /= np.bincount(y, minlength=2)  # classes weigh the same
    weight = seen.sum(axis=1)
    share = seen[:, 1] / np.maximum(weight, 1e-12)
    weight = weight / weight.mean()
    common = common if len(common) else np.arange(len(one))

    rng = np.random.default_rng(7)
    table = rng.normal(0, 0.1, (size, s.dim)).astype(np.float32)
    softmax = rng.normal(0, 0.3, (s.dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    adam = _Adam(s.rate)

    def step(rows: np.ndarray, groups: np.ndarray, target: np.ndarray, weights: np.ndarray) -> None:
        """One step on windows: words ``rows`` are window groups[0] to groups[1], and so on."""
        length = first[rows + 1] - first[rows]
        cut = np.concatenate((np.zeros(1, np.int64), np.cumsum(length)))
        item = bucket[np.repeat(first[rows] - cut[:-1], length) + np.arange(cut[-1])]
        words = np.add.reduceat(table[item], cut[:-1], axis=0) / length[:, None]
        n = np.diff(groups)
        mean = np.add.reduceat(words, groups[:-1], axis=0) / n[:, None]
        logits = mean @ softmax + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - np.stack((1 - target, target), axis=1)) * (weights / weights.sum())[:, None]
        to_mean = (g @ softmax.T) / n[:, None]
        to_word = np.repeat(to_mean, n, axis=0) / length[:, None]
        to_table = np.empty_like(table)
        for k in range(s.dim):
            to_table[:, k] = np.bincount(item, np.repeat(to_word[:, k], length), size)
        adam.t += 1
        adam("softmax", softmax, (mean.T @ g).astype(np.float32))
        adam("bias", bias, g.sum(axis=0).astype(np.float32))
        adam("table", table, to_table)

    batch = min(max(len(common) // 16, 64), 16384)
    for _ in range(max(s.word_epochs, -(-s.least_steps * batch // len(common)))):
        order = rng.permutation(common)
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            step(rows, np.arange(len(rows) + 1), share[rows], weight[rows])

    def margins() -> tuple[np.ndarray, float]:
        return table @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0])

    balanced = (len(y) / 2 / np.bincount(y, minlength=2))[y]
    full = [k for k, words in enumerate(docs) if len(words)]
    trim()
    for _ in range(s.window_epochs):
        word_margin = bag_means(margins()[0], bucket, first)
        rows, groups, target, weights = [], [0], [], []
        for k in full:
            words, most = docs[k], s.worst[y[k]]
            n = min(s.window, len(words))
            sums = np.cumsum(np.concatenate(([0.0], word_margin[words])))
            mean = sums[n:] - sums[:-n]
            worst = np.argpartition(mean, -most)[-most:] if len(mean) > most else np.arange(len(mean))
            for begin in worst:
                rows.append(words[begin : begin + n])
                groups.append(groups[-1] + n)
                target.append(y[k])
                weights.append(balanced[k] / len(worst))
        step(np.concatenate(rows), np.array(groups), np.array(target, float), np.array(weights))
    per_bucket, b = margins()
    return per_bucket.astype(np.float32), b


def score_texts(column: pa.Array, per_bucket: np.ndarray, bias: float, window: int) -> np.ndarray:
    """The softmax of class 1 in the worst window; a text without words has that of an empty average."""
    out = np.full(len(column), bias)
    size_log2 = len(per_bucket).bit_length() - 1
    for i, j, raw, offsets in chunks(column):
        texts = Texts(LOWER[raw], offsets, ENDS)
        if not len(texts.start):
            continue
        _, one, which = texts.distinct()
        words = bag_means(per_bucket, *subwords(texts.data, texts.start[one], texts.end[one], size_log2))[which].astype(float)
        sums = np.concatenate((np.zeros(1), np.cumsum(words)))
        # A window at each word, shorter only if the text is.
        n = np.diff(texts.first)
        length = np.minimum(window, n)[texts.doc]
        begin = np.minimum(np.arange(len(words)), texts.first[1:][texts.doc] - length)
        mean = (sums[begin + length] - sums[begin]) / length
        full = np.flatnonzero(n)
        out[i + full] += np.maximum.reduceat(mean, texts.first[:-1][full])
    return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def learned(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings) -> tuple[np.ndarray, float]:
    """What train() gives for the labelled sample."""
    rows = labelled_rows(docs, labels, "toxic", learn, settings.per_class, settings.class_bytes)
    return fitted(rows, "y", lambda texts, y: train(texts, np.array(y, np.int64), settings))


def score_toxicity(docs: DataFrame, labels: DataFrame, source: DataFrame | None = None, settings: Settings | None = None,
                   parts: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted.

    Labels are learned from documents of ``source`` (docs itself by default)
    outside the held-out fold, crc32(doc_id as text) mod parts = held; at most
    settings.per_class of each class, those of the least hash, up to the one that
    brings the class to settings.class_bytes.  With labels of one class only, or
    none, every score is 0, nearly.  Null, empty and blank texts are averages of
    nothing: they get the score of the bias.  A text of any length is scored
    whole, in all its windows; if several tie for the worst, the score is theirs.  Repeated
    rows get equal scores; other columns are not read.  An empty table gives an
    empty table.
    """
    settings = settings or Settings()
    learn = fold(F.col("doc_id"), parts) != held
    per_bucket, bias = learned(docs if source is None else source, labels, learn, settings)
    model = docs.sparkSession.sparkContext.broadcast((per_bucket, bias))  # 2**buckets_log2 floats, whatever the corpus
    window = settings.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_texts(batch.column(1), *model.value, window)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, score double")
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), parts) == held).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_civil(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs that are not predicted toxic, with all their columns; scored where they stand, without a join."""
    settings = options.pop("settings", None) or Settings()
    threshold = options.pop("threshold", 0.7)
    parts, held = options.pop("parts", 3), options.pop("held", 1)
    learn = fold(F.col("doc_id"), parts) != held
    per_bucket, bias = learned(docs, labels, learn, settings)
    model = docs.sparkSession.sparkContext.broadcast((per_bucket, bias))
    window, at = settings.window, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_texts(batch.column(at), *model.value, window)
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(trimmed(run), docs.schema)
