"""Language ID by a linear-chain conditional random field over words.

A word's features are the n-grams of its bytes between word marks (those that
touch a mark are its affixes), and the word itself as an entry of the lexicon,
all hashed.  Weights of features and of transitions between the languages of
neighbouring words are learned together by gradients from forward-backward, on
code-switched sequences spliced from texts of known language.  A text's words
are labelled by forward-backward; its language is that with most of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.llm.sample import bounded, fitted, fold
from mergeloom.llm.text import LOWER, Texts, chunks, gather, trimmed
from mergeloom.llm.toxicity import ENDS, _Adam, bag_means, subwords

NGRAMS = (2, 3, 4)
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
#: More values than these name no languages: transitions between them alone would be too large a model.
MOST_LANGUAGES = 4096
#: Weights of features, over all languages, that a model holds at most.
MOST_WEIGHTS = 1 << 24


@dataclass
class Settings:
    features_log2: int = 17
    steps: int = 250
    batch: int = 96
    length: int = 48
    #: Mean words from one splice to the next.
    splice: int = 12
    rate: float = 0.1
    #: Bounds of the sample, of each language: texts, and bytes at which it ends.
    per_language: int = 600
    language_bytes: int = 8_000_000


def fold_case(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1, in UTF-8, to lower case."""
    out = LOWER[data]
    if len(out) > 1:
        capital = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def _scaled(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def forward_backward(emission: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray, segment: int = 512) -> np.ndarray:
    """Marginals of each word's label.

    emission: positive factors, words x labels; sequences are first[i] to
    first[i + 1].  move: factors from label to label; start: of the first label.

    All sequences take each step together.  Long ones take it in several places
    at once: the steps of a segment are multiplied to one matrix, which carries
    alpha over the segment forwards and beta backwards, so each segment knows
    what enters it from either side.  That is exact, whatever ``segment``.
    """
    n, labels = np.diff(first), emission.shape[1]
    parts = np.maximum(-(-n // segment), 1)
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(parts)))  # of the first segment of each sequence
    nth = np.arange(at[-1]) - np.repeat(at[:-1], parts)
    begin = np.repeat(first[:-1], parts) + nth * segment
    length = np.minimum(begin + segment, np.repeat(first[1:], parts)) - begin
    order = np.argsort(-length, kind="stable")
    steps = int(length.max(initial=0))
    active = np.searchsorted(-length[order], -np.arange(steps), side="left")  # segments longer than t

    enter = np.ones((len(begin), labels))  # alpha of the word before each segment, of its sequence
    leave = np.ones((len(begin), labels))  # beta of its last word
    several = np.flatnonzero(parts > 1)
    if len(several):
        # Alpha over first segments, as below, and the matrices of the others.
        over = np.broadcast_to(np.eye(labels), (len(begin), labels, labels)).copy()
        some = (parts > 1)[np.repeat(np.arange(len(n)), parts)]
        heads = at[:-1][several]
        alpha = _scaled(emission[begin[heads]] * start, (1,))
        for t in range(1, segment):
            alpha = _scaled(emission[begin[heads] + t] * (alpha @ move), (1,))
        for t in range(steps):
            live = order[: active[t]]
            live = live[some[live] & (nth[live] > 0)]
            if len(live):
                over[live] = _scaled((over[live] @ move) * emission[begin[live] + t][:, None, :], (1, 2))
        enter[heads + 1] = alpha
        for k in range(2, int(parts.max())):
            on = at[:-1][parts > k] + k
            enter[on] = _scaled((enter[on - 1][:, None, :] @ over[on - 1])[:, 0], (1,))
        for k in range(int(parts.max()) - 2, -1, -1):
            on = at[:-1][parts > k + 1] + k
            leave[on] = _scaled((over[on + 1] @ leave[on + 1][:, :, None])[:, :, 0], (1,))

    out_alpha, out_beta = np.empty_like(emission), np.empty_like(emission)
    head = (nth == 0)[order][:, None]
    before = enter[order] @ move
    for t in range(steps):
        k = active[t]
        word = begin[order[:k]] + t
        now = emission[word] * (np.where(head[:k], start, before[:k]) if not t else out_alpha[word - 1] @ move)
        out_alpha[word] = _scaled(now, (1,))
    last = begin + length - 1
    held = length > 0
    out_beta[last[held]] = leave[held]
    for t in range(steps - 2, -1, -1):
        word = begin[order[: active[t + 1]]] + t
        out_beta[word] = _scaled((emission[word + 1] * out_beta[word + 1]) @ move.T, (1,))
    out = out_alpha * out_beta
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)


def expected_moves(alpha: np.ndarray, beta: np.ndarray, emission: np.ndarray, move: np.ndarray) -> np.ndarray:
    """How often each label is expected to follow each, over all neighbours of sequences x words x labels."""
    go = alpha[:, :-1].reshape(-1, len(move))
    come = (emission * beta)[:, 1:].reshape(-1, len(move))
    return move * ((go / ((go @ move) * come).sum(axis=1, keepdims=True)).T @ come)


def train(column: pa.Array, y: np.ndarray, labels: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights: features x labels, transitions, and those of the first word."""
    weights = np.zeros((1 << s.features_log2, labels), np.float32)
    move, start = np.zeros((labels, labels), np.float32), np.zeros(labels, np.float32)
    if not len(column):
        return weights, move, start
    bags, firsts, documents, at = [], [np.zeros(1, np.int64)], [], 0
    for i, j, raw, offsets in chunks(column, 1 << 20):
        texts = Texts(fold_case(raw), offsets, ENDS)
        _, one, which = texts.distinct()
        bucket, first = subwords(texts.data, texts.start[one], texts.end[one], s.features_log2, NGRAMS)
        bags.append(bucket)
        firsts.append(first[1:] + firsts[-1][-1])
        which = (which + at).astype(np.int32)
        at += len(one)
        documents += [which[texts.first[k] : texts.first[k + 1]] for k in range(j - i)]
    bucket, first = np.concatenate(bags), np.concatenate(firsts)
    of_label = [[d for d, label in zip(documents, y) if label == k and len(d)] for k in range(labels)]
    spoken = [k for k in range(labels) if of_label[k]]
    if len(spoken) < 2:
        return weights, move, start
    rng = np.random.default_rng(5)
    adam = _Adam(s.rate)
    for step in range(s.steps):
        adam.rate = s.rate * (1 - step / s.steps)
        words, gold = [], []
        for _ in range(s.batch):
            row, line = [], []
            while len(row) < s.length:
                k = spoken[rng.integers(len(spoken))]
                text = of_label[k][rng.integers(len(of_label[k]))]
                n = min(int(rng.geometric(1 / s.splice)), s.length - len(row), len(text))
                cut = rng.integers(len(text) - n + 1)
                row += text[cut : cut + n].tolist()
                line += [k] * n
            words.append(row)
            gold.append(line)
        words, gold = np.array(words), np.array(gold)
        rows, inverse = np.unique(words, return_inverse=True)
        n = first[rows + 1] - first[rows]
        cut = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        item = bucket[np.repeat(first[rows] - cut[:-1], n) + np.arange(cut[-1])]
        score = (np.add.reduceat(weights[item], cut[:-1], axis=0) / n[:, None])[inverse.reshape(words.shape)]
        emission = np.exp(score - score.max(axis=2, keepdims=True)).astype(float)
        factor, first_factor = np.exp(move.astype(float)), np.exp(start.astype(float))
        alpha, beta = np.empty_like(emission), np.ones_like(emission)
        for t in range(s.length):
            now = emission[:, t] * (first_factor if not t else alpha[:, t - 1] @ factor)
            alpha[:, t] = now / now.sum(axis=1, keepdims=True)
        for t in range(s.length - 2, -1, -1):
            now = (emission[:, t + 1] * beta[:, t + 1]) @ factor.T
            beta[:, t] = now / now.sum(axis=1, keepdims=True)
        marginal = alpha * beta
        marginal /= marginal.sum(axis=2, keepdims=True)
        pair = expected_moves(alpha, beta, emission, factor)
        truth = np.eye(labels)[gold]
        g = (marginal - truth) / words.size
        seen = np.einsum("bti,btj->ij", truth[:, :-1], truth[:, 1:])
        to_word = np.stack([np.bincount(inverse.ravel(), g[..., k].ravel(), len(rows)) for k in range(labels)], axis=1) / n[:, None]
        to_weights = np.stack([np.bincount(item, np.repeat(to_word[:, k], n), len(weights)) for k in range(labels)], axis=1)
        adam.t += 1
        adam("weights", weights, to_weights.astype(np.float32) * 100)
        adam("move", move, ((pair - seen) / words.size).astype(np.float32))
        adam("start", start, (marginal[:, 0] - truth[:, 0]).mean(axis=0).astype(np.float32))
    return weights, move, start


def label_words(texts: Texts, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Marginals, words x languages, of the words of some whole texts (case folded)."""
    weights, move, start = model
    _, one, which = texts.distinct()
    bucket, first = subwords(texts.data, texts.start[one], texts.end[one], len(weights).bit_length() - 1, NGRAMS)
    score = bag_means(weights, bucket, first).astype(np.float64)
    emission = np.exp(score - score.max(axis=1, keepdims=True)) if len(score) else np.zeros((0, weights.shape[1]))
    return forward_backward(emission[which], texts.first, np.exp(move.astype(float)), np.exp(start.astype(float)))


def predict(column: pa.Array, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The label with most of each text's words, -1 if the text has no letter; and its share of them."""
    label, share = np.full(len(column), -1), np.zeros(len(column))
    for i, j, raw, offsets in chunks(column):
        data = fold_case(raw)
        texts = Texts(data, offsets, ENDS)
        lettered = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data >= 97) & (data <= 122), out=lettered[1:])
        plain = lettered[offsets[1:]] > lettered[offsets[:-1]]
        for t in np.flatnonzero(~plain & (np.diff(offsets) > 0)):
            plain[t] = bool(_LETTER.search(raw[offsets[t] : offsets[t + 1]].tobytes().decode()))
        if not len(texts.start):
            continue
        marginal = label_words(texts, model)
        # Words with a letter count; in texts whose letters are all beyond ASCII, those with such a byte.
        high = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data >= 128) | ((data >= 97) & (data <= 122)), out=high[1:])
        marginal = marginal * (high[texts.end] > high[texts.start])[:, None]
        sums = np.concatenate((np.zeros((1, marginal.shape[1])), np.cumsum(marginal, axis=0)))
        mass = sums[texts.first[1:]] - sums[texts.first[:-1]]
        best = mass.argmax(axis=1)
        total = mass.sum(axis=1)
        top = mass[np.arange(len(best)), best] / np.maximum(total, 1e-300)
        label[i:j] = np.where(plain, best, -1)
        share[i:j] = np.where(plain, np.clip(top, 0, 1), 0)
    return label, share


def known_texts(docs: DataFrame, learn: Column, settings: Settings) -> tuple[DataFrame | None, list[str]]:
    """Texts of known language, as bounded() gives them, about per_language documents of each by their hash; and the languages."""
    known = docs.where(learn & F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    if not counts:
        return None, []
    shares = known.sparkSession.createDataFrame([(k, settings.per_language / n) for k, n in counts.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    drawn = known.join(F.broadcast(shares), "lang").where(draw < F.col("share"))  # MOST_LANGUAGES rows
    return bounded(drawn, "lang", settings.language_bytes), sorted(counts)


def sized(settings: Settings, languages: int) -> Settings:
    return replace(settings, features_log2=min(settings.features_log2, (MOST_WEIGHTS // languages).bit_length() - 1))


def identify_languages(docs: DataFrame, settings: Settings | None = None, parts: int = 4, held: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (the share of its words in that language).

    Learned from text and lang of documents outside the held-out fold,
    crc32(doc_id as text) mod parts = held, where lang is not null: about
    settings.per_language of each language, those of the least hash, up to the
    one that brings the language to settings.language_bytes.  A text that is null
    or has no letter is ``und`` with score 0, as is every text if no language is
    known.  A text of any length is labelled whole; of languages with equal shares
    of its words the first in code-point order is named.  Repeated rows get equal
    results; other columns are not read.  An empty table gives an empty table.
    Over MOST_LANGUAGES different values of lang are an error; a model of many
    languages has fewer features, MOST_WEIGHTS weights in all.
    """
    settings = settings or Settings()
    sample, names = known_texts(docs, fold(F.col("doc_id"), parts) != held, settings)
    own = sized(settings, max(1, len(names)))
    trained = fitted(sample, "lang", lambda texts, lang: train(texts, np.searchsorted(np.array(names), lang), len(names), own)) if names else None
    model = docs.sparkSession.sparkContext.broadcast((trained, names))  # 2**features_log2 rows of a float for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, languages = model.value
        for batch in batches:
            label, share = predict(batch.column(1), weights) if languages else (np.full(batch.num_rows, -1), np.zeros(batch.num_rows))
            named = pa.array([*languages, UNDETERMINED]).take(pa.array(np.where(label < 0, len(languages), label)))
            yield pa.RecordBatch.from_arrays([batch.column(0), named, pa.array(share)], ["doc_id", "lang_pred", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "lang_pred", "score")
