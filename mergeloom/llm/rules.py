"""Quality rules: text statistics and learned decision lists.

Statistics are DataFrame expressions.  A decision list is learned from labelled
statistics by sequential covering: grow a conjunction of thresholds that gains
most on one part of the sample, prune it on the other, keep it if it is precise
there, take away what it covers, and go on.  The rules become one ordered Spark
conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.llm.sample import fold, labelled_ids

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words of a window whose repetition counts.
WINDOW = 5


def _count_of(text: Column, letters: str) -> Column:
    """Characters of text in a regular expression's class, given without brackets."""
    return F.char_length(F.regexp_replace(text, f"[^{letters}]+", "")).cast("long")


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct, n_upper, n_marks and n_digits added.

    A null text counts as empty: all are 0.  n_lines are lines with a word, and
    n_dup_lines those equal to an earlier one.  n_repeat_words are the words
    within 5-word windows that occur twice or more in the text, the first
    occurrence included.  Columns so named are replaced, others pass.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_marks", "n_digits")
    base = docs.drop(*added).withColumn("__text", F.coalesce("text", F.lit("")))
    text = F.col("__text")
    base = base.withColumns({
        "__words": F.filter(F.split(text, SPACES, -1), lambda w: w != ""),
        "__lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    }).withColumns({"__hashes": F.transform("__words", lambda w: F.xxhash64(w)), "__n": F.size("__words")})
    h = F.col("__hashes")
    windows = F.when(
        F.col("__n") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.col("__n") - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(WINDOW)])),
    )
    base = base.withColumn("__windows", windows)
    # Only texts with a repeated window are sorted.
    again = F.size(F.array_distinct("__windows")) < F.size("__windows")
    ordered = F.when(again, F.sort_array(F.transform("__windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    base = base.withColumn("__ordered", ordered)
    o = F.col("__ordered")
    twin = F.filter(
        F.transform(o, lambda x, k: F.when(
            ((k > 0) & (F.get(o, k - 1)["h"] == x["h"])) | F.coalesce(F.get(o, k + 1)["h"] == x["h"], F.lit(False)), x["i"]
        )),
        lambda i: i.isNotNull(),
    )
    base = base.withColumn("__twins", F.when(o.isNotNull(), F.sort_array(twin)))
    # Windows begin at sorted places; each covers what lies before the next one begins.
    covered = F.aggregate(
        F.transform("__twins", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__twins"), k + 1) - i, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x,
    )
    statistics = F.struct(
        F.col("__n").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        _count_of(text, "#*$%&|<>").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("__hashes")).cast("long").alias("n_distinct"),
        _count_of(text, r"\p{Lu}").alias("n_upper"),
        _count_of(text, "!?").alias("n_marks"),
        _count_of(text, "0-9").alias("n_digits"),
    )
    # Out of a generator, so that filters on a statistic do not repeat the expressions above at each mention.
    return base.select(*docs.drop(*added).columns, F.inline(F.array(statistics)))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What rules may test: ratios of the statistics."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("n_distinct") / words,
        "upper_share": F.col("n_upper") / chars,
        "marks_per_word": F.col("n_marks") / words,
        "digit_share": F.col("n_digits") / chars,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= self.threshold if self.at_least else value <= self.threshold

    def test(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.at_least else x[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class DecisionList:
    """Conjunctions, tried in order; a text that meets one is rejected, what is left is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def kept(self) -> Column:
        out = None
        for rule in self.rules:
            met = F.lit(True)
            for condition in rule:
                met = met & condition.column()
            out = F.when(met, False) if out is None else out.when(met, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def __str__(self) -> str:
        return "\n".join(["reject if " + " and ".join(map(str, r)) for r in self.rules] + ["keep"])


def _covered(rule: list[Condition], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for condition in rule:
        out &= condition.test(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[Condition]:
    """Conditions of the greatest information gain, one after another, until only bad rows are covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < most and (inside & ~bad).any() and (inside & bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        best = (1e-9, None)
        for name, values in x.items():
            v, y = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1  # between unequal values
            if not len(cut):
                continue
            below_p = np.cumsum(y)[cut - 1]
            below_n = cut - below_p
            for at_least, cp, cn in ((True, p - below_p, n - below_n), (False, below_p, below_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(cp > 0, cp * (np.log2(cp / (cp + cn)) - np.log2(p / (p + n))), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], Condition(name, at_least, float(np.float64(f"{(v[cut[k]] + v[cut[k] - 1]) / 2:.6g}"))))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].test(x)
    return rule


def learn(
    x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least_bad: int = 3, max_rules: int = 16, max_conditions: int = 4
) -> DecisionList:
    """A decision list that rejects bad rows.

    Every third row prunes and judges, the others grow.  A rule is kept if at
    least ``precision`` of what it covers is bad, in either part, and it covers
    least_bad bad rows; the first one that is not ends the list.
    """
    rules: list[tuple[Condition, ...]] = []
    judge = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules and (left & bad & ~judge).any():
        part = lambda rows: ({k: v[rows] for k, v in x.items()}, bad[rows])
        rule = _grow(*part(left & ~judge), max_conditions)
        held, held_bad = part(left & judge)

        def worth(rule: list[Condition]) -> float:
            c = _covered(rule, held)
            return ((c & held_bad).sum() - (c & ~held_bad).sum()) / max(1, c.sum())

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if not rule:
            break
        c = _covered(rule, x) & left
        parts = [c & judge, c & ~judge]
        if (c & bad).sum() < least_bad or any((q & bad).sum() < precision * q.sum() for q in parts):
            break
        rules.append(tuple(rule))
        left &= ~c
    return DecisionList(tuple(rules))


def learn_quality_rules(docs: DataFrame, labels: DataFrame, per_class: int = 3000, parts: int = 5, held: int = 0, **options) -> DecisionList:
    """The list learned from the statistics of up to per_class labelled documents of each class, outside the held-out fold.

    Those that fail the base rules, which need no list, are left out.
    """
    ids = labelled_ids(labels, "quality", fold(F.col("doc_id"), parts) != held, per_class)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # 2 x per_class rows of two numbers
    names = list(features())
    rows = with_statistics(sample).where(~base_failed()).select("doc_id", "y", *[c.alias(k) for k, c in features().items()]).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["y"], *[r[k] for k in names]))
    x = {k: np.array([r[k] for r in rows], float) for k in names}
    return learn(x, np.array([r["y"] == 0 for r in rows], bool), **options)


def apply_rules(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """docs with their statistics, base_failed and kept added.

    base_failed: fewer than 10 words, or over 20 % of them in repeated windows.
    kept is false if base_failed, else what the list says.  Null and empty texts
    fail.  Repeated rows get equal results; an empty table gives an empty table.
    """
    out = with_statistics(docs).drop("base_failed", "kept").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & rules.kept())


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rules = learn_quality_rules(docs, labels)
    out = apply_rules(docs.select("doc_id", "text"), rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
