"""Quality rules: statistics of texts, and decision lists learned by sequential covering."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROWS_TO_PYTHON, columns_of, cut, over_texts, settings, whole

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_letters", "n_ends", "n_digits")
#: What rules set thresholds on: shares of what the statistics count.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "ends_per_word": ("n_ends", "n_words"),
    "digits_per_char": ("n_digits", "word_chars"),
    "dup_lines_per_word": ("n_dup_lines", "n_words"),
}
#: Labelled rows that a list is learned from, at most.
SAMPLE = 20_000
_UPPER = str.maketrans({c: None for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_SPACE = b" \t\n\r\x0b\x0c"


def text_statistics(text: str) -> tuple[int, ...]:
    """BASE and MORE of one text; words end at ASCII white space."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text) - sum(text.count(chr(c)) for c in _SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip(" \t\r\x0b\x0c"):
            seen.add(line)
    repeat = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    found = Counter(windows)
    if len(found) < len(windows):
        upto = 0  # words before here are counted
        for i, w in enumerate(windows):
            if found[w] > 1:
                repeat += i + 3 - max(i, upto)
                upto = i + 3
    upper = len(text) - len(text.translate(_UPPER)) if not text.isascii() else sum(map(data.count, (bytes([c]) for c in range(65, 91))))
    letters = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    ends = text.count("!") + text.count("?")
    digits = len(data) - len(data.translate(None, b"0123456789"))
    return n, chars, symbols, dup_lines, repeat, upper, letters, ends, digits


def statistics(docs: DataFrame, text: str = "text") -> Column:
    """A struct of BASE and MORE (long) for each whole text; a null text counts as empty."""
    of = over_texts(", ".join(f"{n} long" for n in (*BASE, *MORE)), lambda: lambda texts: list(map(text_statistics, texts)))
    return of(whole(text))


def base_failed(min_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def feature(name: str) -> Column:
    part, of = FEATURES[name]
    return F.col(part) / F.greatest(F.col(of), F.lit(1))


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return feature(self.name) >= self.threshold if self.above else feature(self.name) <= self.threshold

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.threshold if self.above else x[self.name] <= self.threshold


Rule = tuple[Test, ...]


def covered(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    return reduce(np.logical_and, (t.holds(x) for t in rule))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most_tests: int) -> Rule:
    """Add the test with the largest information gain until no good row is covered."""
    rule, inside = (), np.ones(len(bad), bool)
    while len(rule) < most_tests and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 1e-9
        for name, values in x.items():
            v, y = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            step = np.flatnonzero(v[1:] > v[:-1])
            for above in (True, False):
                pos = (y[::-1].cumsum()[::-1][step + 1] if above else y.cumsum()[step]).astype(float)
                size = (len(v) - 1 - step) if above else step + 1
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pos > 0, pos * (np.log2(pos / size) - np.log2(p / (p + n))), 0)
                if len(g) and g.max() > gain:
                    i = int(g.argmax())
                    best, gain = Test(name, above, float((v[step[i]] + v[step[i] + 1]) / 2)), g[i]
        if best is None:
            break
        rule, inside = (*rule, best), inside & best.holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop last tests while (bad - good) / (bad + good) on rows kept apart doesn't fall."""

    def worth(r: Rule) -> float:
        c = covered(r, x)
        return (2 * (c & bad).sum() - c.sum()) / c.sum() if c.any() else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.98, most_rules: int = 12, most_tests: int = 4, seed: int = 7) -> list[Rule]:
    """An ordered list of threshold conjunctions that mark bad rows.

    Rules are grown on two thirds of the rows and pruned on the rest; a rule is taken if nearly all it covers there
    is bad (``precision``), so that clean rows stay. Rows it covers are removed before the next one.
    """
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules and (left & bad).sum() >= 10:
        grow = rng.random(len(bad)) < 2 / 3
        a, b = left & grow, left & ~grow
        rule = _grow({k: v[a] for k, v in x.items()}, bad[a], most_tests)
        if not rule:
            break
        rule = _prune(rule, {k: v[b] for k, v in x.items()}, bad[b])
        hit = covered(rule, x)
        tested = hit & b
        if tested.sum() < 3 or (tested & bad).sum() < precision * tested.sum() or (hit & bad & left).sum() < precision * (hit & left).sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, **options) -> list[Rule]:
    """Rules from the labelled rows of ``docs`` that pass the base rules; label 1 is good.

    About ``sample`` labelled keys at most are taken, by a hash of the key. Of rows that share a
    key one counts.
    """
    wanted = labels.filter(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("label"))
    share = min(1.0, sample / max(1, wanted.count()))
    wanted = cut(wanted.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))))
    wanted = F.broadcast(wanted) if wanted.count() <= 2 * sample else wanted
    rows = docs.select(key, text).join(wanted, key).select(key, "label", statistics(docs, text).alias("s")).select(key, "label", "s.*")
    rows = rows.filter(~base_failed()).groupBy(key).agg(F.min(F.struct("label", *[feature(f).alias(f) for f in FEATURES])).alias("x")).select("x.*")
    with settings(docs.sparkSession, ROWS_TO_PYTHON):  # whole texts go to Python here
        rows = rows.toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")  # the order in which rows come doesn't matter
    return learn_rules({f: rows[f].to_numpy(float) for f in FEATURES}, (rows["label"] == 0).to_numpy(bool), **options)


def verdict(rules: list[Rule]) -> Column:
    """One conditional expression: the number of the first rule that fits, from 1; 0 for none."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = reduce(lambda a, b: a & b, (t.column() for t in rule))
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` with a struct _quality: BASE, base_failed, kept, rule."""
    counted = docs.select(F.struct(*columns_of(docs)).alias("_row"), statistics(docs, text).alias("_s")).select("_row", "_s.*")
    judged = counted.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    return judged.select("_row.*", F.struct(*BASE, "base_failed", "kept", "rule").alias("_quality"))


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, BASE, base_failed, kept, rule int) for every row of ``docs``.

    A null text has no words and fails. Without labels nothing is learned and only the base rules
    decide. Repeated rows give one row each; other columns are ignored.
    """
    return judge(docs.select(key, text), learn(docs, labels, key, text), text).select(key, "_quality.*")
