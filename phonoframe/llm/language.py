"""Language identification: the family first, then one-versus-one linear support vector machines."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import cut, over_texts, small, whole

#: Language codes by family. Others form a family of their own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tt"),
    "indic": ("hi", "bn", "ur", "mr", "gu", "pa", "ne", "si"),
    "semitic": ("ar", "he", "am", "mt"),
}
#: Rows of each language that are learned from, at most; hashed features.
ROWS_PER_LANGUAGE, DIMENSIONS = 400, 1 << 12
UNKNOWN = "und"


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def features(text: str) -> np.ndarray:
    """The hashed places of the byte trigrams of the lower-cased text; a space is put at both ends."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(20)


def frequencies(text: str) -> np.ndarray:
    """The share of each feature in the text."""
    at = features(text)
    return np.bincount(at, minlength=DIMENSIONS) / len(at)


def svm(x: np.ndarray, y: np.ndarray, rounds: int = 150, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss (y is 1 or -1), by accelerated descent."""
    x1 = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)  # both sides count alike
    step = np.float32(1.0 / (2 * float(share @ np.square(x1).sum(axis=1)) + penalty))
    w, before = np.zeros(x1.shape[1], np.float32), np.zeros(x1.shape[1], np.float32)
    for t in range(rounds):
        ahead = w + np.float32(t / (t + 3)) * (w - before)
        slack = np.maximum(0, 1 - y * (x1 @ ahead))
        grad = -2 * (x1.T @ (share * y * slack)) + np.float32(penalty) * ahead
        before, w = w, ahead - step * grad
    return w[:-1], float(w[-1])


@dataclass
class Machines:
    """One-versus-one machines between names: rows of weights, biases, and the pair of each."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray

    def pick(self, at: np.ndarray) -> tuple[str, float]:
        """The name with most votes, then the largest margins; and how sure that is, from 0 to 1."""
        if len(self.names) == 1:
            return self.names[0], 1.0
        margin = self.weights[:, at].mean(axis=1) + self.bias
        votes, total, sure = np.zeros(len(self.names)), np.zeros(len(self.names)), np.ones(len(self.names))
        for m, (a, b) in zip(margin, self.pairs, strict=True):
            p = 1 / (1 + np.exp(-4 * np.clip(m, -9, 9)))
            votes[a if m >= 0 else b] += 1
            total[a] += m
            total[b] -= m
            sure[a], sure[b] = min(sure[a], p), min(sure[b], 1 - p)
        best = max(range(len(self.names)), key=lambda i: (votes[i], total[i]))
        return self.names[best], float(sure[best])


#: A text's features: their places, ascending, and their shares.
Sparse = tuple[np.ndarray, np.ndarray]


def dense(rows: list[Sparse]) -> np.ndarray:
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, (place, share) in enumerate(rows):
        x[i, place] = share
    return x


def _machines(rows: list[Sparse], of: list[str]) -> Machines:
    """Only the rows of one pair of names are held as whole vectors at a time."""
    names = sorted(set(of))
    pairs, weights, bias = list(itertools.combinations(range(len(names)), 2)), [], []
    total = np.zeros(DIMENSIONS)
    for place, share in rows:
        total[place] += share
    scale = (1 / np.sqrt(total / max(1, len(rows)) + 1e-5)).astype(np.float32)
    for a, b in pairs:
        chosen = [i for i, n in enumerate(of) if n in (names[a], names[b])]
        w, c = svm(dense([rows[i] for i in chosen]) * scale, np.array([1.0 if of[i] == names[a] else -1.0 for i in chosen]))
        weights.append(w * scale)
        bias.append(c)
    return Machines(names, pairs, np.array(weights, np.float32).reshape(len(pairs), DIMENSIONS), np.array(bias))


@dataclass
class Model:
    families: Machines
    within: dict[str, Machines]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        at = features(text)
        f, p = self.families.pick(at)
        lang, q = self.within[f].pick(at)
        return lang, p * q


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model | None:
    """From (lang, places, shares) rows; None if there are none."""
    if not rows:
        return None
    langs, x = [r[0] for r in rows], [(r[1], r[2]) for r in rows]
    of = [family(g) for g in langs]
    own = {f: [i for i, g in enumerate(of) if g == f] for f in sorted(set(of))}
    within = {f: _machines([x[i] for i in at], [langs[i] for i in at]) for f, at in own.items()}
    return Model(_machines(x, of), within)


def training_rows(docs: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = ROWS_PER_LANGUAGE) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, places, shares) of ``per_language`` rows of each language at most, chosen by a hash of key and text.

    Every language has its own share, from counts over all rows; rows equal in key and text count once. Texts are used
    whole and become features in the tasks, so that what comes back is bounded, whatever the keys are.
    """
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    usable = docs.filter(learn_from & F.col(lang).isNotNull() & lettered).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(key, text, F.lit("sample")).alias("draw"))
    counts = docs.filter(learn_from & F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count(text).alias("n"))
    counts = small(cut(counts))
    share = F.lit(2.0 * per_language) / F.greatest("n", F.lit(1))  # twice what is wanted, of which the least hashes stay
    drawn = usable.join(counts, "lang").filter(F.pmod("draw", F.lit(1 << 30)) < share * (1 << 30))
    drawn = drawn.groupBy("lang", "draw").agg(F.min("text").alias("text"))
    place = F.row_number().over(W.Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1 << 30)), "draw"))
    chosen = drawn.withColumn("place", place).filter(F.col("place") <= per_language)

    def sparse(text: str) -> tuple[list[int], list[float]]:
        f = frequencies(text)
        at = np.flatnonzero(f)
        return at.tolist(), f[at].tolist()

    of = over_texts("place array<int>, share array<float>", lambda: lambda texts: list(map(sparse, texts)))
    rows = chosen.select("lang", "place", of("text").alias("f")).collect()
    return [(r["lang"], np.array(r["f"]["place"], np.int64), np.array(r["f"]["share"], np.float32)) for r in sorted(rows, key=lambda r: (r["lang"], r["place"]))]


def predictions(docs: DataFrame, model: Model | None, text: str = "text") -> Column:
    """A struct (lang, score) for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value
        return lambda texts: [m.predict(t) if m else (UNKNOWN, 0.0) for t in texts]

    return over_texts("lang string, score double", start)(whole(text))


def held_out(key: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score) for every row of ``docs``.

    Learns from rows that aren't held out and have a language. A null text, or one without a letter, is
    ``und`` with score 0; so is every text if there is nothing to learn from. A null key isn't held out. Ties go to the
    first name in order. Repeated rows give one row each; other columns are ignored, an empty table gives no rows.
    """
    model = fit(training_rows(docs, ~held_out(key), key, text, lang))
    done = docs.select(F.col(key), held_out(key).alias("held_out"), predictions(docs, model, text).alias("p"))
    return done.select(key, "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
