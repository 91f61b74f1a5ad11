"""Bradley-Terry quality scores: learned from preference pairs, cut at a quantile.

A pair is a document labelled 1 and one labelled 0; its probability of being the right way round is the logistic of
the difference of two scores, and a score is linear in the features. So the model is a logistic regression without
intercept on feature differences, fitted by Newton steps. Scores are then placed so that the quantile of the training
scores that equals the share of label 0 falls on 0.5.

Fitting takes at most ``max_rows`` labelled rows (the parameter bounds the driver: a row is ``len(FEATURES)`` numbers,
chosen by the hash of the id and so the same at every run) and ``pairs_per_row`` pairs for each row of the larger
class. Scoring is one pass over all whole texts, without a shuffle.

Defined results: a null or empty text has the features of no words and gets a score like any other; labels that are
null or neither 0 nor 1 are left out; an id labelled both ways counts for both; without rows of both labels every score
is 0.5.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.llm.common import map_rows, pick

FEATURES = (
    "log_words", "mean_word", "distinct_words", "echo_words", "top_word", "upper", "digits", "symbols", "bars", "marks",
    "stops", "other_punctuation", "long_words", "repeated_lines", "line_ends", "mean_line", "capital_words", "vowels",
    "repeated_pairs", "symbol_words", "echo_run",
)
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&|<>@^~=_+{}[]\\/"
VOWELS = b"aeiouAEIOU"
OTHER = b"\"'()-:;"


def features(text: bytes | None) -> list[float]:
    """``FEATURES`` of one text; shares are of bytes, words or lines."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = sum(map(len, words))
    count = lambda characters: (len(text) - len(text.translate(None, characters))) / size
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    echo = list(map(eq, words, words[1:]))
    run = best = 0
    if True in echo:
        for same in echo:
            run = run + 1 if same else 0
            best = max(best, run)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return [
        math.log(n), size / n, len(counts) / n, sum(echo) / n, max(counts.values()) / n, count(UPPER), count(DIGITS),
        count(SYMBOLS), text.count(b"|") / n, text.count(b"!") / n, (text.count(b".") + text.count(b",")) / n, count(OTHER),
        sum(len(w) > 20 for w in words) / n, 1 - len(set(lines)) / len(lines),
        sum(line.rstrip()[-1:] in b".!?" for line in lines) / len(lines), math.log(n / len(lines)),
        sum(w[:1].isupper() for w in words) / n, count(VOWELS), 1 - len(pairs) / max(n - 1, 1),
        sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:!?" for w in words) / n, best / n,
    ]


@dataclass(frozen=True)
class Model:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float
    spread: float

    def score(self, values: list[float]) -> float:
        """0 to 1; 0.5 at the threshold."""
        raw = sum(w * max(-8.0, min(8.0, (v - m) / s)) for w, v, m, s in zip(self.weights, values, self.mean, self.scale))
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, (raw - self.threshold) / self.spread))))


def fit(values: np.ndarray, labels: np.ndarray, pairs_per_row: int = 4, penalty: float = 1e-3, steps: int = 25) -> Model:
    """Bradley-Terry weights and threshold of feature rows with labels 0 and 1."""
    width = len(FEATURES)
    good, bad = values[labels == 1], values[labels == 0]
    if not len(good) or not len(bad):
        return Model((0.0,) * width, (1.0,) * width, (0.0,) * width, 0.0, 1.0)
    mean, scale = values.mean(axis=0), values.std(axis=0)
    scale[scale < 1e-9] = 1.0
    good, bad = (np.clip((part - mean) / scale, -8, 8) for part in (good, bad))
    n = max(len(good), len(bad)) * pairs_per_row
    rng = np.random.default_rng(7)
    difference = good[rng.integers(0, len(good), n)] - bad[rng.integers(0, len(bad), n)]
    weights = np.zeros(width)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(difference @ weights, -30, 30)))  # probability of the wrong way round
        slope = difference.T @ p / n - penalty * weights
        bend = (difference * (p * (1 - p))[:, None]).T @ difference / n + penalty * np.eye(width)
        step = np.linalg.solve(bend, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    scores = np.concatenate([good, bad]) @ weights
    # The quantile that equals the share of label 0, midway between the two scores around it.
    ranked = np.sort(scores)
    threshold = (ranked[len(bad) - 1] + ranked[len(bad)]) / 2
    spread = max(float(scores.std()) / 4, 1e-6)
    return Model(*(tuple(float(v) for v in part) for part in (mean, scale, weights)), float(threshold), spread)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id",
                  held_out: str = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 1") -> DataFrame:
    """label and features of at most ``max_rows`` labelled rows outside the held-out fold, by the hash of the id.

    An id that comes again (in either table) gives several rows; the bound holds for rows.
    """
    marked = pick(labels, doc_id=label_id, label=label_col).filter(F.col("label").isin(0, 1)).filter(f"not ({held_out})")
    chosen = marked.dropDuplicates().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    texts = pick(docs, doc_id=id_col, text=text_col).selectExpr("doc_id", "cast(text as binary) text")
    joined = texts.join(F.broadcast(chosen), "doc_id")  # at most max_rows ids
    found = map_rows(joined.select("label", "doc_id", "text"), lambda label, doc_id, text: (int(label), doc_id, features(text)),
                     "label int, doc_id bigint, features array<double>")
    return found.orderBy(F.xxhash64("doc_id"), "doc_id", "label", F.xxhash64("features")).limit(max_rows).select("label", "features")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **columns: str) -> Model:
    rows = training_rows(docs, labels, max_rows, **columns).toPandas()
    if rows.empty:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    values = np.array(rows["features"].tolist(), dtype=float)
    order = np.lexsort((*values.T, rows["label"].to_numpy()))  # the same pairs however rows arrive
    return fit(values[order], rows["label"].to_numpy()[order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          held_out: str = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 1") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    plain = pick(docs, doc_id=id_col, text=text_col).selectExpr(
        "cast(doc_id as bigint) doc_id", f"coalesce({held_out}, false) held_out", "cast(text as binary) text")

    def judge(doc_id: int | None, out: bool, text: bytes | None) -> tuple:
        value = model.score(features(text))
        return doc_id, out, value, int(value >= 0.5)

    return map_rows(plain, judge, "doc_id bigint, held_out boolean, score double, predicted int")
