"""Language identification by unigram pieces, with all segmentations summed.

The pieces are those of a fixed public vocabulary. Each language has a probability for every piece; the probability of
a word in a language is the sum over all ways to cut it into pieces, by the forward algorithm, and a text's is the
product over its words. Probabilities are learned by expectation and maximisation: the forward-backward counts of the
training words, summed over Spark's partitions, become the next probabilities.

Learning reads at most ``max_rows`` rows of each language (chosen by the hash of the id, the same at every run), so that a
rare one is learned, too; what reaches the driver is one number per piece and language. Scoring is one pass over all whole texts, without a shuffle;
a word is scored once per worker and remembered.

Words are runs of letters in lower case. Characters outside the vocabulary cost the same in every language.

Defined results: text that is null or has no letter is ``und`` with score 0; without training rows every text is
``und``; ties go to the language that sorts first; rows with a null language or id are scored but never learned from.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaspark.llm.common import pick
from qaspark.session import materialize

VOCABULARY = "piece_bpe_32k.model"
WORDS = re.compile(r"[^\W\d_]+").findall
MARK = "▁"
HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"
UNDETERMINED = "und"
REMEMBERED = 250_000
#: Words are cut to stretches of at most this many characters between rescalings of the forward sums.
STRETCH = 32
#: Letters of a word that are learned from together.
LONGEST_WORD = 64
UNKNOWN = 1e-9


@cache
def pieces(path: str) -> frozenset[str]:
    """Pieces of letters, with or without the mark of a word's beginning."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i) and not model.is_control(i))
    return frozenset(p for p in plain if p == MARK or p.removeprefix(MARK).isalpha())


def lattice(word: str, known: frozenset[str] | dict, longest: int) -> list[list[tuple[int, str]]]:
    """For each end, the (start, piece) that reach it; single unknown characters count as pieces."""
    n = len(word)
    ends: list[list[tuple[int, str]]] = [[] for _ in range(n + 1)]
    for start in range(n):
        for end in range(start + 1, min(n, start + longest) + 1):
            piece = word[start:end]
            if piece in known or end == start + 1:
                ends[end].append((start, piece))
    return ends


@dataclass
class Model:
    """Languages in order and, for each piece, its probability in each of them."""

    languages: tuple[str, ...]
    rows: dict[str, tuple[float, ...]]
    longest: int = field(init=False)
    table: np.ndarray = field(init=False)
    place: dict[str, int] = field(init=False)
    key: int = field(init=False)

    def __post_init__(self):
        self.longest = max(map(len, self.rows), default=1)
        width = len(self.languages)
        # Row 0: no piece; row 1: a character outside the vocabulary.
        self.table = np.array([(0.0,) * width, (UNKNOWN,) * width, *self.rows.values()])
        self.place = {piece: k for k, piece in enumerate(self.rows, 2)}
        self.key = hash((self.languages, tuple(sorted(self.rows.items())[:50]), sum(map(sum, self.rows.values()))))

    def log_word(self, word: str) -> tuple[float, ...]:
        """Log probability of a word in each language, over all its segmentations."""
        word = MARK + word
        rows, n, width = self.rows, len(word), len(self.languages)
        unknown = (UNKNOWN,) * width
        forward: list[list[float] | None] = [None] * (n + 1)
        forward[0] = [1.0] * width
        logs = [0.0] * width
        for end in range(1, n + 1):
            total = [0.0] * width
            for start in range(max(0, end - self.longest), end):
                row = rows.get(word[start:end])
                if row is None:
                    if start < end - 1:
                        continue
                    row = unknown
                total = [t + f * p for t, f, p in zip(total, forward[start], row)]
            forward[end] = total
            if end % STRETCH == 0 and end < n:  # only the last ``longest`` sums are used again
                scale = [t or 1e-300 for t in total]
                logs = [x + math.log(s) for x, s in zip(logs, scale)]
                for k in range(max(0, end - self.longest), end + 1):
                    forward[k] = [f / s for f, s in zip(forward[k], scale)]
        return tuple(x + math.log(max(t, 1e-300)) for x, t in zip(logs, forward[n]))


    def log_words(self, words: Collection[str]) -> dict[str, tuple[float, ...]]:
        """``log_word`` of many words: the sums of all words of one length side by side."""
        by_length: dict[int, list[str]] = defaultdict(list)
        for word in words:
            by_length[len(word)].append(word)
        found = {}
        for length, own in by_length.items():
            if length >= STRETCH - 2:
                found.update((word, self.log_word(word)) for word in own)
                continue
            marked = [MARK + word for word in own]
            n, place = length + 1, self.place
            forward = [np.ones((len(own), len(self.languages)))]
            for end in range(1, n + 1):
                total = 0
                for start in range(max(0, end - self.longest), end):
                    missing = 1 if start == end - 1 else 0
                    ids = [place.get(word[start:end], missing) for word in marked]
                    if any(ids):
                        total = total + forward[start] * self.table[ids]
                forward.append(total)
            logs = np.log(np.maximum(forward[n], 1e-300))
            found.update(zip(own, map(tuple, logs.tolist())))
        return found


class Words:
    """A worker's remembered words of one model."""

    def __init__(self, model: Model):
        self.model, self.new, self.old = model, {}, {}

    def learn(self, words: Iterable[str]) -> dict[str, tuple[float, ...]]:
        """Logs of all the words asked for, and of others."""
        asked = set(words)
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        missing = asked - self.new.keys()
        known = missing & self.old.keys()
        self.new.update((word, self.old[word]) for word in known)
        self.new.update(self.model.log_words(missing - known))
        return self.new


_SCORERS: dict[int, Words] = {}


def scorer(model: Model) -> Words:
    if model.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.key] = Words(model)
    return _SCORERS[model.key]


def identify(texts: list[str | None], model: Model) -> list[tuple[str, float]]:
    """The likeliest language of each text and its posterior under equal priors."""
    split = [WORDS((text or "").lower()) for text in texts]
    if not model.languages:
        return [(UNDETERMINED, 0.0)] * len(texts)
    logs_of = scorer(model).learn(chain.from_iterable(split)) if any(split) else {}
    out = []
    for words in split:
        if not words:
            out.append((UNDETERMINED, 0.0))
            continue
        logs = np.array([logs_of[word] for word in words]).sum(axis=0)
        best = int(logs.argmax())
        out.append((model.languages[best], float(1.0 / np.exp(np.clip(logs - logs[best], -700, 0)).sum())))
    return out


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(start, 256) for start in range(0, len(batch), 256)):
                found = identify(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([lang for lang, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def _stretches(word: str) -> Iterator[str]:
    """A word in stretches of at most ``LONGEST_WORD`` letters: scripts without spaces have words as long as sentences."""
    return (word[start:start + LONGEST_WORD] for start in range(0, len(word), LONGEST_WORD))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(*(column.to_pylist() for column in batch.columns)):
            counts.update((lang, part) for word in WORDS((text or "").lower()) for part in _stretches(word))
        yield pa.RecordBatch.from_arrays([
            pa.array([lang for lang, _ in counts], pa.string()), pa.array([word for _, word in counts], pa.string()),
            pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])


def training_words(docs: DataFrame, max_rows: int, id_col: str, text_col: str, lang_col: str, held_out: str) -> DataFrame:
    """lang, word, n over at most ``max_rows`` rows of each language outside the held-out fold, by the hash of the id."""
    rows = pick(docs, doc_id=id_col, lang=lang_col, text=text_col).filter(f"lang is not null and not ({held_out})")
    first = Window.partitionBy("lang").orderBy("key", "doc_id")
    ids = rows.select("lang", "doc_id").distinct().withColumn("key", F.xxhash64("doc_id"))
    chosen = ids.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= max_rows).select(
        F.col("lang").alias("of"), F.col("doc_id").alias("id"), "place")
    met = rows.join(F.broadcast(chosen), (F.col("lang") == F.col("of")) & (F.col("doc_id") == F.col("id")))  # max_rows ids a language
    # An id may come again: its rows count one after the other, by their text.
    again = Window.partitionBy("lang").orderBy("place", F.xxhash64("text"), "text")
    bounded = met.withColumn("row", F.row_number().over(again)).filter(F.col("row") <= max_rows).select("lang", "text")
    return bounded.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expected(languages: tuple[str, ...], rows: dict[str, tuple[float, ...]] | None, known: frozenset[str], longest: int):
    """Forward-backward piece counts of a task's words; without ``rows`` a piece weighs by its length alone."""
    place = {lang: k for k, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], float] = defaultdict(float)
        for batch in batches:
            for lang, word, n in zip(*(column.to_pylist() for column in batch.columns)):
                word, k = MARK + word, place[lang]
                ends = lattice(word, known, longest)
                size = len(word)
                weight = (lambda p: rows[p][k] if p in rows else UNKNOWN) if rows else (lambda p: 1e-3 if p in known else UNKNOWN)
                arcs = [[(start, piece, weight(piece)) for start, piece in own] for own in ends]
                forward = [1.0] + [0.0] * size
                for end in range(1, size + 1):
                    forward[end] = sum(forward[start] * p for start, _, p in arcs[end])
                if not forward[size] > 0:
                    continue
                backward = [0.0] * size + [1.0]
                for end in range(size, 0, -1):
                    for start, _, p in arcs[end]:
                        backward[start] += backward[end] * p
                for end in range(1, size + 1):
                    for start, piece, p in arcs[end]:
                        if piece in known:
                            counts[lang, piece] += n * forward[start] * p * backward[end] / forward[size]
        yield pa.RecordBatch.from_arrays([
            pa.array([lang for lang, _ in counts], pa.string()), pa.array([piece for _, piece in counts], pa.string()),
            pa.array(list(counts.values()), pa.float64())], names=["lang", "piece", "n"])

    return run


def train(docs: DataFrame, max_rows: int = 1_000, rounds: int = 2, smoothing: float = 0.1, path: str | None = None,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: str = HELD_OUT) -> Model:
    known = pieces(path or public_tokenizers.path(VOCABULARY))
    longest = max(map(len, known))
    words = materialize(training_words(docs, max_rows, id_col, text_col, lang_col, held_out), "language-words")
    languages = tuple(sorted(row.lang for row in words.select("lang").distinct().collect()))
    if not languages:
        return Model((), {})
    rows = None
    for _ in range(rounds):
        step = _expected(languages, rows, known, longest)
        sums = words.mapInArrow(step, "lang string, piece string, n double").groupBy("lang", "piece").agg(
            F.round(F.sum("n"), 3).alias("n")).toPandas()  # at most one row per piece and language
        counts = {lang: dict(zip(part["piece"], part["n"])) for lang, part in sums.groupby("lang")}
        shares = []
        for lang in languages:
            own = counts.get(lang, {})
            total = sum(own[p] for p in sorted(own)) + smoothing * len(known)
            shares.append({piece: (own.get(piece, 0.0) + smoothing) / total for piece in known})
        rows = {piece: tuple(share[piece] for share in shares) for piece in known}
    return Model(languages, rows)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: str = HELD_OUT) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    plain = pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", f"coalesce({held_out}, false) held_out", "text")
    return plain.mapInArrow(_predict(model), "doc_id bigint, held_out boolean, lang_pred string, score double")
