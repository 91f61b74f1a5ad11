"""Collocations: phrases of up to four words whose parts seldom come without each other, from FM-indexes of word ids.

Texts are cut at punctuation and line ends into pieces, pieces into words. Each task packs its words into shards of one
language; a shard's index is the Burrows-Wheeler transform of its word ids, in which every piece ends in a sentinel of its
own. Rows of the suffix order that begin with the same words are an interval, and its length is their count. Interval by
interval, the index is extended one word at a time in both directions: to the left by the word before each row (the
permutation that sorts the transform), and to the right by splitting the interval where the rows' next word changes. A
phrase of ``m`` words is looked for only where its first and its last ``m - 1`` words are both frequent in all shards.

1. ``shards``: one pass over the texts, one row per shard (words, transform), written to the shared folder.
2. ``intervals``: for each length from two, every shard states (hash, interval, count) of its phrases; counts are summed
   over the shards by a 64-bit hash and the intervals of hashes below ``least`` are dropped. A second hash of 32 bits tells
   phrases apart that share the first.
3. ``phrase_counts``: single words, and the words of the phrases that are left. One of a phrase's shards, chosen by the hash,
   spells it with its count in all shards, so that these rows are as many as phrases. Where the second hashes of a first one
   differ, every shard spells its own phrase and counts are summed by the words.
4. ``collocations``: every cut of a phrase is scored from the counts of its two parts. A phrase inside a longer one of
   nearly its count is dropped; it is enough to look one word further, because every longer phrase holds one of those, which
   comes at least as often.

A phrase is at most one row per shard, so no key is hot; shards have a bounded number of words. A task holds one shard at a
time: rows of shards are stored and sent to workers singly or few together, and the lists of intervals that belong to them are
made by sorting, of one number an interval.

Defined results: a null text has no words; a null language is ``und``; repeated rows count as often as they come; texts of
any length go whole, a shard's end never cuts a text unless the text alone is longer than a shard, and then between pieces
(a piece is never cut); an empty table has no phrases.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from qaspark.llm.common import arrow_rows, pick, sorted_lists
from qaspark.session import materialize

#: Words of all open shards of a task (the largest is closed when there are more), and different words of them.
HELD, HELD_WORDS = 1_500_000, 400_000
#: A text's pieces are added in runs of this many bytes, between which a shard may be closed.
RUN_BYTES = 1 << 20
#: Rows that leave a task at a time, texts and shards that enter it, and shards in a row group of the stored table.
STREAM_ROWS, TEXTS_AT_ONCE, SHARDS_AT_ONCE, SHARDS_STORED = 200_000, 200, 1, 4
#: Words whose digests are held at a time.
HASHED_WORDS = 20_000
#: Parts of a language that are ranked by themselves first.
RANK_PARTS = 64
SHARDS = "shard bigint, lang string, n bigint, words binary, bwt binary"
#: ``at``: the second hash in the upper 32 bits, the interval's first row in the lower (fewer bytes are shuffled than in columns).
INTERVALS = "h bigint, at bigint, shard bigint, c int"
_MARKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")


def piece_tokens(text: bytes) -> list[bytes]:
    """Lower-cased words with a ``b"."`` between pieces (no word holds one)."""
    return text.lower().translate(_MARKS).replace(b".", b" . ").split()


def _runs(text: bytes) -> Iterator[bytes]:
    """The text in runs that end between pieces."""
    at = 0
    while len(text) - at > RUN_BYTES:
        ends = [place for place in (text.find(mark, at + RUN_BYTES) for mark in (b".", b"\n")) if place >= 0]
        if not ends:
            break
        yield text[at:min(ends)]
        at = min(ends)
    yield text[at:]


class _Ids(dict):
    """Numbers from 1 in order of first use; 0 ends a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Open:
    """A shard that is being filled."""

    def __init__(self):
        self.ids, self.tokens = _Ids({b".": 0}), array("i")

    def add(self, text: bytes) -> None:
        tokens = piece_tokens(text)
        self.tokens.extend(map(self.ids.__getitem__, tokens))
        self.tokens.append(0)


def suffix_ranks(ids: np.ndarray) -> np.ndarray:
    """The place of every suffix in their order; zeros are sentinels, smaller than words and ordered by position.

    Places are refined by twice as many words each round; only suffixes that are still alike are sorted again. The last
    id is a sentinel.
    """
    count = len(ids)
    sentinel = ids == 0
    key = np.where(sentinel, np.cumsum(sentinel, dtype=np.int32) - 1, ids + np.int32(sentinel.sum()))
    order = np.argsort(key, kind="stable").astype(np.int32)
    starts = np.r_[True, np.diff(key[order]) != 0]
    rank = np.empty(count, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(count, dtype=np.int32), 0))
    alone = starts & np.r_[starts[1:], True]
    open_ = order[~alone]
    del key, order
    step = 1
    while len(open_):
        key = rank[open_].astype(np.int64) * count + rank[open_ + step]  # an open suffix has a sentinel after this many words
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        places = np.arange(len(open_))
        group = key // count
        first = np.maximum.accumulate(np.where(np.r_[True, np.diff(group) != 0], places, 0))
        starts = np.r_[True, np.diff(key) != 0]
        slot = group + places - first
        rank[open_] = np.maximum.accumulate(np.where(starts, slot, 0))
        open_ = open_[~(starts & np.r_[starts[1:], True])]
        step *= 2
    return rank


def transform(ids: np.ndarray) -> np.ndarray:
    """The word before each suffix, in suffix order."""
    out = np.empty(len(ids), dtype=np.int32)
    out[suffix_ranks(ids)] = np.r_[ids[-1:], ids[:-1]]
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_: dict[str, _Open] = {}

    def close(lang: str) -> pa.RecordBatch:
        shard = open_.pop(lang)
        ids = np.frombuffer(shard.tokens, dtype=np.int32)
        words = b" ".join(shard.ids)  # the first is the mark
        shard.ids.clear()
        return pa.RecordBatch.from_arrays([
            pa.array([0]), pa.array([lang]), pa.array([int((ids > 0).sum())]), pa.array([words], pa.binary()),
            pa.array([transform(ids).tobytes()], pa.binary())], names=["shard", "lang", "n", "words", "bwt"])

    tokens = words = 0
    for batch in batches:
        for start in range(0, len(batch), TEXTS_AT_ONCE):
            part = batch.slice(start, TEXTS_AT_ONCE)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1)):
                for run in _runs(text.as_py()):
                    own = open_.setdefault(lang, _Open())
                    tokens, words = tokens - len(own.tokens), words - len(own.ids)
                    own.add(run)
                    tokens, words = tokens + len(own.tokens), words + len(own.ids)
                    if tokens >= HELD or words >= HELD_WORDS:
                        largest = max(open_, key=lambda name: len(open_[name].tokens))
                        tokens, words = tokens - len(open_[largest].tokens), words - len(open_[largest].ids)
                        yield close(largest)
    for lang in list(open_):
        yield close(lang)


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """shard, lang, n (words), words (joined by spaces, from id 0) and bwt (32-bit ids) of bounded parts of the texts."""
    texts = pick(docs, lang=lang_col, text=text_col).select(
        F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    packed = texts.mapInArrow(_pack, StructType.fromDDL(SHARDS))
    numbered = packed.withColumn("shard", F.monotonically_increasing_id())
    with arrow_rows(docs.sparkSession, TEXTS_AT_ONCE):
        return materialize(numbered, "phrase-shards", {"parquet.block.row.count.limit": str(SHARDS_STORED)})


class Index:
    """A shard's index with the operations that extension takes."""

    def __init__(self, lang: str, words: bytes, bwt: bytes | pa.Buffer):
        self.lang, self.words = lang, words.split(b" ")
        before = np.frombuffer(bwt, dtype=np.int32)
        self.size = len(before)
        # Row r begins with word first[r]; what follows it is row then[r]. (Sentinel rows are never followed.)
        self.then = np.argsort(before, kind="stable").astype(np.int32)
        self.first = before[self.then]

    def word_intervals(self) -> tuple[np.ndarray, np.ndarray]:
        """(low, count) of all words."""
        low = np.flatnonzero(np.r_[True, self.first[1:] != self.first[:-1]])
        count = np.diff(np.r_[low, self.size])
        return (low[1:], count[1:]) if self.size and self.first[0] == 0 else (low, count)

    def extended(self, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, count) of the phrases one word longer whose first and last part are among the given intervals."""
        edges, begins = np.zeros(self.size + 1, dtype=np.int8), np.zeros(self.size, dtype=bool)
        edges[low] += 1
        edges[low + count] -= 1
        begins[low] = True
        own = np.cumsum(begins, dtype=np.int32)
        own[np.cumsum(edges[:-1], dtype=np.int8) == 0] = 0
        rest = own[self.then]
        rest[self.first == 0] = 0
        whole = (own > 0) & (rest > 0)
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (own[1:] != own[:-1]) | (rest[1:] != rest[:-1])
        del own, rest
        low, rows = np.flatnonzero(new).astype(np.int32), np.cumsum(whole, dtype=np.int32)
        return low, np.diff(np.r_[rows[low] - 1, rows[-1:]])

    def word_ids(self, low: np.ndarray, length: int) -> list[np.ndarray]:
        """The ids of the first words of rows, place by place."""
        found, row = [], low
        for _ in range(length):
            found.append(self.first[row])
            row = self.then[row]
        return found

    def word_hashes(self, length: int) -> np.ndarray:
        """Two 64-bit hashes of each word, seeded by the language and the length of phrases."""
        seed = xxhash.xxh64_intdigest(self.lang.encode(), length)
        made = np.empty((len(self.words), 2), dtype=np.uint64)
        for start in range(0, len(made), HASHED_WORDS):
            digests = [xxhash.xxh3_128_digest(word, seed) for word in self.words[start:start + HASHED_WORDS]]
            made[start:start + HASHED_WORDS] = np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 2)
        return made

    def hashes(self, low: np.ndarray, length: int, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of 64 and 32 bits of phrases with their language, the same in every shard."""
        h, g = np.zeros(len(low), dtype=np.uint64), np.zeros(len(low), dtype=np.uint64)
        for ids in self.word_ids(low, length):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + of_word[ids, 0]
            g = (g ^ (g >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + of_word[ids, 1]
        return h, g >> np.uint64(32)


def _one_by_one(make):
    """The rows that ``make`` has for each row of the batches; nothing of one row is held while the next one comes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in range(len(batch)):
                yield from make(*(column[place] for column in batch.columns))
            del batch

    return run


def _state(length: int):
    """Interval rows of all phrases of a length; shard rows come with the intervals kept at the length before, if any."""
    def make(shard, lang, words, bwt, kept=None) -> Iterator[pa.RecordBatch]:
        index = Index(lang.as_py(), words.as_py(), bwt.as_buffer())
        low, count = index.extended(*(index.word_intervals() if length == 2 else _unpacked(kept)))
        of_word = index.word_hashes(length)
        for start in range(0, len(low), STREAM_ROWS):
            part, c = low[start:start + STREAM_ROWS], count[start:start + STREAM_ROWS]
            h, g = index.hashes(part, length, of_word)
            yield pa.RecordBatch.from_arrays([
                pa.array(h.view(np.int64)), pa.array((g << np.uint64(32) | part.astype(np.uint64)).view(np.int64)),
                pa.array(np.full(len(part), shard.as_py())), pa.array(c.astype(np.int32))], names=["h", "at", "shard", "c"])

    return _one_by_one(make)


def _unpacked(kept: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """(low, count) of the numbers that ``intervals`` packs them in."""
    packed = kept.values.to_numpy()
    return (packed >> 32).astype(np.int32), packed.astype(np.int32)


def intervals(shard_rows: DataFrame, length: int, kept: DataFrame | None, least: int) -> DataFrame:
    """shard, low, c, f of the phrases of a length that come ``least`` times or more in all shards (by hash).

    ``f`` is null but in the rows to spell: see ``often``.
    """
    own = shard_rows.select("shard", "lang", "words", "bwt")
    if kept is not None:
        # A shard has a bounded number of words, hence of intervals.
        packed = F.shiftleft(F.col("low").cast("bigint"), 32).bitwiseOR(F.col("c").cast("bigint"))
        lists = kept.groupBy(F.col("shard").alias("s")).agg(F.collect_list(packed).alias("kept"))
        own = own.join(lists, F.col("shard") == F.col("s")).drop("s")
    stated = own.mapInArrow(_state(length), StructType.fromDDL(INTERVALS))
    with arrow_rows(shard_rows.sparkSession, SHARDS_AT_ONCE), sorted_lists(shard_rows.sparkSession):
        return materialize(often(stated, least), f"phrases-{length}")


def often(stated: DataFrame, least: int) -> DataFrame:
    """shard, low, c, f of the stated rows whose hash comes ``least`` times or more.

    ``f`` is the count in all shards, given in one row of each phrase; the shard that has it is chosen by the hash, so that
    the shards share the phrases. Where second hashes differ, each row gives its own count.
    """
    # A phrase has one row a shard, so no window is large. Few rows are left for the second window, which needs no exchange; its
    # columns in the first would be moved with all rows.
    alike, turn, second = Window.partitionBy("h"), F.col("shard").bitwiseXOR(F.col("h")), F.shiftright("at", 32)
    frequent = stated.withColumn("f", F.sum("c").over(alike)).filter(F.col("f") >= least)
    summed = frequent.withColumns({"turn": F.min(turn).over(alike), "least": F.min(second).over(alike), "most": F.max(second).over(alike)})
    return summed.select("shard", F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("low"), "c", F.when(
        F.col("least") != F.col("most"), F.col("c").cast("bigint")).when(turn == F.col("turn"), F.col("f")).alias("f"))


def _count_words(lang, words, bwt) -> Iterator[pa.RecordBatch]:
    names = words.as_py().decode().split(" ")[1:]  # the first is the mark
    counts = np.bincount(np.frombuffer(bwt.as_buffer(), dtype=np.int32), minlength=len(names) + 1)[1:]
    for start in range(0, len(names), STREAM_ROWS):
        part = names[start:start + STREAM_ROWS]
        yield pa.RecordBatch.from_arrays([
            pa.array([lang.as_py()] * len(part)), pa.array(np.ones(len(part), dtype=np.int32)), pa.array(part, pa.string()),
            pa.array(counts[start:start + STREAM_ROWS])], names=["lang", "length", "phrase", "c"])


def _spell(lang, words, bwt, found) -> Iterator[pa.RecordBatch]:
    index = Index(lang.as_py(), words.as_py(), bwt.as_buffer())
    lengths, low, count = (found.values.field(name).to_numpy() for name in ("length", "low", "f"))
    for length in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == length)
        for start in range(0, len(mine), STREAM_ROWS // 4):
            part = mine[start:start + STREAM_ROWS // 4]
            ids = index.word_ids(low[part], length)
            phrases = [b" ".join(map(index.words.__getitem__, row)).decode() for row in zip(*(k.tolist() for k in ids))]
            yield pa.RecordBatch.from_arrays([
                pa.array([index.lang] * len(part)), pa.array(np.full(len(part), length, dtype=np.int32)), pa.array(phrases, pa.string()),
                pa.array(count[part].astype(np.int64))], names=["lang", "length", "phrase", "c"])


def phrase_counts(shard_rows: DataFrame, depth: int, least: int) -> DataFrame:
    """lang, length, phrase and f of every phrase of up to ``depth`` words that comes ``least`` times or more."""
    kept, levels = None, []
    for length in range(2, depth + 1):
        kept = intervals(shard_rows, length, kept, least)
        levels.append(kept.filter("f is not null").withColumn("length", F.lit(length)))
    lists = reduce(DataFrame.unionByName, levels).groupBy(F.col("shard").alias("s")).agg(
        F.collect_list(F.struct("length", "low", "f")).alias("found"))
    shape = StructType.fromDDL("lang string, length int, phrase string, c bigint")
    spelled = shard_rows.join(lists, F.col("shard") == F.col("s")).select("lang", "words", "bwt", "found").mapInArrow(_one_by_one(_spell), shape)
    single = shard_rows.select("lang", "words", "bwt").mapInArrow(_one_by_one(_count_words), shape)
    tables = []
    for rows in (single, spelled):
        summed = rows.groupBy("lang", "length", "phrase").agg(F.sum("c").alias("f")).filter(F.col("f") >= least)
        with arrow_rows(shard_rows.sparkSession, SHARDS_AT_ONCE), sorted_lists(shard_rows.sparkSession):
            tables.append(materialize(summed, "phrase-counts"))
    return tables[0].unionByName(tables[1])


def collocations(docs: DataFrame, depth: int = 4, least: int = 30, contained: int = 80, best: int = 2000, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """The ``best`` phrases of 2 to ``depth`` words of each language, by the score of their weakest cut.

    lang, rank, phrase, a (its count), l and r (those of the cut's parts), n (words of the language) and score
    (``2000000 * a / (l + r)``, rounded down). Phrases of a count under ``least`` are no candidates; one inside a longer
    candidate that has ``contained`` per cent of its count is dropped.
    """
    shard_rows = shards(docs, text_col, lang_col)
    counts = phrase_counts(shard_rows, depth, least)
    long = counts.filter("length > 1").withColumn("w", F.split("phrase", " "))
    whole = counts.select(F.col("lang").alias("p_lang"), F.col("phrase").alias("part"), F.col("f").alias("part_f"))

    # Left and right part of every cut in one look-up; first words are hot keys that adaptive execution splits.
    cuts = long.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(
        F.struct(F.lit(True).alias("head"), F.array_join(F.slice("w", 1, F.col("k")), " ").alias("words")),
        F.struct(F.lit(False).alias("head"), F.array_join(F.expr("slice(w, k + 1, size(w) - k)"), " ").alias("words")))).alias("side"))
    met = sides.join(whole, F.col("lang").eqNullSafe(F.col("p_lang")) & F.col("side.words").eqNullSafe(F.col("part")))
    scored = met.groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side.head"), F.col("part_f"))).alias("l"), F.max(F.when(~F.col("side.head"), F.col("part_f"))).alias("r"))
    scored = scored.withColumn("score", F.expr(
        "cast(a as decimal(20,0)) * 2000000BD div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select(
        "lang", "phrase", "a", "m.l", "m.r", "m.score")

    longer = long.filter("length > 2").select(F.col("lang").alias("p_lang"), F.col("f").alias("longer"), F.explode(F.array(
        F.array_join(F.expr("slice(w, 1, size(w) - 1)"), " "), F.array_join(F.expr("slice(w, 2, size(w) - 1)"), " "))).alias("part"))
    longest = longer.groupBy("p_lang", "part").agg(F.max("longer").alias("longer"))
    covered = longest.join(counts.select(F.col("lang").alias("c_lang"), F.col("phrase").alias("c_phrase"), "f"), (
        F.col("p_lang") == F.col("c_lang")) & (F.col("part") == F.col("c_phrase"))).filter(
        F.expr(f"cast(longer as decimal(20,0)) * 100BD >= cast(f as decimal(20,0)) * {contained}BD"))
    left = weakest.join(covered.select("p_lang", "part"), (F.col("lang") == F.col("p_lang")) & (F.col("phrase") == F.col("part")), "left_anti")

    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    # A language may hold most phrases: its parts are cut first, then the few left of each part.
    parts = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    few = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= best)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= best)
    words = shard_rows.groupBy("lang").agg(F.sum("n").alias("n")).withColumnRenamed("lang", "n_lang")
    return ranked.join(words, F.col("lang") == F.col("n_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
