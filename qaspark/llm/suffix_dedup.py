"""Repeated passages by sorted suffixes: a shallow multikey quicksort, then blind tries.

A byte is removed when a string of ``length`` bytes that covers it also starts anywhere else. To sort only suffixes that
can meet, every stretch of ``length`` bytes elects an anchor, the place of its smallest hashed ``gram``: equal stretches
elect equal anchors, so equal stretches always meet in the bucket of their anchor's gram.

1. Anchors (hash of the gram, hash of the context that reaches ``length`` both ways, document, place) are range-
   partitioned and sorted. A context that occurs twice is repeated as a whole; a gram that occurs once is dropped.
2. Of each remaining bucket with several contexts, one text per context is cut out of its document.
3. A bucket's suffixes, from the anchor to the right and from the anchor to the left, are put in order: by multikey
   quicksort to ``SHALLOW`` bytes, and by a blind trie where the common prefix goes on. The common prefixes of
   neighbours give the common stretch L + R around the anchor for any two contexts; it counts from ``length`` on.
4. Buckets with more than ``bucket`` contexts are split by the suffix itself, one sub-bucket per ``length``-byte string.
5. The removed intervals of a document meet its text once more.

Spans are found on the input, so overlaps count and removal never creates new spans.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; each row is a document of its own, so
rows with equal id and text repeat each other; rows with a null id are documents like others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from qaspark.llm.common import flat_map_rows, map_rows, pick
from qaspark.operators.lookups import null_safe_join
from qaspark.session import materialize

GRAM = 50
#: Bytes that are hashed together; longer texts are cut into overlapping parts.
BLOCK = 1 << 18
SHALLOW = 16
BASE = 0x9E3779B97F4A7C15
ANCHORS = "h bigint, c bigint, doc_id bigint, text_hash binary, place bigint"
FOUND = "whole boolean, h bigint, doc_id bigint, text_hash binary, place bigint"
CONTEXTS = "h bigint, hot boolean, doc_id bigint, text_hash binary, place bigint, left_part binary, right_part binary"
#: Rows are named by their id and 128 bits of their text: rows of one id (or none) must not be taken for each other.
TEXT_HASH = "unhex(md5(coalesce(text, '')))"
SPANS = "doc_id bigint, text_hash binary, start bigint, stop bigint"


# --- anchors -------------------------------------------------------------------------------------------------------

_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int) -> np.ndarray:
    if base not in _POWERS:
        row = np.full(BLOCK + 1, base, dtype=np.uint64)
        row[0] = 1
        _POWERS[base] = np.multiply.accumulate(row)
    return _POWERS[base]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams: differences of one running polynomial, mixed."""
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE)[:n], out=total[1:])
    h = (total[gram:] - total[:-gram]) * _powers(pow(BASE, -1, 1 << 64))[:n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(parts: Sequence[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, place in it, hash) of the anchors of all ``length``-byte windows; at most BLOCK bytes together."""
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    window = length - gram + 1
    n_windows = len(data) - length + 1
    nothing = np.zeros(0, dtype=np.int64)
    if n_windows < 1:
        return nothing, nothing, nothing.astype(np.uint64)
    h = gram_hashes(data, gram)
    low = np.uint64(BLOCK - 1)
    keys = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes
    padded = np.concatenate([keys, np.full(-len(keys) % window, 2**64 - 1, dtype=np.uint64)]).reshape(-1, window)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:n_windows], before[window - 1:window - 1 + n_windows])
    ends = np.cumsum([len(part) for part in parts])
    starts = np.r_[0, ends[:-1]]
    change = np.zeros(len(data) + 1, dtype=np.int64)
    long_enough = ends - starts >= length
    np.add.at(change, starts[long_enough], 1)
    np.add.at(change, ends[long_enough] - length + 1, -1)
    chosen = np.unique((least[np.cumsum(change)[:n_windows] > 0] & low).astype(np.int64))
    part = np.searchsorted(ends, chosen, side="right")
    return part, chosen - starts[part], h[chosen]


def _parts(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """(offset, part) so that every window lies whole in exactly one part."""
    step = BLOCK // 2
    for start in range(0, max(len(text) - length + 1, 0), step):
        yield start, text[start:start + step + length - 1]


def _find_anchors(length: int, gram: int):
    def emit(held: list[tuple], last: tuple[int, int]) -> tuple[pa.RecordBatch, tuple[int, int]]:
        """The anchors of the held parts and the (row, place) of the last; ``last`` is that of the parts before."""
        part, place, h = anchors([own[3] for own in held], length, gram)
        starts = np.array([own[2] for own in held], dtype=np.int64)[part] + place
        rows = np.array([own[5] for own in held], dtype=np.int64)[part]
        # The last windows of a part and the first of the next of its row may elect one anchor: it counts once.
        new = (rows != np.r_[last[0], rows[:-1]]) | (starts != np.r_[last[1], starts[:-1]])
        last = (int(rows[-1]), int(starts[-1])) if len(rows) else last
        part, starts, h = part[new], starts[new], h[new]
        contexts = np.zeros(len(part), dtype=np.uint64)
        for k, (which, at) in enumerate(zip(part.tolist(), starts.tolist())):
            text = held[which][4]
            left = max(0, at - length + gram)
            contexts[k] = xxhash.xxh3_64_intdigest(text[left:at + length], at - left)
        ids = pa.array([own[0] for own in held], pa.int64()).take(pa.array(part))
        hashes = pa.array([own[1] for own in held], pa.binary()).take(pa.array(part))
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(contexts.view(np.int64)), ids, hashes, pa.array(starts)],
            names=["h", "c", "doc_id", "text_hash", "place"]), last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, row, last = 0, 0, (-1, -1)
        for batch in batches:
            for doc_id, text_hash, text in zip(*(column.to_pylist() for column in batch.columns)):
                for offset, part in _parts(text, length):
                    if held and size + len(part) > BLOCK:
                        found, last = emit(held, last)
                        yield found
                        held, size = [], 0
                    held.append((doc_id, text_hash, offset, part, text, row))
                    size += len(part)
                row += 1
        if held:
            yield emit(held, last)[0]

    return run


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by gram and context: repeated contexts as a whole, and one row of each context to compare.

    The first and the last gram may go on in a neighbouring partition, so their contexts are always compared.
    """
    received = list(batches)  # some 60 bytes a row
    held = pa.Table.from_batches(received) if received else None
    if held is None or not held.num_rows:
        return
    h, c = (held.column(name).to_numpy() for name in ("h", "c"))
    new_h = np.r_[True, h[1:] != h[:-1]]
    new_c = new_h | np.r_[True, c[1:] != c[:-1]]
    gram_of, context_of = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
    contexts = np.bincount(gram_of[new_c])
    whole = np.bincount(context_of)[context_of] > 1
    edge = (gram_of == 0) | (gram_of == gram_of[-1])
    compare = new_c & ((contexts[gram_of] > 1) | edge)
    for flags, kind in ((whole, True), (compare, False)):
        picked = held.filter(pa.array(flags)).select(["h", "doc_id", "text_hash", "place"])
        for batch in picked.to_batches(max_chunksize=50_000):
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(batch)), *batch.columns], names=["whole", *batch.schema.names])


# --- order of suffixes -----------------------------------------------------------------------------------------------

def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differing = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differing.bit_length() + 7) // 8


class BlindTrie:
    """A trie of branching bytes only: a string walks down blindly, is compared once, and takes its place."""

    def __init__(self, strings: Sequence[bytes]):
        self.strings = strings
        self.root: list | None = None  # a leaf is (None, ids); a node is [depth, {byte: child}]; the end counts as -1

    @staticmethod
    def _at(text: bytes, depth: int) -> int:
        return text[depth] if depth < len(text) else -1

    def add(self, k: int) -> None:
        text = self.strings[k]
        if self.root is None:
            self.root = [None, [k]]
            return
        node = self.root
        while node[0] is not None:
            children = node[1]
            node = children.get(self._at(text, node[0])) or next(iter(children.values()))
        other = self.strings[node[1][0]]
        shared = common(text, other)
        if shared == len(text) == len(other):
            node[1].append(k)
            return
        parent, node = None, self.root
        while node[0] is not None and node[0] <= shared:
            below = node[1].get(self._at(text, node[0]))
            if below is None:
                node[1][self._at(text, node[0])] = [None, [k]]
                return
            parent, node = node, below
        branch = [shared, {self._at(other, shared): node, self._at(text, shared): [None, [k]]}]
        if parent is None:
            self.root = branch
        else:
            parent[1][self._at(text, parent[0])] = branch

    def ordered(self) -> Iterator[tuple[int, int]]:
        """(string, common prefix with the one before it) in order; 0 for the first."""
        first = True
        stack: list[tuple[list, int]] = [(self.root, 0)] if self.root else []
        while stack:
            node, shared = stack.pop()
            if node[0] is None:
                for k in node[1]:
                    yield k, 0 if first else shared
                    shared, first = len(self.strings[k]), False
                continue
            # The first child keeps what its node shares with the string before; the others share the node's depth.
            children = [node[1][byte] for byte in sorted(node[1])]
            stack.extend((child, node[0]) for child in reversed(children[1:]))
            stack.append((children[0], shared))


def deep_shallow_sort(strings: Sequence[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of the strings and each one's common prefix with its predecessor (0 for the first)."""
    order: list[int] = []
    prefixes: list[int] = []
    stack: list[tuple[list[int], int, int]] = [(list(range(len(strings))), 0, 0)]
    while stack:
        group, depth, shared = stack.pop()
        if len(group) == 1 or depth >= shallow:
            trie = BlindTrie(strings)
            for k in group:
                trie.add(k)
            for place, (k, prefix) in enumerate(trie.ordered()):
                order.append(k)
                prefixes.append(prefix if place else shared)
            continue
        at = [strings[k][depth] if depth < len(strings[k]) else -1 for k in group]
        pivot = sorted(at)[len(at) // 2]
        less = [k for k, byte in zip(group, at) if byte < pivot]
        same = [k for k, byte in zip(group, at) if byte == pivot]
        more = [k for k, byte in zip(group, at) if byte > pivot]
        # The first group in order keeps what was shared before; the later ones share ``depth`` bytes.
        first = shared
        parts = []
        for part, deeper in ((less, depth), (same, depth + 1 if pivot >= 0 else shallow), (more, depth)):
            if part:
                parts.append((part, deeper, first))
                first = depth
        stack.extend(reversed(parts))
    return order, prefixes


def _shared_with(place: int, prefixes: np.ndarray) -> np.ndarray:
    """Common prefix of the string at a place of the order with all others, by running minima; own place: 0."""
    n = len(prefixes)
    out = np.zeros(n, dtype=np.int64)
    out[place + 1:] = np.minimum.accumulate(prefixes[place + 1:])
    if place:
        out[:place] = np.minimum.accumulate(prefixes[place:0:-1])[::-1]
    return out


def reaches(lefts: Sequence[bytes], rights: Sequence[bytes], length: int) -> list[tuple[int, int]]:
    """For each context, how far its repeated stretches reach left and right of the anchor; (0, 0) without any.

    ``lefts`` are reversed. A stretch shared with one other context counts if it has ``length`` bytes; all contain the
    anchor, so their union is one stretch.
    """
    n = len(lefts)
    if n < 2:
        return [(0, 0)] * n
    if n == 2:
        left, right = (deep_shallow_sort(side)[1][1] for side in (lefts, rights))
        return [(left, right) if left + right >= length else (0, 0)] * 2
    left_order, left_prefix = deep_shallow_sort(lefts)
    right_order, right_prefix = deep_shallow_sort(rights)
    left_order, right_order = np.array(left_order), np.array(right_order)
    left_prefix, right_prefix = np.array(left_prefix), np.array(right_prefix)
    left_place, right_place = np.argsort(left_order), np.argsort(right_order)
    found = []
    for k in range(n):
        left = _shared_with(int(left_place[k]), left_prefix)[left_place]
        right = _shared_with(int(right_place[k]), right_prefix)[right_place]
        counts = left + right >= length
        counts[k] = False
        found.append((int(left[counts].max()), int(right[counts].max())) if counts.any() else (0, 0))
    return found


def _sort_buckets(length: int):
    """Spans of the buckets of a partition that is sorted by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(column.to_pylist() for column in batch.columns))

        out: list[tuple] = []
        for _, bucket in groupby(rows(), key=lambda row: row[0]):
            bucket = list(bucket)
            # Texts that met twice at a partition's edge differ in nothing; they stay, as each repeats the other.
            found = reaches([row[5] for row in bucket], [row[6] for row in bucket], length)
            out.extend((row[2], row[3], row[4] - left, row[4] + right) for row, (left, right) in zip(bucket, found) if right)
            if len(out) >= 20_000:
                yield _spans(out)
                out = []
        if out:
            yield _spans(out)

    return run


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    ids, hashes, starts, stops = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(hashes, pa.binary()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())],
        names=["doc_id", "text_hash", "start", "stop"])


# --- the operator ------------------------------------------------------------------------------------------------------

def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(docs, doc_id=id_col, text=text_col).selectExpr(
        "cast(doc_id as bigint) doc_id", f"{TEXT_HASH} text_hash", "cast(coalesce(text, '') as binary) text")


def _join_texts(texts: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Texts with what belongs to their id and hash."""
    t, o = texts.alias("t"), other.withColumnsRenamed({"doc_id": "o_id", "text_hash": "o_hash"})
    return t.join(o, F.col("t.doc_id").eqNullSafe(F.col("o_id")) & (F.col("t.text_hash") == F.col("o_hash")), how)


def spans(docs: DataFrame, length: int = 200, gram: int = GRAM, bucket: int = 20_000, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Repeated stretches of each document (``SPANS``), overlapping; rows are found by id and text hash."""
    if not 0 < gram < length:
        raise ValueError("a gram is shorter than the repeated string")
    texts = _texts(docs, id_col, text_col)
    found = texts.mapInArrow(_find_anchors(length, gram), ANCHORS)
    order = ("h", "c", "doc_id", "text_hash", "place")
    sifted = materialize(
        found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_sift, FOUND), "anchors")

    whole = sifted.filter("whole").selectExpr(
        "doc_id", "text_hash", f"greatest(place - {length - gram}, 0L) as start", f"place + {length} as stop")
    compare = sifted.filter("not whole").drop("whole")
    hot = compare.groupBy("h").count().filter(F.col("count") > bucket).select("h", F.lit(True).alias("hot"))
    marked = null_safe_join(compare, hot, ["h"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = marked.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("h", "hot", "place")).alias("places"))

    def cut(doc_id: int | None, text_hash: bytes, text: bytes, places: list[dict]) -> Iterator[tuple]:
        for own in places:
            at = own["place"]
            yield (own["h"], own["hot"], doc_id, text_hash, at, text[max(0, at - length + gram):at][::-1], text[at:at + length])

    contexts = flat_map_rows(_join_texts(texts, wanted, "inner").select("doc_id", "text_hash", "text", "places"), cut, CONTEXTS)
    contexts = contexts.repartition("h", F.when(F.col("hot"), F.xxhash64("doc_id", "text_hash", "place"))).sortWithinPartitions("h")

    if not hot.limit(1).count():
        return contexts.mapInArrow(_sort_buckets(length), SPANS).unionByName(whole)
    landed = materialize(contexts, "contexts")
    cool = landed.filter("not hot").repartition("h").sortWithinPartitions("h").mapInArrow(_sort_buckets(length), SPANS)
    return cool.unionByName(_split_buckets(landed.filter("hot"), length)).unionByName(whole)


def _split_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of large buckets, each ``length``-byte suffix in a sub-bucket of its own; equal ones count before they move."""

    def suffixes(h: int, hot: bool, doc_id: int | None, text_hash: bytes, place: int, left: bytes, right: bytes) -> Iterator[tuple]:
        whole = left[::-1] + right
        for start in range(len(whole) - length + 1):
            first, second = np.frombuffer(xxhash.xxh3_128_digest(whole[start:start + length]), "<i8").tolist()
            yield first, second, doc_id, text_hash, place - len(left) + start

    rows = materialize(flat_map_rows(contexts, suffixes, "s1 bigint, s2 bigint, doc_id bigint, text_hash binary, start bigint"), "suffixes")
    # The same place may come from several anchors: it is one suffix.
    counted = rows.distinct().groupBy("s1", "s2").count().filter("count > 1")
    return rows.join(counted, ["s1", "s2"]).selectExpr("doc_id", "text_hash", "start", f"start + {length} as stop")


def merge_spans(starts: Sequence[int], stops: Sequence[int], size: int) -> list[tuple[int, int]]:
    """The union of stretches as maximal runs, within a text's size."""
    merged: list[list[int]] = []
    for start, stop in sorted(zip(starts, stops)):
        start, stop = max(start, 0), min(stop, size)
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        elif start < stop:
            merged.append([start, stop])
    return [(start, stop) for start, stop in merged]


def removed_spans(docs: DataFrame, length: int = 200, gram: int = GRAM, bucket: int = 20_000, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """doc_id, text (bytes), starts and stops (null without any) of every row: what ``merge_spans`` takes."""
    texts = _texts(docs, id_col, text_col)
    gathered = spans(docs, length, gram, bucket, id_col, text_col).groupBy("doc_id", "text_hash").agg(
        F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    return _join_texts(texts, gathered, "left").select("doc_id", "text", "starts", "stops")


def remaining(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, stop in removed:
        kept.append(text[at:start])
        at = stop
    return b"".join([*kept, text[at:]])
