"""SimHash near-duplicates: anchor points of a covering code meet all close fingerprints.

A link means at most two differing bits of 64. Cut the bits into three blocks: two of them differ together in one bit
at most, so each of the three pairs of blocks is searched for distance one. On a pair, the anchors are the codewords of
a product of Hamming codes (31 + 7 + 3 + single bits): every point lies within the covering radius of the nearest
anchor, and a neighbour at distance one lies within that radius plus one of the same anchor. Each distinct fingerprint
goes to all anchors within that reach, about 24 for each pair of blocks; every linked pair then meets at an anchor, and
only fingerprints at the same anchor are compared, on all 64 bits. Copies share one fingerprint and travel once.

Rows of an anchor are sorted together and streamed; a run emits a spanning forest of its links, never all pairs.

Two bits of a whole text's fingerprint only forgive the smallest edits: texts that share 80 % of their shingles differ in
about ten. With ``similar`` (per cent of shingles, see ``near_groups``) distinct sets of shingles are joined as well
(``minhash``): links are confirmed on the full sets, and one of that share is missed with a probability of 10^-10 at most.

Defined results: a null text has no words; a text without words has fingerprint zero and links like any other; equal
rows share a component; a null id never names a component unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from qaspark.llm.common import map_rows, pick
from qaspark.llm.components import components
from qaspark.llm.minhash import NAMES, SET, set_columns, set_links
from qaspark.llm.shingles import shingle_hashes, text_set
from qaspark.operators.lookups import null_safe_join
from qaspark.session import materialize

BITS = 64
DISTANCE = 2
#: Bits of each block; two blocks together are searched for distance one.
BLOCKS = (range(0, 22), range(22, 43), range(43, 64))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Runs longer than this are walked from node to node instead of being compared shift by shift.
SHORT_RUN = 16
STREAM_ROWS = 200_000
ROWS = "doc_id bigint, text_hash bigint, fp bigint"


def fingerprint(text: bytes | None, size: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles, as a signed 64-bit number."""
    hashes = shingle_hashes(text, size, seed)
    return majority(hashes) if len(hashes) else 0


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes: bits that over half of them have, as a signed 64-bit number."""
    ones = np.zeros(BITS, dtype=np.int64)
    for place in range(0, len(hashes), 8192):
        part = hashes[place:place + 8192]
        ones += np.unpackbits(part.view("u1").reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _codes(bits: list[int]) -> list[list[int]]:
    """The bits as Hamming code words of length 31, 15, 7, 3 and single bits."""
    parts, at = [], 0
    for length in (31, 15, 7, 3, 1):
        while len(bits) - at >= length:
            parts.append(bits[at:at + length])
            at += length
    return parts


def _anchors_of(fps: np.ndarray, bits: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, anchors) of all anchors within covering radius plus one, over the given bits."""
    one = np.uint64(1)
    mask = np.uint64(sum(1 << b for b in bits))
    nearest = fps & mask
    codes = []
    for code in _codes(bits):
        if len(code) == 1:
            codes.append((code, None))
            continue
        syndrome = np.zeros(len(fps), dtype=np.int64)
        for j in range(len(code).bit_length()):
            check = np.uint64(sum(1 << b for place, b in enumerate(code, 1) if place >> j & 1))
            syndrome |= (np.bitwise_count(fps & check) & 1).astype(np.int64) << j
        flip = np.array([0, *(1 << b for b in code)], dtype=np.uint64)
        nearest ^= flip[syndrome]
        codes.append((code, syndrome))
    yield np.arange(len(fps)), nearest
    for code, syndrome in codes:
        if syndrome is None:
            yield np.arange(len(fps)), nearest ^ (one << np.uint64(code[0]))
            continue
        # Code words at distance two of a point at distance one: the point with two bits flipped whose places
        # cancel the syndrome.
        flip = np.array([0, *(1 << b for b in code)], dtype=np.uint64)
        off = np.flatnonzero(syndrome)
        s = syndrome[off]
        for i in range(1, len(code) + 1):
            j = s ^ i
            fits = (j > i) & (j <= len(code))
            if fits.any():
                rows = off[fits]
                yield rows, nearest[rows] ^ flip[s[fits]] ^ flip[i] ^ flip[j[fits]]


def anchor_rows(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor key, fingerprint) of all replicas; the key also tells the pair of blocks."""
    keys, rows = [], []
    for number, (first, second) in enumerate(PAIRS):
        bits = [*BLOCKS[first], *BLOCKS[second]]
        for own, anchors in _anchors_of(fps, bits):
            # The block that is left out holds zeros in the anchor: room for the number of the pair.
            out = next(k for k in range(3) if k not in (first, second))
            keys.append(anchors | (np.uint64(number + 1) << np.uint64(BLOCKS[out][0])))
            rows.append(fps[own])
    return np.concatenate(keys), np.concatenate(rows)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for start in range(0, len(fps), 5000):
            keys, rows = anchor_rows(fps[start:start + 5000])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(rows.view(np.int64))], names=["anchor", "fp"])


def _forest(fps: np.ndarray) -> tuple[list[int], list[int]]:
    """Spanning links of a long run, walked from node to node."""
    left, a, b = np.unique(fps), [], []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            here = frontier.pop()
            near = np.bitwise_count(left ^ here) <= DISTANCE
            found = left[near].tolist()
            a.extend([int(here)] * len(found))
            b.extend(found)
            frontier.extend(left[near])
            left = left[~near]
    return a, b


def links_of_runs(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal keys; whole runs, sorted by key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b = [], []
    for start, size in zip(starts[sizes > SHORT_RUN].tolist(), sizes[sizes > SHORT_RUN].tolist()):
        left, right = _forest(fps[start:start + size])
        a.append(np.array(left, dtype=np.uint64))
        b.append(np.array(right, dtype=np.uint64))
    short = np.repeat(sizes <= SHORT_RUN, sizes)
    keys, fps = keys[short], fps[short]
    for shift in range(1, SHORT_RUN):
        same = keys[shift:] == keys[:-shift]
        if not same.any():
            break
        left, right = fps[:-shift][same], fps[shift:][same]
        near = (np.bitwise_count(left ^ right) <= DISTANCE) & (left != right)
        a.append(left[near])
        b.append(right[near])
    return np.concatenate([np.zeros(0, np.uint64), *a]), np.concatenate([np.zeros(0, np.uint64), *b])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def links(keys: list, fps: list) -> pa.RecordBatch:
        a, b = links_of_runs(np.concatenate(keys), np.concatenate(fps))
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64)), pa.array(found[1].view(np.int64))], names=["a", "b"])

    keys: list[np.ndarray] = []
    fps: list[np.ndarray] = []
    held = 0
    for batch in batches:
        key, fp = (column.to_numpy().view(np.uint64) for column in batch.columns)
        keys.append(key)
        fps.append(fp)
        held += len(key)
        if held >= STREAM_ROWS:
            all_keys, all_fps = np.concatenate(keys), np.concatenate(fps)
            cut = int(np.searchsorted(all_keys.view(np.int64), all_keys.view(np.int64)[-1]))  # the last run may go on
            if cut:
                yield links([all_keys[:cut]], [all_fps[:cut]])
            keys, fps = [all_keys[cut:]], [all_fps[cut:]]
            held = len(keys[0]) if cut else 0
    if keys:
        yield links(keys, fps)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(docs, doc_id=id_col, text=text_col).selectExpr(
        "cast(doc_id as bigint) doc_id", "xxhash64(coalesce(text, '')) text_hash", "cast(text as binary) text")


def fingerprints(docs: DataFrame, size: int = 3, similar_size: int | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and fp (bigint) of every row; with ``similar_size`` also its set of such shingles (``minhash.SET``)."""
    texts = _texts(docs, id_col, text_col)
    if similar_size is None:
        return map_rows(texts, lambda doc_id, text_hash, text: (doc_id, text_hash, fingerprint(text, size)), ROWS)
    columns = set_columns()

    def row(doc_id: int | None, text_hash: int, text: bytes | None) -> tuple:
        return doc_id, text_hash, fingerprint(text, size), *columns(text_set(text, similar_size), text)

    return map_rows(texts, row, f"{ROWS}, {SET}").withColumn("task", F.spark_partition_id())


def similar_links(marked: DataFrame, percent: int, size: int) -> DataFrame:
    """Links between fingerprints whose texts share that part of their shingles or have the same ones."""
    sets, found = set_links(marked, percent, size, "fp")
    own = sets.select(F.col("low").alias("own"), *NAMES)
    same = null_safe_join(marked.filter("n > 0").select("fp", *NAMES).distinct(), own, NAMES).filter("fp <> own").select(
        F.col("fp").alias("a"), F.col("own").alias("b"))
    for side in "ab":
        found = null_safe_join(found, sets.select(F.col("node").alias(side), F.col("low").alias(f"fp_{side}")), [side])
    return same.unionByName(found.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")))


def links(fps: DataFrame) -> DataFrame:
    """Links a < b (unsigned) that connect what lies within two bits; column ``fp`` holds distinct fingerprints."""
    replicas = fps.select("fp").mapInArrow(_replicate, StructType.fromDDL("anchor bigint, fp bigint"))
    runs = replicas.repartition("anchor").sortWithinPartitions("anchor")
    return runs.mapInArrow(_compare, StructType.fromDDL("a bigint, b bigint"))


def near_groups(docs: DataFrame, size: int = 3, similar: int | None = None, similar_size: int = 5, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp, component_id and first of every row.

    ``first`` marks the row of a component that stands for it: the smallest id, then text hash. With ``similar`` texts
    that share these per cent of their shingles of ``similar_size`` words are linked as well.
    """
    marked = materialize(fingerprints(docs, size, similar_size if similar else None, id_col, text_col), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    # Copies travel as one.
    nodes = materialize(marked.groupBy("fp").agg(F.min(rank).alias("low")).select("fp", "low"), "distinct-fingerprints")
    found = links(nodes)
    if similar:
        found = found.unionByName(similar_links(marked, similar, similar_size))
    roots = components(found)
    rooted = null_safe_join(nodes, roots.withColumnRenamed("node", "fp"), ["fp"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("low"))
    named = null_safe_join(rooted.select("fp", "root"), lowest, ["root"])
    return null_safe_join(marked.select("doc_id", "text_hash", "fp"), named, ["fp"]).select(
        "doc_id", "text_hash", "fp", F.col("low.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("text_hash") == F.col("low.text_hash"))).alias("first"))
