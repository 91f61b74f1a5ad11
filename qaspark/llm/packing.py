"""Bounded-space online best-fit packing of token pieces into sequences.

A task takes its pieces one by one. Open bins are stacks keyed by free space, and one integer serves as a bitset of
the free sizes in use, so the tightest bin that still fits is one shift and one lowest-bit step away. At most
``open_bins`` stay open; the fullest closes first. Rows hold lengths and checksums only, never ids, so packing moves a
few dozen bytes a document; texts are tokenised where they are read.

Pieces are dealt to tasks by a hash of their document, about ``per_task`` to a task, and come longest first; the order
is total, so a lost task gives the same bins again.

Defined results: a null or empty text is one piece of the end token alone; rows are packed as they come, repeats
included; an empty table packs to no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from qaspark.llm.common import OUT_ROWS, flat_map_rows, pick, to_batch
from qaspark.llm.word_ids import word_tokens

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = PIECES + ", sequence_id bigint, offset bigint"
END = b"\x00\x00\x00\x00"


class BestFit:
    """Online best-fit with a fixed number of open bins; ``put`` returns (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.in_use = 0  # bit f is set when a bin with f free places is open
        self.n_open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        taken = bins.pop()
        if not bins:
            self.in_use ^= 1 << free
        return taken

    def put(self, length: int) -> tuple[int, int]:
        fitting = self.in_use >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            place = self._take(free)
        else:
            free, place = self.capacity, self.made
            self.made += 1
            self.n_open += 1
        left = free - length
        if left:
            bins = self.by_free[left]
            if not bins:
                self.in_use |= 1 << left
            bins.append(place)
            if self.n_open > self.open_bins:
                self._take((self.in_use & -self.in_use).bit_length() - 1)
                self.n_open -= 1
        else:
            self.n_open -= 1
        return place, free_offset(self.capacity, free)


def free_offset(capacity: int, free: int) -> int:
    return capacity - free


def cut(doc_id: int | None, text: bytes | None, capacity: int, ids_of: Callable[[bytes], bytes]) -> list[tuple]:
    """The pieces of one document: ids as little-endian 32-bit numbers, an end token last."""
    ids = memoryview(ids_of(text or b"") + END)
    step = 4 * capacity
    return [
        (doc_id, place // step, place // 4, (min(place + step, len(ids)) - place) // 4, zlib.crc32(ids[place:place + step]))
        for place in range(0, len(ids), step)
    ]


def pieces(docs: DataFrame, capacity: int = 2048, ids_of: Callable[[bytes], bytes] = word_tokens,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenised documents as rows of at most ``capacity`` tokens."""
    plain = pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as binary) text")
    return flat_map_rows(plain, lambda doc_id, text: cut(doc_id, text, capacity, ids_of), PIECES)


def pack(rows: DataFrame, capacity: int = 2048, open_bins: int = 65_536, tasks: int = 16) -> DataFrame:
    """Rows of ``PIECES`` with the sequence and offset of each."""
    struct = StructType.fromDDL(PLACED)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 40
        bins = BestFit(capacity, open_bins)
        for batch in batches:
            out = []
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                place, offset = bins.put(row[3])
                out.append((*row, first + place, offset))
            for start in range(0, len(out), OUT_ROWS):
                yield to_batch(out[start:start + OUT_ROWS], arrow)

    dealt = rows.repartition(tasks, "doc_id", "piece", "ids_crc32").sortWithinPartitions(
        F.desc("length"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(run, struct)


def pack_documents(docs: DataFrame, capacity: int = 2048, open_bins: int = 65_536, per_task: int = 100_000,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document in as few sequences as best-fit finds; one row per piece."""
    n = docs.count()  # rows only: no column is read
    return pack(pieces(docs, capacity, id_col=id_col, text_col=text_col), capacity, open_bins, max(1, -(-n // per_task)))
