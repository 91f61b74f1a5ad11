"""Line dedup: range-partitioned line hashes, streamed in order, answered with keep bitmaps.

Each document gives one row per distinct line key: a 128-bit hash, the document's own key and the line numbers. The
rows are range-partitioned by hash and document and sorted within, so a line that is everywhere spans as many
partitions as it needs. A task streams its rows and decides a hash once ``min_docs`` documents are seen; it holds at
most that many rows. Runs that a partition boundary cuts and that no side can decide alone, a few rows for each
boundary, are decided together in a second small pass. What comes back is, for each document that loses lines, one
compressed bitmap of the lines to keep, never text.

``keep="none"`` drops every line of a key found in at least ``min_docs`` documents, ``keep="first"`` all but those of
the first document (by id, then text hash).

Defined results: a null or empty text is one empty line; keys shorter than ``min_chars`` never count; rows with equal id
and equal text are one document and get equal results; rows with a null id are documents like others; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from qaspark.llm.common import OUT_ROWS, flat_map_rows, map_rows, pick, to_batch
from qaspark.session import materialize

KEYED = "h1 bigint, h2 bigint, doc_id bigint, text_hash bigint, lines binary"
#: kind 0: dropped lines; 1: undecided rows of a cut run; 2: a cut run that this side has decided (dropped).
DECIDED = "kind int, h1 bigint, h2 bigint, part int, doc_id bigint, text_hash bigint, lines binary"
BITMAPS = "doc_id bigint, text_hash bigint, keep binary"


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text as bytes and the text's hash: id and hash tell documents apart."""
    plain = pick(docs, doc_id=id_col, text=text_col)
    return plain.selectExpr(
        "cast(doc_id as bigint) doc_id", "cast(coalesce(text, '') as binary) text", "xxhash64(coalesce(text, '')) text_hash")


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def _keys(doc_id: int | None, text: bytes, text_hash: int, min_chars: int) -> Iterator[tuple]:
    places: dict[bytes, list[int]] = {}
    for number, line in enumerate(text.split(b"\n")):
        key = line_key(line)
        if key and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
            places.setdefault(key, []).append(number)
    for key, numbers in places.items():
        h1, h2 = np.frombuffer(xxhash.xxh3_128_digest(key), "<i8").tolist()
        yield h1, h2, doc_id, text_hash, np.array(numbers, "<u4").tobytes()


class _Run:
    """One hash run while it streams past."""

    def __init__(self, min_docs: int, keep_first: bool):
        self.min_docs, self.keep_first = min_docs, keep_first
        self.key = self.last = self.first = None
        self.docs = 0
        self.held: list[tuple] = []

    def start(self, key: tuple) -> None:
        self.key, self.last, self.first, self.docs, self.held = key, None, None, 0, []

    def add(self, row: tuple) -> list[tuple]:
        """Rows that are now known to drop."""
        doc = row[2:4]
        if doc != self.last:
            self.docs += 1
            self.last = doc
            if self.first is None:
                self.first = doc
        if self.docs < self.min_docs:
            self.held.append(row)
            return []
        ready, self.held = [*self.held, row], []
        return ready


def _stream(min_docs: int, keep_first: bool, arrow: pa.Schema):
    """A task's decisions over its sorted rows. The runs at either end may go on in a neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = _Run(min_docs, keep_first), []
        part, leading = 0, True

        def close(trailing: bool) -> None:
            if state.key is None:
                return
            if leading or trailing:
                out.extend((1, *row[:2], part, *row[2:]) for row in state.held)
                if state.docs >= min_docs:
                    out.append((2, *state.key, part, *state.first, None))

        for batch in batches:
            for part, *row in zip(*(column.to_pylist() for column in batch.columns)):
                row = tuple(row)
                if row[:2] != state.key:
                    if state.key is not None:
                        close(False)
                        leading = False
                    state.start(row[:2])
                for dropped in state.add(row):
                    # The first document of a cut run may lie in another partition: decided later.
                    if keep_first and dropped[2:4] == state.first:
                        if leading:
                            out.append((1, *dropped[:2], part, *dropped[2:]))
                        continue
                    out.append((0, *dropped[:2], part, *dropped[2:]))
            if len(out) >= OUT_ROWS:
                yield to_batch(out, arrow)
                out.clear()
        close(True)
        if out:
            yield to_batch(out, arrow)

    return run


def dropped_lines(docs: DataFrame, min_docs: int = 10, keep: str = "none", min_chars: int = 1,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and lines (32-bit numbers) to drop; several rows for one document."""
    if keep not in ("none", "first") or min_docs < 1 or min_chars < 1:
        raise ValueError("keep is 'none' or 'first'; min_docs and min_chars are at least 1")
    struct = StructType.fromDDL(DECIDED)
    keys = flat_map_rows(
        keyed_text(docs, id_col, text_col), lambda d, t, h: _keys(d, t, h, min_chars), KEYED)
    ordered = (
        keys.repartitionByRange("h1", "h2", "doc_id", "text_hash")
        .sortWithinPartitions("h1", "h2", "doc_id", "text_hash")
        .select(F.spark_partition_id().alias("part"), "*")
    )
    decided = materialize(ordered.mapInArrow(_stream(min_docs, keep == "first", to_arrow_schema(struct)), struct), "line-runs")
    # Cut runs: documents of all sides together. A document is in one partition only, as it is part of the range.
    cut = decided.filter("kind > 0")
    totals = cut.groupBy("h1", "h2").agg(
        F.countDistinct(F.when(F.col("kind") == 1, F.struct(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "text_hash"))).alias("docs"),
        F.max(F.col("kind") == 2).alias("known"),
        F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "text_hash")).alias("first"),
    ).filter(F.col("known") | (F.col("docs") >= min_docs))
    late = cut.filter("kind = 1").join(totals, ["h1", "h2"])
    if keep == "first":
        late = late.filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))))
    columns = ("doc_id", "text_hash", "lines")
    return decided.filter("kind = 0").select(*columns).unionByName(late.select(*columns))


def _bitmap(lines: list[bytes]) -> bytes:
    dropped = np.frombuffer(b"".join(lines), "<u4")
    keep = np.ones(int(dropped.max()) // 8 * 8 + 8, dtype=bool)  # whole bytes
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def keeps(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """A flag for each line; lines beyond the last dropped one stay."""
    flags = np.ones(n_lines, dtype=bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), "u1"))[:n_lines].astype(bool)
        flags[:len(bits)] = bits
    return flags


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep: str = "none", min_chars: int = 1,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One compressed keep bitmap for each document that loses lines (see ``keeps``)."""
    dropped = dropped_lines(docs, min_docs, keep, min_chars, id_col, text_col)
    gathered = dropped.groupBy("doc_id", "text_hash").agg(F.collect_list("lines").alias("lines"))
    return map_rows(gathered, lambda doc_id, text_hash, lines: (doc_id, text_hash, _bitmap(lines)), BITMAPS)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (bytes) and keep (null: all lines) of every row."""
    plain = keyed_text(docs, id_col, text_col).alias("d")
    found = bitmaps.alias("b")
    return plain.join(
        found, F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.text_hash") == F.col("b.text_hash")), "left"
    ).select("d.doc_id", "d.text", "b.keep")


def kept_text(text: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """What stays of a text, its number of lines and how many go."""
    lines = text.split(b"\n")
    if bitmap is None:
        return text, len(lines), 0
    flags = keeps(bitmap, len(lines))
    stay = [line for line, kept in zip(lines, flags) if kept]
    return b"\n".join(stay), len(lines), len(lines) - len(stay)
