"""Region feature files: ten tab-separated fields, six of them base64 arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Field names in file order, and the element type of each encoded array.
FIELDS = (
    "img_id", "img_h", "img_w", "objects_id", "objects_conf",
    "attrs_id", "attrs_conf", "num_boxes", "boxes", "features",
)
ELEMENTS = {
    "objects_id": np.dtype("<i8"), "objects_conf": np.dtype("<f4"),
    "attrs_id": np.dtype("<i8"), "attrs_conf": np.dtype("<f4"),
    "boxes": np.dtype("<f4"), "features": np.dtype("<f4"),
}
NESTED = ("boxes", "features")

ENCODED_SCHEMA = (
    "img_id string, img_h bigint, img_w bigint, objects_id binary, objects_conf binary,"
    "attrs_id binary, attrs_conf binary, num_boxes bigint, boxes binary, features binary"
)


def _decode(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column and the value offset of each row, without per-row work."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    values = raw[offsets[0]:offsets[-1]].tobytes()
    return np.frombuffer(values, dtype=dtype), (offsets - offsets[0]) // dtype.itemsize


def _nest(values: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of ``counts`` equal-length vectors each."""
    sizes = np.diff(offsets)
    widths = np.divide(sizes, counts, out=np.zeros_like(sizes, dtype=np.int64), where=counts > 0, casting="unsafe")
    inner = np.concatenate([[0], np.cumsum(np.repeat(widths, counts))]).astype(np.int32)
    outer = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    vectors = pa.ListArray.from_arrays(pa.array(inner), pa.array(values))
    return pa.ListArray.from_arrays(pa.array(outer), vectors)


def _decoder(name: str):
    """The array of one field as an Arrow function; it runs only where the field is asked for."""
    dtype, element = ELEMENTS[name], "bigint" if ELEMENTS[name].kind == "i" else "float"
    if name in NESTED:
        @F.arrow_udf(f"array<array<{element}>>")
        def decode(column: pa.Array, counts: pa.Array) -> pa.Array:
            return _nest(*_decode(column.cast(pa.binary()), dtype), counts.to_numpy(zero_copy_only=False).astype(np.int64))

        return lambda: decode(F.col(name), F.col("num_boxes")).alias(name)

    @F.arrow_udf(f"array<{element}>")
    def decode_flat(column: pa.Array) -> pa.Array:
        values, offsets = _decode(column.cast(pa.binary()), dtype)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))

    return lambda: decode_flat(F.col(name)).alias(name)


def decode_regions(encoded: DataFrame) -> DataFrame:
    """Binary array columns to typed (nested) arrays.

    Every field is a column of its own: one that is not selected is neither decoded nor, from a file, parsed.
    """
    return encoded.select(*[_decoder(name)() if name in ELEMENTS else F.col(name) for name in FIELDS])


def _flat_values(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    while isinstance(values, pa.ListArray):
        deeper = values.offsets.to_numpy().astype(np.int64)
        offsets = deeper[offsets]
        values = values.values
    return np.ascontiguousarray(values.to_numpy(zero_copy_only=False).astype(dtype)), offsets


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = []
        for name in FIELDS:
            column = batch.column(name)
            if name in ELEMENTS:
                dtype = ELEMENTS[name]
                values, offsets = _flat_values(column, dtype)
                values = values[offsets[0]:offsets[-1]]
                ends = ((offsets - offsets[0]) * dtype.itemsize).astype(np.int32)
                column = pa.Array.from_buffers(
                    pa.binary(), len(column), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())]
                )
            columns.append(column)
        yield pa.RecordBatch.from_arrays(columns, names=list(FIELDS))


def encode_regions(regions: DataFrame) -> DataFrame:
    """Typed arrays back to base64 text columns, in file order."""
    packed = regions.select(*FIELDS).mapInArrow(_encode_batches, ENCODED_SCHEMA)
    # The encoder breaks long lines; a record must stay on one.
    return packed.select(
        *[F.translate(F.base64(f), "\r\n", "").alias(f) if f in ELEMENTS else F.col(f) for f in FIELDS]
    )


def _first_lines(lines: DataFrame, n: int) -> DataFrame:
    placed = lines.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"))
    blocks = placed.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_place").alias("first")).orderBy("_file", "_block")
    keep, left = F.lit(False), n
    for block in blocks.collect():  # one row for each block of a file
        if left <= 0:
            break
        inside = (F.col("_file") == block["_file"]) & (F.col("_block") == block["_block"])
        keep = keep | (inside & (F.col("_place") < block["first"] + left))
        left -= block["n"]
    return placed.filter(keep).drop("_file", "_block", "_place")


def read_regions_tsv(spark: SparkSession, path: str, topk: int | None = None) -> DataFrame:
    """Decoded regions; ``topk`` keeps the first lines in file order, ``None`` or -1 all of them.

    Lines are counted per block of a file; blocks before the last one asked for are kept whole and that one up to
    the line, each where it is read. (The driver gets one number for each block, so it holds a row for every
    ``spark.sql.files.maxPartitionBytes`` of the files.) Select the fields that are needed: others are not decoded.
    """
    text_schema = ", ".join(
        f"{f} {'bigint' if f in ('img_h', 'img_w', 'num_boxes') else 'string'}" for f in FIELDS
    )
    lines = (
        spark.read.schema(text_schema).option("sep", "\t").option("quote", "")
        .option("maxCharsPerColumn", -1).option("mode", "FAILFAST").csv(path)
    )
    if topk is not None and topk != -1:
        lines = _first_lines(lines, topk)
    return decode_regions(
        lines.select(*[F.unbase64(F.coalesce(f, F.lit(""))).alias(f) if f in ELEMENTS else F.col(f) for f in FIELDS])
    )


def write_regions_tsv(regions: DataFrame, path: str) -> None:
    encode_regions(regions).write.option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)


# Region files by name and the image folder of each, relative to the root.
REGION_IMAGES = {
    "vivqa_obj36.tsv": "data/vivqa/images",
    "openvivqa_train_obj36.tsv": "data/openvivqa/training-images",
    "openvivqa_dev_obj36.tsv": "data/openvivqa/dev-images",
    "openvivqa_test_obj36.tsv": "data/openvivqa/test-images",
    "vitextvqa_obj36.tsv": "data/vitextvqa/images",
    "viocrvqa_obj36.tsv": "data/viocrvqa/images",
    "evjvqa_obj36.tsv": "data/evjvqa/images",
}
