"""Helpers of the training-data operators: exact column choice, Arrow row maps, bounded memos."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns by their exact names, as new names; whatever else the table has is left out.

    ``pick(df, doc_id="id", text="body")``. Names are matched by case and position, so columns that differ only
    in case, hold dots or repeat (the first one counts) do no harm.
    """
    places = {}
    for place, name in enumerate(df.columns):
        places.setdefault(name, place)
    missing = [name for name in wanted.values() if name not in places]
    if missing:
        raise ValueError(f"no column {missing} among {df.columns}")
    plain = df.toDF(*(f"c{place}" for place in range(len(df.columns))))
    return plain.select(*(F.col(f"c{places[old]}").alias(new) for new, old in wanted.items()))


def map_rows(df: DataFrame, function: Callable[..., Iterable], schema: str) -> DataFrame:
    """One output row per input row: ``function(*values) -> values``, in Arrow batches."""
    return flat_map_rows(df, lambda *row: (function(*row),), schema)


def flat_map_rows(df: DataFrame, function: Callable[..., Iterable[Iterable]], schema: str) -> DataFrame:
    """Any number of output rows per input row, a batch of at most ``OUT_ROWS`` at a time."""
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        for batch in batches:
            for start in range(0, len(batch), IN_ROWS):
                for row in zip(*(column.to_pylist() for column in batch.slice(start, IN_ROWS).columns)):
                    out.extend(function(*row))
                if len(out) >= OUT_ROWS:
                    yield to_batch(out, arrow)
                    out = []
        if out:
            yield to_batch(out, arrow)

    return df.mapInArrow(run, struct)


#: Rows held as Python objects at a time: texts are a few kilobytes, and a worker has a few hundred megabytes.
IN_ROWS = 500
OUT_ROWS = 4_000


def to_batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=field.type) for values, field in zip(columns, schema)], schema=schema
    )


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, rows: int):
    """Jobs run inside give Python workers at most so many rows at once: for tables whose rows are large."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def sorted_lists(spark: SparkSession):
    """Jobs run inside collect lists from sorted rows, so a task holds one key's list on the heap and not those of many keys."""
    return _setting(spark, "spark.sql.execution.useObjectHashAggregateExec", "false")


class Memo(dict):
    """``memo[key]`` calls ``make(key)`` once; holds the last ``size`` to ``2 * size`` keys that were new or came again."""

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
