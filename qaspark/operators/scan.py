"""Running aggregates along an integer position, as a prefix scan of as many levels as the data needs.

A window over a whole group would put a hot group into one task. Here rows are windowed within chunks of the position;
chunk totals, thousands of times fewer, carry the running value across. Totals of a long group are cut into chunks again,
until a group has no more of them than one chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaspark.operators.lookups import null_safe_join
from qaspark.session import materialize

CHUNK = 4096

_AGGREGATES = {"min": F.min, "max": F.max, "sum": F.sum}


@dataclass(frozen=True)
class Running:
    """A running ``min``, ``max`` or ``sum`` of a value, with or without the current row."""

    value: Column
    how: str
    include_current: bool = True

    def combine(self, before: Column, local: Column) -> Column:
        if self.how == "sum":
            return F.coalesce(before, F.lit(0)) + F.coalesce(local, F.lit(0))
        # least and greatest skip nulls
        return F.least(before, local) if self.how == "min" else F.greatest(before, local)


def running(df: DataFrame, group: str, position: str, chunk: int = CHUNK, **columns: Running) -> DataFrame:
    """Add running aggregates along ``position`` within ``group``, all in one pass.

    Positions are unique whole numbers, dense up to a constant factor (epochs, row numbers).
    """
    rows = df.withColumn("_chunk", F.floor(F.col(position) / chunk))
    for name, r in columns.items():
        rows = rows.withColumn(f"_v_{name}", r.value)
    totals = rows.groupBy(group, "_chunk").agg(
        *[_AGGREGATES[r.how](f"_v_{name}").alias(f"_t_{name}") for name, r in columns.items()]
    )
    before = _before(materialize(totals, "totals"), group, chunk, columns)
    inside = Window.partitionBy(group, "_chunk").orderBy(position)
    for name, r in columns.items():
        frame = inside.rowsBetween(Window.unboundedPreceding, 0 if r.include_current else -1)
        rows = rows.withColumn(f"_l_{name}", _AGGREGATES[r.how](f"_v_{name}").over(frame))
    joined = null_safe_join(rows, before, [group, "_chunk"])
    return joined.select(
        *df.columns, *[r.combine(F.col(f"_b_{name}"), F.col(f"_l_{name}")).alias(name) for name, r in columns.items()]
    )


def _before(totals: DataFrame, group: str, chunk: int, columns: dict[str, Running]) -> DataFrame:
    """group, chunk and the aggregates of all chunks before it, from the totals of the chunks."""
    low, high = totals.agg(F.min("_chunk"), F.max("_chunk")).first()
    if low is None or high - low < chunk:  # a group has at most so many totals
        earlier = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        found = {name: _AGGREGATES[r.how](f"_t_{name}").over(earlier) for name, r in columns.items()}
        return totals.select(group, "_chunk", *[value.alias(f"_b_{name}") for name, value in found.items()])
    again = {f"_b_{name}": Running(F.col(f"_t_{name}"), r.how, include_current=False) for name, r in columns.items()}
    carried = running(totals.withColumnRenamed("_chunk", "_at"), group, "_at", chunk, **again)
    return carried.select(group, F.col("_at").alias("_chunk"), *again)


def row_number() -> Running:
    """The 1-based number of a row along a unique position."""
    return Running(F.lit(1).cast("bigint"), "sum")
