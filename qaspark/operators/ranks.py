"""Global order without a one-task sort: exact rank selection and dense ids."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from qaspark.session import materialize, release


#: Quantiles of the sketch that brackets ranks, its accuracy, and hexadecimal digits of a key that make a number.
QUANTILES, ACCURACY, NUMBER_DIGITS = 500, 10_000, 13  # 52 bits: the sketch holds doubles


def select_ranks(
    df: DataFrame, key: str, ranks: Callable[[int], Iterable[int]], weight: str | None = None, step: int = 3
) -> dict[int, str]:
    """Keys at 0-based ranks, exactly, for fixed-width string keys of (hexadecimal) digits; ``ranks`` gets the row total.

    Two passes over the rows, whatever their number. A quantile sketch, merged map-side, brackets every rank between two
    of its quantiles with some hundredths of a per cent to spare; the second pass writes the rows inside the brackets
    and counts those below. The rest is done on these few rows by histograms of digits. Rows with a ``weight`` are
    profiles already, a thousand times fewer than what they count: they take the histograms at once.
    """
    if weight is not None:
        return _by_digits(df, key, ranks, weight, step)
    number = F.conv(F.substring(key, 1, NUMBER_DIGITS), 16, 10).cast("bigint")
    marks = [k / QUANTILES for k in range(QUANTILES + 1)]
    total, quantiles = df.agg(F.count(key), F.percentile_approx(number, marks, ACCURACY)).first()
    asked = sorted(set(ranks(total)))
    if asked and not 0 <= asked[0] <= asked[-1] < total:
        raise IndexError(f"ranks {asked} are beyond the data")
    brackets: list[tuple[int, int, list[int]]] = []
    for rank in asked:
        place = int(rank / total * QUANTILES)
        low, high = quantiles[max(place - 1, 0)] if place > 1 else 0, quantiles[min(place + 2, QUANTILES)] if place + 2 < QUANTILES else 16 ** NUMBER_DIGITS
        if brackets and low <= brackets[-1][1]:
            brackets[-1] = (brackets[-1][0], max(high, brackets[-1][1]), [*brackets[-1][2], rank])
        else:
            brackets.append((low, high, [rank]))
    if not brackets:
        return {}
    counted = Observation()
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), number.alias("number")).observe(
        counted, *[F.count_if(F.col("number") < low).alias(f"below_{k}") for k, (low, _, _) in enumerate(brackets)])
    inside = reduce(or_, [F.col("number").between(low, high) for low, high, _ in brackets])
    kept = materialize(rows.filter(inside), "brackets")
    below = counted.get
    found: dict[int, str] = {}
    for k, (low, high, own) in enumerate(brackets):
        part = kept.filter(F.col("number").between(low, high))
        first = below[f"below_{k}"]
        here = part.count()
        if not first <= own[0] <= own[-1] < first + here:  # the sketch erred by more than its bound
            return _by_digits(df, key, lambda _: asked, None, step)
        own_keys = _by_digits(part, "key", lambda _, own=own, first=first: [rank - first for rank in own], None, step)
        found.update((rank + first, value) for rank, value in own_keys.items())
    release(kept)
    return found


def _by_digits(df: DataFrame, key: str, ranks: Callable[[int], Iterable[int]], weight: str | None, step: int) -> dict[int, str]:
    """Keys at ranks by histograms.

    One histogram per ``step`` characters narrows the search to the bucket that holds the rank. Each
    pass is a map-side combined count with at most ``16 ** step`` groups for hexadecimal keys
    (``10 ** step`` for decimal ones), so nothing that grows with the data reaches one task or the
    driver, and the exact answer needs no global sort.
    """
    unit = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")

    def histogram(rows: DataFrame, depth: int) -> list:
        counted = rows.groupBy(F.substring(key, 1, depth).alias("prefix")).agg(
            F.sum(unit).alias("n"), F.min(F.col(key)).alias("low"), F.max(F.col(key)).alias("high")
        )
        return sorted(counted.collect())

    depth = step
    buckets = histogram(df, depth)
    found: dict[int, str] = {}
    open_ranks = {rank: ("", rank) for rank in ranks(sum(b["n"] for b in buckets))}  # -> prefix, rank inside
    while open_ranks:
        following = {}
        for rank, (prefix, inside) in open_ranks.items():
            for bucket in buckets:
                if not bucket["prefix"].startswith(prefix):
                    continue
                if inside < bucket["n"]:
                    if bucket["low"] == bucket["high"]:
                        found[rank] = bucket["low"]
                    else:
                        following[rank] = (bucket["prefix"], inside)
                    break
                inside -= bucket["n"]
            else:
                raise IndexError(f"rank {rank} is beyond the data")
        open_ranks = following
        if open_ranks:
            prefixes = sorted({prefix for prefix, _ in open_ranks.values()})
            narrowed = df.filter(F.substring(key, 1, depth).isin(*prefixes))
            depth += step
            buckets = histogram(narrowed, depth)
    return found


# Unit-interval values are compared at ten decimals, which is what the fixed-width key carries.
KEY_DIGITS = 11


def unit_key(value: Column) -> Column:
    """Fixed-width decimal key of a value in [0, 1]."""
    return F.lpad(F.round(value * 1e10).cast("bigint").cast("string"), KEY_DIGITS, "0")


def unit_percentile(df: DataFrame, value: str, fraction: float, weight: str | None = None) -> float:
    """Linearly interpolated percentile of values in [0, 1], to ten decimals; 0 for no rows."""
    keyed = df.select(unit_key(F.col(value)).alias("key"), *([weight] if weight else []))
    places: list[tuple[int, int, float]] = []

    def ranks(total: int) -> list[int]:
        if not total:
            return []
        position = fraction * (total - 1)
        lower = math.floor(position)
        places.append((lower, min(total - 1, lower + 1), position - lower))
        return sorted(set(places[0][:2]))

    keys = select_ranks(keyed, "key", ranks, weight, step=4)
    if not places:
        return 0.0
    lower, upper, part = places[0]
    low, high = int(keys[lower]) / 1e10, int(keys[upper]) / 1e10
    return low if low == high else low * (1 - part) + high * part


def dense_ids(values: DataFrame, column: str, id_column: str) -> DataFrame:
    """Distinct values with dense 0-based ids in code-point order.

    Values are range-partitioned and written once with their place in the partition; the partition
    offsets (one row per partition) are added afterwards. Writing first fixes the partition bounds,
    which sampling could otherwise draw differently on a retry.
    """
    spark = values.sparkSession
    place = F.monotonically_increasing_id()
    ordered = (
        values.select(column).where(F.col(column).isNotNull()).distinct()
        .repartitionByRange(F.col(column))
        .sortWithinPartitions(column)
        .withColumn("_place", place)
    )
    stored = materialize(ordered, "ids")
    part = F.shiftright(F.col("_place"), 33)
    sizes = stored.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    offsets, running = [], 0
    for size in sizes:
        offsets.append((size["_part"], running))
        running += size["count"]
    bounds = spark.createDataFrame(offsets, "_part bigint, _offset bigint")
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(bounds), "_part")  # one row per partition of the sort
        .select(column, (F.col("_offset") + inside).alias(id_column))
    )
