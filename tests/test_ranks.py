"""Distributed ranks, percentiles, dense ids, splits and running aggregates against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from qaspark.operators import evaluate, labels, ranks, scan, split


def percentile(values, fraction):
    ordered = sorted(values)
    position = fraction * (len(ordered) - 1)
    low = math.floor(position)
    high = min(len(ordered) - 1, low + 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (position - low)


@pytest.mark.parametrize("values", [
    [0.5], [0.25] * 40, [0.0, 1.0], [i / 997 for i in range(998)], [0.3] * 300 + [0.9] * 5 + [0.123456789] * 7,
])
@pytest.mark.parametrize("fraction", [0.0, 0.5, 0.8, 1.0])
def test_percentile(spark, values, fraction):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert ranks.unit_percentile(df, "v", fraction) == pytest.approx(percentile(values, fraction), abs=1e-9)
    counted = df.groupBy("v").agg(F.count("*").alias("n"))
    assert ranks.unit_percentile(counted, "v", fraction, "n") == pytest.approx(percentile(values, fraction), abs=1e-9)


def test_dense_ids_are_a_bijection_in_code_point_order(spark):
    words = ["b", "B", "á", "a", "Z", "", "ạ", "zz", "😀", "a", "b"] + [f"w{i}" for i in range(500)]
    rows = spark.createDataFrame([(w,) for w in words] + [(None,)], "answer string")
    got = {r.answer: r.label for r in labels.fit_encoder(rows.repartition(9)).collect()}
    assert got == {w: i for i, w in enumerate(sorted(set(words)))}


def test_split_sizes_and_leaks(spark):
    images = spark.range(997).select(F.col("id").alias("image_id"))
    parts = split.split_images(images).groupBy("split").count().collect()
    sizes = {r["split"]: r["count"] for r in parts}
    train, val = int(997 * (0.7 / 1.1)), int(997 * (0.3 / 1.1))
    assert sizes == {"train": train, "val": val, "test": 997 - train - val}
    rows = spark.range(5000).select((F.col("id") % 1200).alias("image_id"), "id")
    joined = split.group_split(rows, images)
    assert joined.groupBy("image_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert joined.filter("image_id >= 997").count() == 0


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_splits(spark, n):
    images = spark.range(n).select(F.col("id").alias("image_id"))
    assert split.split_images(images).count() == n


def test_all_in_one_split(spark):
    images = spark.range(10).select(F.col("id").alias("image_id"))
    assert {r["split"] for r in split.split_images(images, {"a": 1.0, "b": 0.0}).collect()} == {"a"}


def test_samples_are_exact_and_fresh_per_epoch(spark):
    rows = spark.range(1000)
    drawn = split.sample_per_epoch(rows, 5, "id", 4).collect()
    assert {(r.epoch, r.sample_id) for r in drawn} == {(e, s) for e in range(4) for s in range(5)}
    assert len({frozenset(r.id for r in drawn if r.epoch == e) for e in range(4)}) == 4
    assert split.sample_rows(rows, 2000, "id").count() == 1000
    large = spark.range(30_000)
    for n in (10_001, 29_999, 30_000, 40_000):
        assert split.sample_rows(large, n, "id").distinct().count() == min(n, 30_000)


def test_samples_with_repeated_and_missing_keys(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, null, id % 50) as k", "id as v")
    for n in (1, 999, 1001, 2999):
        drawn = split.sample_rows(rows, n, "k")
        assert drawn.count() == n and drawn.select("v").distinct().count() == n
    same = spark.range(100).selectExpr("1 as k")
    assert split.sample_rows(same, 40, "k").count() == 40


def test_running_aggregates_across_chunks(spark):
    random.seed(3)
    data = [(g, p, random.randint(0, 50)) for g in "ab" for p in range(60)]
    df = spark.createDataFrame(data, "g string, p bigint, v bigint").repartition(5)
    got = scan.running(
        df, "g", "p", chunk=7, low=scan.Running(F.col("v"), "min", False), top=scan.Running(F.col("v"), "max"),
        n=scan.row_number(), total=scan.Running(F.col("v"), "sum"),
    ).collect()
    assert len(got) == len(data)
    for r in got:
        before = [v for g, p, v in data if g == r.g and p < r.p]
        upto = before + [r.v]
        assert (r.low, r.top, r.n, r.total) == (min(before, default=None), max(upto), len(upto), sum(upto))


def stop_epoch(losses, patience):
    best, counter = None, 0
    for epoch, loss in enumerate(losses):
        if best is None or loss < best:
            best, counter = loss, 0
        else:
            counter += 1
        if counter >= patience:
            return epoch
    return None


def test_early_stop_and_best(spark):
    random.seed(5)
    runs = {f"r{i}": [random.random() for _ in range(random.randint(1, 40))] for i in range(12)}
    runs["flat"] = [0.5] * 9
    runs["falling"] = [1 - i / 50 for i in range(30)]
    data = [(r, e, loss, 1 - loss) for r, ls in runs.items() for e, loss in enumerate(ls)] + [("none", 0, 1.0, 0.0)]
    df = spark.createDataFrame(data, "run_id string, epoch bigint, eval_loss double, eval_accuracy double").repartition(4)
    for patience in (1, 3):
        got = {r.run_id: r.stop_epoch for r in evaluate.early_stops(df, patience).collect()}
        assert all(got[r] == stop_epoch(ls, patience) for r, ls in runs.items())
    assert {r.stop_epoch for r in evaluate.early_stops(df, 0).collect()} == {None}
    best = {r.run_id: (r.best_accuracy, r.best_epoch) for r in evaluate.best_accuracy(df).collect()}
    assert best["none"] == (0.0, 0) and best["flat"] == (0.5, 0)


def test_scratch_folders_go_with_their_owner(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from qaspark.session import materialize, scratch, scratch_root

    root = Path(urlparse(scratch_root(spark)).path)
    with scratch(spark):
        assert materialize(spark.range(5), "owned").count() == 5
        assert list(root.glob("owned-*"))
    assert not list(root.glob("owned-*"))


def test_draws_with_repeated_keys(spark):
    """A key that half of the rows share, keys without a value, more rows asked for than there are: as rows ranked one by one."""
    import hashlib

    keys = ["hot"] * 400 + [f"k{k}" for k in range(300)] + ["twice"] * 2 + [None] * 30
    df = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k string, n int").repartition(5)
    for n in (1, 7, 350, 732, 1000):
        found = split.sample_per_epoch(df, n, "k", 6, seed=3)
        by_epoch = {}
        for r in found.collect():
            by_epoch.setdefault(r.epoch, {})[r.sample_id] = r.k
        for epoch in range(6):
            ranked = sorted(keys, key=lambda k: (hashlib.md5(f"{k or ''}:{epoch}:3".encode()).hexdigest(), k or ""))[:n]
            assert by_epoch[epoch] == dict(enumerate(ranked))
    assert split.sample_per_epoch(df.limit(0), 3, "k", 2).count() == 0 and split.sample_per_epoch(df, 0, "k", 2).count() == 0


def test_draws_read_the_rows_once(spark):
    drawn = split.sample_per_epoch(spark.range(5000).withColumn("k", F.col("id") % 700), 20, "k", 3)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan  # the keys with their weights were counted once and read back
    assert drawn.groupBy("epoch").count().filter("count = 20").count() == 3


def test_ranks_take_two_passes(spark):
    """Keys of many digits, a value that half of the rows share, neighbours in the last digits: two passes and the exact keys."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, F.lit("7f" * 16)).otherwise(
        F.concat(F.substring(F.md5(F.col("id").cast("string")), 1, 3), F.lower(F.lpad(F.hex("id"), 29, "0")))).alias("key"))
    scans = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            scans.add(len(batch))
            yield batch

    found = ranks.select_ranks(rows.mapInArrow(seen, "key string"), "key", lambda n: [0, n // 3, n // 2, n // 2 + 1, n - 1])
    every = sorted(r.key for r in rows.collect())
    assert found == {rank: every[rank] for rank in (0, 20_000, 30_000, 30_001, 59_999)}
    assert scans.value == 2 * 60_000
