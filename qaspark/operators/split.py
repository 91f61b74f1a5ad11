"""Image-grouped splits and deterministic sampling."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.operators.lookups import null_safe_join
from qaspark.operators.ranks import select_ranks
from qaspark.operators.scan import CHUNK, Running, running
from qaspark.session import materialize

# Default shares, which are normalised by their sum.
RATIOS = {"train": 0.7, "val": 0.3, "test": 0.1}


def order_key(identifier: Column, seed: int) -> Column:
    """Uniform 32-digit key that orders ids the same way on every engine."""
    return F.md5(F.concat(identifier.cast("string"), F.lit(f":{seed}")))


def split_images(images: DataFrame, ratios: Mapping[str, float] = RATIOS, seed: int = 42) -> DataFrame:
    """Add ``split`` to distinct ``image_id`` rows with exact split sizes.

    The images in hash order are cut at the ranks the ratios give. Only the keys at the cuts are
    looked up, so labelling an image is a comparison with constants and needs no global sort. Keys
    are written once, as several counting passes read them.
    """
    names = list(ratios)
    keyed = materialize(
        images.select("image_id").filter("image_id is not null").distinct().withColumn("_key", order_key(F.col("image_id"), seed)), "split-keys"
    )
    share = sum(ratios.values())
    cuts: dict[str, int] = {}

    def ranks(total: int) -> list[int]:
        end = 0
        for name in names[:-1]:
            end += int(total * (ratios[name] / share))
            cuts[name] = end
        return sorted({c for c in cuts.values() if c < total})

    keys = select_ranks(keyed, "_key", ranks)
    label = F.lit(names[-1])
    for name in reversed(names[:-1]):
        # A cut at the end of the data has no key: everything before it is inside.
        inside = F.col("_key") < F.lit(keys[cuts[name]]) if cuts[name] in keys else F.lit(True)
        label = F.when(inside, F.lit(name)).otherwise(label)
    named = keyed.withColumn("split", label).drop("_key")
    # Without further columns the ids are all there is; else every listed row keeps its columns.
    return named if images.columns == ["image_id"] else images.join(named, "image_id")


def group_split(
    annotations: DataFrame, images: DataFrame, ratios: Mapping[str, float] = RATIOS, seed: int = 42
) -> DataFrame:
    """Annotations with the ``split`` of their image; annotations of unlisted images vanish.

    ``images`` may come with a ``split`` already (from ``split_images``), which is then used.
    """
    ready = images if "split" in images.columns else split_images(images.select("image_id"), ratios, seed)
    return null_safe_join(annotations, ready.select("image_id", "split").distinct(), ["image_id"])


def split_statistics(image_splits: DataFrame, annotation_splits: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """``split, images, image_percent, annotations``; ``names`` are splits to report even when they are empty."""
    counts = image_splits.groupBy("split").agg(F.count("*").alias("images"))
    if names:
        every = image_splits.sparkSession.createDataFrame([(name,) for name in names], "split string")
        counts = every.join(counts, "split", "left").withColumn("images", F.coalesce("images", F.lit(0)))
    total = counts.agg(F.sum("images").alias("total"))
    rows = annotation_splits.groupBy("split").agg(F.count("*").alias("annotations"))
    return (
        counts.join(rows, "split", "left")
        .withColumn("image_percent", F.round(F.col("images") * 100.0 / total.scalar(), 1))
        .withColumn("annotations", F.coalesce("annotations", F.lit(0)))
    )


def _hashed(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, or all if there are fewer: those with the smallest hash of a key.

    Rows that share a key (or have none) follow each other by the hash of the whole row. The key at the last
    rank is looked up by histograms, so a sample of any size is a filter; only rows equal to the last one are
    counted off.
    """
    if n <= 0:
        return df.limit(0)
    whole = F.lpad(F.hex(F.xxhash64(*df.columns)), 16, "0")
    keyed = df.withColumn("_key", F.concat(_hashed(F.col(key), F.lit(seed)), F.lower(whole)))
    last = select_ranks(keyed.select("_key"), "_key", lambda total: [n - 1] if n < total else [])
    if not last:
        return keyed.drop("_key")
    inside, equal = keyed.filter(F.col("_key") < last[n - 1]), keyed.filter(F.col("_key") == last[n - 1])
    return inside.unionByName(equal.limit(n - inside.count())).drop("_key")


def sample_per_epoch(df: DataFrame, n: int, key: str, epochs: int, seed: int = 0) -> DataFrame:
    """``n`` rows per epoch, drawn anew for each epoch; adds ``epoch`` and ``sample_id``.

    Every epoch draws from all rows: those whose key has the smallest hash with the epoch, rows of one key together.
    Rows are counted by key first, so a key that comes often is one row with a weight. The smallest ``n`` hashes hold ``n``
    rows or more, and hashes are uniform: one pass keeps the keys below a bound that leaves few more than ``n`` of them,
    and the draw is exact because the rows under the bound are counted (it is doubled in the case, about one in 10^9, that
    they are too few). Running sums of the weights, chunk by chunk of the hash range, say where the draw ends.
    """
    if n <= 0 or epochs <= 0:
        return df.select(key, F.lit(0).alias("epoch"), F.lit(0).cast("bigint").alias("sample_id")).limit(0)
    keys = materialize(df.groupBy(key).agg(F.count("*").alias("weight")), "sample-keys")
    distinct, total = keys.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    wanted = min(n, total)
    drawn = keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    place = F.conv(F.substring(_hashed(F.col(key), F.col("epoch"), F.lit(seed)), 1, HASH_DIGITS), 16, 10).cast("bigint")
    hashed = drawn.withColumn("_place", place)
    limit, share = 16 ** HASH_DIGITS, (n + 6 * math.sqrt(n) + 20) / max(distinct, 1)
    while True:
        below = hashed.filter(F.col("_place") < int(limit * share)) if share < 1 else hashed
        kept = materialize(below, "sample-draw")
        fewest = kept.groupBy("epoch").agg(F.sum("weight").alias("rows")).agg(F.count("*"), F.min("rows")).first()
        if share >= 1 or (fewest[0] == epochs and fewest[1] >= wanted):
            break
        share *= 2
    chunk = max(limit // max(distinct // CHUNK, 1), 1)
    summed = running(kept, "epoch", "_place", chunk, _before=Running(F.col("weight"), "sum", include_current=False))
    own = summed.withColumn("_copies", F.least(F.col("weight"), F.lit(n) - F.col("_before"))).filter("_copies > 0")
    parts = own.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / CHUNK))))
    first, last = F.col("_part") * CHUNK, F.least(F.col("_copies"), (F.col("_part") + 1) * CHUNK) - 1
    copies = parts.withColumn("_copy", F.explode(F.sequence(first, last)))
    return copies.select(key, "epoch", (F.col("_before") + F.col("_copy")).alias("sample_id"))


#: Digits of a hash that tell the order of a draw.
HASH_DIGITS = 15
