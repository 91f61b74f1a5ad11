"""Lookups between annotations, images, labels and vocabularies.

All are equi-joins with the large side on the left and one row per key on the right. No side is
forced: adaptive execution broadcasts a right side whose measured size allows it and splits hot keys
of the left side otherwise (``spark.sql.adaptive.skewJoin``, on by default).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.functions import paths

ON_MISSING = ("error", "drop", "keep")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys where null matches null; the join of all lookups.

    Two reasons beside nulls. A right side grouped by the key keeps its own exchange for a plain
    equality, and adaptive execution then cannot split a hot key of the left side; the null-safe form
    gets an exchange of its own and is split. And a plain equality tests each key for null below the
    join, which computes expensive key expressions a second time.
    """
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def last_image_per_id(images: DataFrame) -> DataFrame:
    """One file name per image id; a repeated id takes its last row (by ``pos``)."""
    return images.filter("image_id is not null").groupBy("image_id").agg(F.max_by("filename", "pos").alias("filename"))


def attach_images(annotations: DataFrame, images: DataFrame, on_missing: str = "default") -> DataFrame:
    """Add ``filename`` from ``images(image_id, filename, pos)``.

    ``on_missing``: ``default`` names the file after the id, ``error`` fails, ``drop`` leaves the row out.
    """
    files = last_image_per_id(images)
    joined = null_safe_join(annotations, files, ["image_id"], "inner" if on_missing == "drop" else "left")
    if on_missing == "default":
        own = F.concat(F.col("image_id").cast("string"), F.lit(".jpg"))
        return joined.withColumn("filename", F.coalesce("filename", own))
    return _checked(joined, "filename", F.col("image_id"), "no image with id ", on_missing)


def _checked(joined: DataFrame, column: str, key: Column, message: str, on_missing: str) -> DataFrame:
    if on_missing not in ON_MISSING:
        raise ValueError(f"on_missing must be one of {', '.join(ON_MISSING)}")
    if on_missing == "error":
        # In a filter, as a column that nobody asks for would be left out together with its check.
        failure = F.raise_error(F.concat(F.lit(message), F.coalesce(key.cast("string"), F.lit("null")))).cast("boolean")
        return joined.filter(F.when(F.col(column).isNotNull(), F.lit(True)).otherwise(failure))
    return joined.filter(F.col(column).isNotNull()) if on_missing == "drop" else joined


def resolve_files(wanted: DataFrame, first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Find each wanted ``image_id`` in the first listing, else in the second.

    Listings hold ``image_id, path``. Returns resolved rows and the unresolved ids.
    """
    a = first.select("image_id", F.col("path").alias("_first"))
    b = second.select("image_id", F.col("path").alias("_second"))
    joined = null_safe_join(null_safe_join(wanted, a, ["image_id"], "left"), b, ["image_id"], "left")
    found = joined.withColumn("path", F.coalesce("_first", "_second")).drop("_first", "_second")
    return found.filter(F.col("path").isNotNull()), found.filter(F.col("path").isNull()).drop("path")


# Fixed value: extensions in order of preference.
EXTENSIONS = (".jpg", ".jpeg", ".png")


def files_by_extension(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """The file of each ``image_id`` in ``listing(path)``, by order of extension; null when absent."""
    name = paths.base_name(F.col("path"))
    preference = F.lit(None).cast("int")
    for rank, extension in reversed(list(enumerate(EXTENSIONS))):
        preference = F.when(name.endswith(extension), F.lit(rank)).otherwise(preference)
    ranked = (
        listing.select(paths.stem(F.col("path")).alias("image_id"), "path", preference.alias("_rank"))
        .filter(F.col("_rank").isNotNull())
        .groupBy("image_id").agg(F.min_by("path", "_rank").alias("path"))
    )
    return null_safe_join(wanted, ranked, ["image_id"], "left")


def attach_names(regions: DataFrame, objects: DataFrame, attributes: DataFrame) -> DataFrame:
    """Add ``object_name`` and ``attribute_name`` from vocabularies ``(id, name)``."""
    o = objects.select(F.col("id").alias("object_id"), F.col("name").alias("object_name"))
    a = attributes.select(F.col("id").alias("attribute_id"), F.col("name").alias("attribute_name"))
    return null_safe_join(null_safe_join(regions, o, ["object_id"], "left"), a, ["attribute_id"], "left")


def encode_answers(samples: DataFrame, encoder: DataFrame, on_missing: str = "error") -> DataFrame:
    """Add ``label`` from ``encoder(answer, label)``."""
    joined = null_safe_join(samples, encoder, ["answer"], "left")
    return _checked(joined, "label", F.col("answer"), "no label for answer ", on_missing)


def decode_labels(df: DataFrame, encoder: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add the answer text of each label column, e.g. ``{"prediction": "predicted_answer"}``.

    Labels outside the encoder read ``unknown_<label>``.
    """
    for label, answer in columns.items():
        names = encoder.select(F.col("label").alias(label), F.col("answer").alias(answer))
        fallback = F.concat(F.lit("unknown_"), F.col(label).cast("string"))
        df = null_safe_join(df, names, [label], "left").withColumn(answer, F.coalesce(F.col(answer), fallback))
    return df


def missing_work(wanted: DataFrame, done: DataFrame, key: str = "img_id") -> DataFrame:
    """Rows of ``wanted`` whose key is not in ``done``."""
    return null_safe_join(wanted, done.select(key), [key], "left_anti")


def attach_schedule(log: DataFrame, schedule: DataFrame) -> DataFrame:
    """Add ``curriculum_difficulty`` by the whole part of the (fractional) epoch."""
    planned = schedule.select(
        F.col("epoch").cast("bigint").alias("_epoch"), F.col("difficulty").alias("curriculum_difficulty")
    )
    whole = F.col("epoch").cast("bigint")
    return log.join(planned, whole == F.col("_epoch"), "left").drop("_epoch")
