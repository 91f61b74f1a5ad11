"""Listings of images and region files, and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.functions.paths import base_name, first_dot_id
from qaspark.sources.regions import REGION_IMAGES


def list_files(
    spark: SparkSession, root: str, suffix: str = "", recursive: bool = True
) -> DataFrame:
    """``path`` of every file below ``root``; file contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.load(root).select("path")


def list_images(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """``path, image_id`` of a folder; the id is the name up to its first dot."""
    folder = f"{root.rstrip('/')}/{split}" if split else root
    return list_files(spark, folder, recursive=False).withColumn("image_id", first_dot_id(F.col("path")))


def list_objects(spark: SparkSession, prefix: str, suffix: str = ".tsv") -> DataFrame:
    """Objects of a store below a prefix with a suffix; any Hadoop file system path works."""
    return list_files(spark, prefix, suffix)


def find_region_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, file, image_dir`` of the known region files anywhere below ``root``."""
    known = spark.createDataFrame(
        [(name, f"{root.rstrip('/')}/{folder}") for name, folder in REGION_IMAGES.items()],
        "file string, image_dir string",
    )
    found = list_files(spark, root, "_obj36.tsv").withColumn("file", base_name(F.col("path")))
    return found.join(F.broadcast(known), "file").select("path", "file", "image_dir")  # seven rows


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``id, name, synonyms``: the line number is the id, commas part synonyms.

    Only an empty end of the file is dropped, so a last line without a line break counts.
    """
    lines = F.split("value", "\r?\n", -1)
    closed = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return (
        spark.read.text(path, wholetext=True)
        .select(F.posexplode(closed).alias("id", "name"))
        .withColumn("synonyms", F.transform(F.split("name", ","), lambda s: F.trim(s)))
    )
