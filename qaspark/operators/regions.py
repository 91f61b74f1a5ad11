"""Detected regions: exploding, box selection, search and naming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.functions import boxes as B
from qaspark.operators.lookups import null_safe_join


def explode_regions(regions: DataFrame) -> DataFrame:
    """One row per box: ``img_id, box_idx, object_id, object_conf, attribute_id, attribute_conf, box``."""
    zipped = F.arrays_zip("objects_id", "objects_conf", "attrs_id", "attrs_conf", "boxes")
    exploded = regions.select("img_id", "img_w", "img_h", F.posexplode(zipped).alias("box_idx", "r"))
    return exploded.select(
        "img_id", "img_w", "img_h", "box_idx",
        F.col("r.objects_id").alias("object_id"), F.col("r.objects_conf").alias("object_conf"),
        F.col("r.attrs_id").alias("attribute_id"), F.col("r.attrs_conf").alias("attribute_conf"),
        F.col("r.boxes").alias("box"),
    )


def confident(exploded: DataFrame, threshold: float = B.CONFIDENCE) -> DataFrame:
    return exploded.filter(F.col("object_conf") >= F.lit(threshold).cast("float"))


def clamp_regions(exploded: DataFrame) -> DataFrame:
    """Boxes inside their image with width and height."""
    return exploded.withColumn("box", B.clamp_box(F.col("box"), F.col("img_w"), F.col("img_h")))


def caption_regions(named: DataFrame) -> DataFrame:
    """Add ``caption`` to regions with names attached."""
    text = B.caption(F.col("object_name"), F.col("attribute_name"), F.col("object_conf"))
    return named.withColumn("caption", text)


def row_at(df: DataFrame, index: int, column: str = "row_idx") -> DataFrame:
    """The row with the given number; no row when out of range."""
    return df.filter(F.col(column) == index)


def rows_at(df: DataFrame, requests: DataFrame, column: str = "row_idx") -> DataFrame:
    """The rows of many requested numbers; ``status`` tells requests that are out of range."""
    known = df.withColumn("status", F.lit("ok"))
    return requests.join(known, column, "left").withColumn("status", F.coalesce("status", F.lit("out of range")))


def max_confidence(proposals: DataFrame, threshold: float = B.NMS_OVERLAP) -> DataFrame:
    """``img_id, box_idx, max_conf`` from proposals ``img_id, box_idx, class_id, score, x1, y1, x2, y2``.

    Per image and class, overlapping proposals give way to better ones; a box then takes its best
    score over the classes that kept it, 0 when none did. Class 0 is background. A detector emits a
    bounded number of proposals per image, so one image and class fit an array.
    """
    per_class = (
        proposals.filter("class_id >= 1").groupBy("img_id", "class_id")
        .agg(F.collect_list(F.struct("score", F.col("box_idx").alias("idx"), "x1", "y1", "x2", "y2")).alias("boxes"))
    )
    kept = per_class.select("img_id", F.explode(B.suppress(F.col("boxes"), threshold)).alias("b")).select(
        "img_id", F.col("b.idx").alias("box_idx"), F.greatest(F.col("b.score"), F.lit(0.0)).alias("score")
    )
    every = proposals.select("img_id", "box_idx", F.lit(0.0).alias("score"))
    return kept.unionByName(every).groupBy("img_id", "box_idx").agg(F.max("score").alias("max_conf"))


def select_boxes(
    scored: DataFrame, threshold: float = B.CONFIDENCE, least: int = B.MIN_BOXES, most: int = B.MAX_BOXES
) -> DataFrame:
    """Rows of ``img_id, confs`` (array) to ``img_id, box_idx`` of the boxes kept."""
    chosen = B.keep_boxes(F.col("confs"), threshold, least, most)
    return scored.select("img_id", F.explode(chosen).alias("box_idx"))


def detections(proposals: DataFrame) -> DataFrame:
    """Add object and attribute id and confidence from class score arrays."""
    return proposals.withColumn("object", B.foreground_argmax(F.col("class_scores"))).withColumn(
        "attribute", B.foreground_argmax(F.col("attr_scores"))
    )


def search_class(exploded: DataFrame, objects: DataFrame, term: str) -> DataFrame:
    """``row_idx`` of images with an object whose name contains the term; none for an empty term.

    The vocabulary is filtered first, so the join reduces the regions before anything shuffles.
    """
    if not term:
        return exploded.select("row_idx").limit(0)
    hits = objects.filter(F.contains(F.lower("name"), F.lit(term.lower()))).select(F.col("id").alias("object_id"))
    return exploded.join(hits, "object_id", "left_semi").select("row_idx").distinct()


def search_report(found: DataFrame, term: str, shown: int = 20) -> DataFrame:
    """One line of text: the number of images and the first indices."""
    total = found.agg(F.count("*").alias("n"))
    first = found.orderBy("row_idx").limit(shown)
    listed = first.agg(F.array_join(F.array_sort(F.collect_list("row_idx")).cast("array<string>"), ", ").alias("ids"))
    line = F.concat(
        F.lit("Found "), F.col("n").cast("string"), F.lit(f" images with '{term}'. Indices: "),
        F.col("ids"), F.when(F.col("n") > shown, F.lit("...")).otherwise(F.lit("")),
    )
    none = F.lit(f"No images found containing '{term}'")
    return listed.withColumn("n", total.scalar()).select(F.when(F.col("n") > 0, line).otherwise(none).alias("report"))


def image_count(regions: DataFrame) -> DataFrame:
    return regions.agg(F.count("*").alias("images"))


def canonical_names(vocab: DataFrame) -> DataFrame:
    """``synonym, id``: every spelling of a class; a spelling listed twice takes its first class."""
    spelled = vocab.select("id", F.explode("synonyms").alias("synonym"))
    return spelled.groupBy("synonym").agg(F.min("id").alias("id"))


def canonicalize(names: DataFrame, vocab: DataFrame, column: str = "name") -> DataFrame:
    """Add the class id of each name by any of its spellings."""
    spellings = canonical_names(vocab).withColumnRenamed("synonym", column)
    return null_safe_join(names, spellings, [column], "left")
