"""Region expressions on per-image arrays: filtering, suppression, clamping, captions.

A detector emits a fixed number of proposals per image, so an image's boxes fit one row and every
operator here is narrow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Confidence threshold and the least and most boxes kept.
CONFIDENCE = 0.2
MIN_BOXES = 36
MAX_BOXES = 36
NMS_OVERLAP = 0.3


def clamp_box(box: Column, width: Column, height: Column) -> Column:
    """``x1, y1, x2, y2`` inside the image, with the resulting ``width`` and ``height``."""
    x1 = F.greatest(F.lit(0.0), F.least(box[0].cast("double"), width.cast("double")))
    y1 = F.greatest(F.lit(0.0), F.least(box[1].cast("double"), height.cast("double")))
    x2 = F.greatest(F.lit(0.0), F.least(box[2].cast("double"), width.cast("double")))
    y2 = F.greatest(F.lit(0.0), F.least(box[3].cast("double"), height.cast("double")))
    return F.struct(
        x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"),
        (x2 - x1).alias("width"), (y2 - y1).alias("height"),
    )


def caption(object_name: Column, attribute_name: Column, confidence: Column) -> Column:
    return F.format_string("%s: %s (%.2f)", object_name, attribute_name, confidence.cast("double"))


def foreground_argmax(scores: Column) -> Column:
    """Best class without the background at index 0: ``struct<id, conf>``, ids from 0."""
    front = F.slice(scores, 2, F.size(scores))
    best = F.array_max(front)
    return F.struct((F.array_position(front, best) - 1).cast("int").alias("id"), best.alias("conf"))


def keep_boxes(
    confidences: Column, threshold: float = CONFIDENCE, least: int = MIN_BOXES, most: int = MAX_BOXES
) -> Column:
    """0-based indices of the kept boxes, by confidence and then index.

    Boxes at or above the threshold stay; fewer than ``least`` are filled up from the rest and more
    than ``most`` are cut to the best.
    """
    ordered = F.array_sort(
        F.transform(confidences, lambda c, i: F.struct((-c).alias("k"), i.alias("i"), c.alias("c")))
    )
    passing = F.size(F.filter(confidences, lambda c: c >= threshold))
    n = F.when(passing < least, F.lit(least)).when(passing > most, F.lit(most)).otherwise(passing)
    return F.slice(ordered, 1, n)["i"]


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union with inclusive pixel bounds."""
    def span(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0.0), high - low + 1.0)

    shared = span(F.greatest(a["x1"], b["x1"]), F.least(a["x2"], b["x2"])) * span(
        F.greatest(a["y1"], b["y1"]), F.least(a["y2"], b["y2"])
    )
    area_a = (a["x2"] - a["x1"] + 1.0) * (a["y2"] - a["y1"] + 1.0)
    area_b = (b["x2"] - b["x1"] + 1.0) * (b["y2"] - b["y1"] + 1.0)
    return shared / (area_a + area_b - shared)


def suppress(boxes: Column, threshold: float = NMS_OVERLAP) -> Column:
    """Greedy non-maximum suppression over ``array<struct<score, idx, x1, y1, x2, y2>>``.

    Best score first, ties by index; a box stays unless it overlaps a kept one too much.
    """
    ordered = F.array_sort(
        F.transform(
            boxes,
            lambda b: F.struct((-b["score"]).alias("k"), b["idx"].alias("i"), b.alias("b")),
        )
    )["b"]
    return F.aggregate(
        ordered,
        F.slice(ordered, 1, 0),
        lambda kept, b: F.when(
            F.exists(kept, lambda k: overlap(k, b) > threshold), kept
        ).otherwise(F.concat(kept, F.array(b))),
    )
