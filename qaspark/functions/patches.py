"""Which patches of an image to mask or blur, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qaspark.functions.curriculum import phase

# Smallest and largest share of patches, patch edge, mask gray, blur radius.
MIN_RATIO = 0.15
MAX_RATIO = 0.50
PATCH_SIZE = 16
MASK_GRAY = 128
BLUR_RADIUS = 3.5


def mask_ratio(difficulty: Column, given: float | None = None) -> Column:
    if given is not None:
        return F.lit(float(given))
    return F.lit(MIN_RATIO) + difficulty * F.lit(MAX_RATIO - MIN_RATIO)


def patch_total(height: Column, width: Column, size: int = PATCH_SIZE) -> Column:
    """Whole patches only: the remainder at the edges is never selected."""
    return (F.floor(height / size) * F.floor(width / size)).cast("int")


def select_patches(
    key: Column, height: Column, width: Column, ratio: Column, size: int = PATCH_SIZE, seed: int = 0
) -> Column:
    """Indices of the selected patches, by hash order; ``floor(total * ratio)`` of them."""
    total = patch_total(height, width, size)
    hashed = F.transform(
        F.sequence(F.lit(0), F.greatest(total, F.lit(1)) - 1),
        lambda i: F.struct(
            F.md5(F.concat_ws(":", key.cast("string"), i.cast("string"), F.lit(str(seed)))).alias("k"), i.alias("i")
        ),
    )
    wanted = F.floor(total * ratio).cast("int")
    return F.slice(F.array_sort(hashed), 1, wanted)["i"]


def patch_box(index: Column, height: Column, width: Column, size: int = PATCH_SIZE) -> Column:
    """Pixel bounds ``y_start, y_end, x_start, x_end`` of a patch, clipped to the image."""
    per_row = F.floor(width / size).cast("int")
    y = F.floor(index / per_row).cast("int") * size
    x = (index % per_row) * size
    return F.struct(
        y.alias("y_start"), F.least(y + size, height).cast("int").alias("y_end"),
        x.alias("x_start"), F.least(x + size, width).cast("int").alias("x_end"),
    )


def patch_action(difficulty: Column, apply_masking: bool = True) -> Column:
    """``none`` when easy, ``blur`` when medium, ``mask`` when hard (unless switched off)."""
    stage = phase(difficulty)
    hard = F.lit("mask" if apply_masking else "none")
    return F.when(stage == "easy", F.lit("none")).when(stage == "medium", F.lit("blur")).otherwise(hard)


def patch_plan(
    key: Column, height: Column, width: Column, difficulty: Column, size: int = PATCH_SIZE,
    ratio: float | None = None, apply_masking: bool = True, seed: int = 0,
) -> Column:
    """``struct<action, patches>`` for one image at one difficulty."""
    action = patch_action(difficulty, apply_masking)
    chosen = select_patches(key, height, width, mask_ratio(difficulty, ratio), size, seed)
    return F.struct(
        action.alias("action"),
        F.when(action == "none", F.array().cast("array<int>")).otherwise(chosen).alias("patches"),
    )
