"""Masking and blurring of image rasters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from qaspark.functions import patches
from qaspark.functions.paths import first_dot_id

ALTERED = "image_id string, height int, width int, channels int, action string, data binary"
#: Rasters held as Python objects at a time.
ROWS_AT_ONCE = 256


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, height, width, channels, data``: rasters as decoded by the JVM (BGR order)."""
    image = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return image.select(
        first_dot_id(F.col("origin")).alias("image_id"), "height", "width",
        F.col("nChannels").alias("channels"), "data",
    )


@lru_cache
def _spread(size: int, radius: float) -> np.ndarray:
    """The Gaussian along one axis of a patch as a matrix; edge pixels repeat outwards."""
    reach = max(1, int(np.ceil(radius * 3)))
    offsets = np.arange(-reach, reach + 1)
    weights = np.exp(-0.5 * (offsets / radius) ** 2)
    matrix = np.zeros((size, size))
    for row in range(size):
        np.add.at(matrix[row], np.clip(row + offsets, 0, size - 1), weights / weights.sum())
    return matrix


def blur_patches(blocks: np.ndarray, radius: float = patches.BLUR_RADIUS) -> np.ndarray:
    """Separable Gaussian over each square patch alone; ``blocks`` is ``(n, channels, size, size)``."""
    matrix = _spread(blocks.shape[-1], radius)
    return np.clip(np.rint(matrix @ blocks @ matrix.T), 0, 255).astype(np.uint8)


def _alter(data: bytes, height: int, width: int, channels: int, action: str, chosen, size: int) -> bytes:
    if action == "none" or len(chosen) == 0:
        return data
    raster = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).copy()
    ys, xs = np.divmod(np.asarray(chosen), width // size)
    y = ys[:, None, None] * size + np.arange(size)[None, :, None]
    x = xs[:, None, None] * size + np.arange(size)[None, None, :]
    if action == "mask":
        raster[y, x] = patches.MASK_GRAY
    else:
        blocks = raster[y, x].transpose(0, 3, 1, 2)
        raster[y, x] = blur_patches(blocks).transpose(0, 2, 3, 1)
    return raster.tobytes()


def apply_patches(
    rasters: DataFrame, difficulty: Column, size: int = patches.PATCH_SIZE, ratio: float | None = None,
    apply_masking: bool = True, seed: int = 0, keep: Sequence[str] = (),
) -> DataFrame:
    """Rasters with the planned patches masked or blurred, and the columns ``keep`` of the table as they are.

    The plan is a column expression on the raster's own row, so pixels never shuffle. Each image is read once;
    Arrow batches hand the untouched ones on as they are.
    """
    plan = patches.patch_plan(
        F.col("image_id"), F.col("height"), F.col("width"), difficulty, size, ratio, apply_masking, seed
    )
    planned = rasters.withColumn("plan", plan).select(
        "image_id", "height", "width", "channels", "data", "plan.action", "plan.patches", *keep
    )
    schema = StructType([*StructType.fromDDL(ALTERED).fields, *(rasters.schema[name] for name in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["image_id", "height", "width", "channels", "action"]
        for whole in batches:
            for start in range(0, len(whole), ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                plans = batch.select(["data", "height", "width", "channels", "action", "patches"])
                altered = [_alter(*row.values(), size) for row in plans.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(name) for name in names), pa.array(altered, pa.binary()), *(batch.column(name) for name in keep)],
                    names=[*names, "data", *keep])

    return planned.mapInArrow(run, schema)
