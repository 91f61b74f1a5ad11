"""Path and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_fill(identifier: Column, width: int = 12) -> Column:
    """Left zero padding that never cuts a longer id."""
    digits = identifier.cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def join_path(folder: Column, name: Column) -> Column:
    """Folder and name with one slash; an absolute name stands alone, an empty folder adds nothing."""
    return (
        F.when(name.startswith("/"), name)
        .when((folder == "") | folder.endswith("/"), F.concat(folder, name))
        .otherwise(F.concat(folder, F.lit("/"), name))
    )


def coco_name(identifier: Column, split: str = "train2014") -> Column:
    """Fixed file name format of the COCO image sets."""
    return F.format_string(f"COCO_{split}_%012d.jpg", identifier.cast("bigint"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """Base name without its last extension; leading dots belong to the name."""
    return F.regexp_replace(base_name(path), r"^(\.*[^.].*)\.[^.]*$", "$1")


def bare_id(path: Column) -> Column:
    """``dir/COCO_val2014_000000123456.jpg`` to ``000000123456``."""
    return F.substring_index(stem(path), "_", -1)


def first_dot_id(path: Column) -> Column:
    """Base name up to its first dot."""
    return F.substring_index(base_name(path), ".", 1)
