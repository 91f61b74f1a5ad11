"""Writers for splits, prediction records and observation records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_folder(root: str, dataset: str, run: str, seed: int) -> str:
    """The folder of one run: ``{root}/{dataset}-{run}-{seed}``."""
    return f"{root.rstrip('/')}/{dataset}-{run}-{seed}"


def write_splits(annotations: DataFrame, images: DataFrame, path: str, source: str | None = None) -> None:
    """``{path}/{split}``: documents of image and annotation arrays that ``read_qa_json_tables_single`` reads back.

    ``images`` holds ``image_id, filename``, ``annotations`` at least ``image_id, question, answer``; both hold
    ``split``. A document is one line of about ``DOCUMENT_ROWS`` rows, dealt out by hash; rows that are equal in all of
    these columns share one.
    Never over the input it comes from.
    """
    if source and source.rstrip("/") == path.rstrip("/"):
        raise ValueError("the output would replace its own input")
    ids = [name for name in ("question_id", "row_idx") if name in annotations.columns]
    identity = F.col(ids[0]) if ids else F.lit(None)
    note = F.struct(
        identity.cast("string").alias("id"), F.col("image_id").cast("string").alias("image_id"), "question", "answer")
    listed = F.struct(F.col("image_id").cast("string").alias("id"), "filename")
    rows = images.select("split", listed.alias("image"), F.lit(None).cast(annotations.select(note.alias("a")).schema[0].dataType).alias("annotation")).unionByName(
        annotations.select("split", F.lit(None).cast(images.select(listed.alias("i")).schema[0].dataType).alias("image"), note.alias("annotation")))
    # Documents of about so many rows, whatever the size of a split. A row's document follows from the row, so a task that
    # is run again deals its rows as before.
    documents = F.greatest(F.lit(1).cast("bigint"), F.ceil(rows.agg(F.count("*").alias("n")).scalar() / DOCUMENT_ROWS))
    part = F.pmod(F.xxhash64("image", "annotation"), documents)
    documents = rows.withColumn("part", part).groupBy("split", "part").agg(
        F.collect_list("image").alias("images"), F.collect_list("annotation").alias("annotations"))
    documents.drop("part").write.partitionBy("split").json(path)


#: Rows of one document of a split, on average.
DOCUMENT_ROWS = 50_000


def _write_epochs(rows: DataFrame, path: str) -> None:
    """Replaces the epochs that the rows hold and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").json(path)


def write_wrong_predictions(wrong: DataFrame, path: str) -> None:
    """Records by epoch plus the count per epoch; epoch after epoch may be written to one folder."""
    _write_epochs(wrong, f"{path}/wrong_samples")
    _write_epochs(wrong.groupBy("epoch").agg(F.count("*").alias("num_wrong_predictions")), f"{path}/counts")


def write_observations(observed: DataFrame, path: str) -> None:
    """Sample records by epoch plus the summary per epoch; epoch after epoch may be written to one folder."""
    _write_epochs(observed, f"{path}/samples")
    summary = observed.groupBy("epoch").agg(
        F.count("*").alias("num_samples"), F.count_if("is_correct").alias("num_correct")
    )
    _write_epochs(summary, f"{path}/epochs")


def write_report(report: DataFrame, path: str) -> None:
    """A report's blocks as text files whose order of names and lines is that of epochs and blocks."""
    report.repartitionByRange("epoch", "block").sortWithinPartitions("epoch", "block").select("text").write.text(path)


def write_text(lines: DataFrame, column: str, path: str) -> None:
    lines.select(column).write.text(path)
