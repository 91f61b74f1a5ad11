"""Predictions, accuracy, wrong-prediction records, best metrics and early stopping."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from qaspark.operators.lookups import decode_labels, null_safe_join
from qaspark.operators.scan import Running, row_number, running

TOP = 5


def argmax(scores: Column) -> Column:
    """Index of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def with_prediction(df: DataFrame, logits: str = "logits") -> DataFrame:
    return df.withColumn("prediction", argmax(F.col(logits)))


def is_correct() -> Column:
    return F.col("prediction") == F.col("ground_truth")


def accuracy(predicted: DataFrame, *by: str) -> DataFrame:
    return predicted.groupBy(*by).agg(F.avg(is_correct().cast("int")).alias("accuracy"))


def wrong_predictions(predicted: DataFrame) -> DataFrame:
    return predicted.filter(F.col("prediction") != F.col("ground_truth"))


def error_rates(predicted: DataFrame, by: str = "epoch") -> DataFrame:
    """Wrong and total predictions and their ratio, per epoch."""
    return (
        predicted.groupBy(by)
        .agg(F.count_if(~is_correct()).alias("num_wrong"), F.count("*").alias("total"))
        .withColumn("error_rate", F.when(F.col("total") > 0, F.col("num_wrong") / F.col("total")).otherwise(0.0))
    )


def best_labels(logits: Column, k: int = TOP) -> Column:
    """``array<struct<rank, label, score>>``, best first, ties by lower label."""
    ordered = F.array_sort(
        F.transform(logits, lambda x, i: F.struct((-x).alias("k"), i.alias("label"), x.alias("score")))
    )
    return F.transform(
        F.slice(ordered, 1, k),
        lambda s, i: F.struct((i + 1).alias("rank"), s["label"].alias("label"), s["score"].cast("double").alias("score")),
    )


def top_predictions(predicted: DataFrame, encoder: DataFrame, keys: Sequence[str], k: int = TOP) -> DataFrame:
    """``keys, top5_predictions``: the best ``k`` labels with their answers, as structs of rank, answer, label, score.

    Rows are told apart by ``keys``. The few best labels of a row are looked up like any label and gathered
    again, so the encoder is joined and never held in a cell.
    """
    best = predicted.select(*keys, F.explode_outer(best_labels(F.col("logits"), k)).alias("b")).select(*keys, "b.*")
    named = decode_labels(best, encoder, {"label": "answer"})
    ranked = F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "answer", "label", "score")))
    return named.groupBy(*keys).agg(F.array_sort(ranked).alias("top5_predictions"))


def _decoded(df: DataFrame, encoder: DataFrame) -> DataFrame:
    names = encoder.select(F.col("label").cast("bigint").alias("label"), "answer")
    return decode_labels(df, names, {"prediction": "_predicted", "ground_truth": "_truth"})


def wrong_records(predicted: DataFrame, encoder: DataFrame, k: int = TOP) -> DataFrame:
    """Wrong predictions with decoded answers and, where logits exist, the best ``k`` answers.

    Rows are told apart by ``epoch`` and ``row_idx``.
    """
    wrong = wrong_predictions(predicted)
    records = _decoded(wrong.drop("logits"), encoder).select(
        "epoch", F.col("row_idx").alias("sample_idx"), F.col("img_path").alias("image_path"), "question",
        F.col("_predicted").alias("model_prediction"), F.col("_truth").alias("ground_truth"),
        F.col("prediction").alias("prediction_label"), F.col("ground_truth").alias("ground_truth_label"),
    )
    if "logits" not in predicted.columns:
        return records
    best = top_predictions(
        wrong.select("epoch", F.col("row_idx").alias("sample_idx"), "logits"),
        encoder.select(F.col("label").cast("bigint").alias("label"), "answer"), ["epoch", "sample_idx"], k,
    )
    return null_safe_join(records, best, ["epoch", "sample_idx"], "left")


def observations(samples: DataFrame, encoder: DataFrame) -> DataFrame:
    """Observation records of drawn samples.

    ``views`` are the wordings the text augmentation gave (null without one); the text flag says
    whether any of them differs from the original. ``image_action`` is null without image augmentation.
    """
    differs = F.exists(F.col("views"), lambda v: v != F.col("question"))
    return _decoded(samples, encoder).select(
        "epoch", "sample_id", F.col("img_path").alias("original_image_path"),
        F.col("question").alias("original_question"), F.col("views").alias("augmented_question"),
        F.col("_predicted").alias("model_prediction"), F.col("_truth").alias("ground_truth"),
        is_correct().alias("is_correct"),
        F.col("image_action").isNotNull().alias("has_image_augmentation"),
        F.coalesce(differs, F.lit(False)).alias("has_text_augmentation"),
    )


def sample_accuracy(observed: DataFrame) -> DataFrame:
    """Correct samples and accuracy per epoch."""
    return observed.groupBy("epoch").agg(
        F.count("*").alias("samples"), F.count_if("is_correct").alias("correct"),
        F.coalesce(F.avg(F.col("is_correct").cast("int")), F.lit(0.0)).alias("accuracy"),
    )


def _valued(metrics: DataFrame, name: str, run: str) -> DataFrame:
    """run, epoch and a metric as a number; NaN is none."""
    value = F.col(name).cast("double")
    return metrics.select(run, "epoch", F.when(~F.isnan(value), value).alias(name))


def _earliest(rows: DataFrame, name: str, best: Column, run: str) -> DataFrame:
    """run, the best value and the earliest epoch that has it, as aggregates of numbers: no row is sorted for them."""
    found = rows.groupBy(run).agg(best.alias("_best"))
    at = null_safe_join(rows, found, [run]).filter(F.col(name) == F.col("_best"))
    first = at.groupBy(run).agg(F.min("epoch").alias("best_epoch"))
    return null_safe_join(found, first, [run], "left")


def best_accuracy(metrics: DataFrame, run: str = "run_id") -> DataFrame:
    """Best accuracy above zero and its earliest epoch; a run that never rises stays at 0 and epoch 0."""
    best = F.max(F.when(F.col("eval_accuracy") > 0.0, F.col("eval_accuracy")))
    return _earliest(_valued(metrics, "eval_accuracy", run), "eval_accuracy", best, run).select(
        run, F.coalesce("_best", F.lit(0.0)).alias("best_accuracy"), F.coalesce("best_epoch", F.lit(0)).alias("best_epoch"))


def best_checkpoint(metrics: DataFrame, run: str = "run_id") -> DataFrame:
    """The epoch with the lowest loss, the earliest of several; a run without a loss has none."""
    return _earliest(_valued(metrics, "eval_loss", run), "eval_loss", F.min("eval_loss"), run).select(
        run, "best_epoch", F.col("_best").alias("best_loss"))


def patience_counters(metrics: DataFrame, run: str = "run_id") -> DataFrame:
    """``run, epoch, counter``: evaluations since the last strictly lower loss; a loss that is null is not lower."""
    seen = running(
        _valued(metrics, "eval_loss", run), run, "epoch",
        _lowest=Running(F.col("eval_loss"), "min", include_current=False), _number=row_number(),
    )
    improved = F.col("eval_loss").isNotNull() & (F.col("_lowest").isNull() | (F.col("eval_loss") < F.col("_lowest")))
    marked = running(seen, run, "epoch", _last=Running(F.when(improved, F.col("_number")), "max"))
    return marked.select(run, "epoch", (F.col("_number") - F.coalesce("_last", F.lit(0))).alias("counter"))


def early_stops(metrics: DataFrame, patience: int, run: str = "run_id") -> DataFrame:
    """The epoch at which each run stops; null when it runs to its end or ``patience`` is off."""
    if patience <= 0:
        return metrics.groupBy(run).agg(F.lit(None).cast("bigint").alias("stop_epoch"))
    stop = F.min(F.when(F.col("counter") >= patience, F.col("epoch")))
    return patience_counters(metrics, run).groupBy(run).agg(stop.alias("stop_epoch"))


def add_outcomes(df: DataFrame, function: Callable[[dict], object], result: str, inputs: Sequence[str]) -> DataFrame:
    """Add a result column (``name type``) and ``error``; the table's own columns pass through untouched.

    The function gets one dict per row with the columns ``inputs`` as Python values.
    """
    added = T.StructType.fromDDL(f"{result}, error string")
    schema = T.StructType([*df.schema.fields, *added.fields])
    kinds = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results, errors = [], []
            for row in batch.select(list(inputs)).to_pylist():
                try:
                    results.append(function(row))
                    errors.append(None)
                except Exception as failure:  # a bad row of any kind is set aside
                    results.append(None)
                    errors.append(f"{type(failure).__name__}: {failure}")
            made = [pa.array(values, type=kind.type) for values, kind in zip((results, errors), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return df.mapInArrow(run, schema)


def try_rows(df: DataFrame, function: Callable[[dict], object], result_type: str) -> DataFrame:
    """Add ``result`` and ``error``: a failing row is noted and does not stop the job."""
    return add_outcomes(df, function, f"result {result_type}", df.columns)


def split_failures(tried: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows."""
    return tried.filter("error is null").drop("error"), tried.filter("error is not null").drop("result")
