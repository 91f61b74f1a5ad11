"""Text reports of observations and wrong predictions, in long form.

A report has one row per block with its place in the epoch, so an epoch of any size stays
distributed; ``writers.write_report`` gives the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.operators.evaluate import sample_accuracy
from qaspark.operators.scan import row_number, running

# The ruler lines of the layouts.
WIDE = "=" * 50
WIDER = "=" * 80
THIN = "-" * 80


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def _yes(flag: Column) -> Column:
    return F.when(flag, F.lit("Yes")).otherwise(F.lit("No"))


def sample_summary(observed: DataFrame) -> DataFrame:
    """``epoch, sample_id, summary``: the page of one observed sample."""
    lines = [
        F.lit("Sample Summary"), F.lit(WIDE), F.lit(""),
        F.lit("Original Question:"), F.concat(F.lit("  "), _text(F.col("original_question"))), F.lit(""),
    ]
    augmented = F.when(
        F.col("has_text_augmentation"),
        F.concat(F.lit("Augmented Question:\n  "), F.array_join("augmented_question", " | "), F.lit("\n")),
    )
    verdict = F.when(F.col("is_correct"), F.lit("CORRECT ✓")).otherwise(F.lit("INCORRECT ✗"))
    rest = [
        F.lit("Ground Truth Answer:"), F.concat(F.lit("  "), F.col("ground_truth")), F.lit(""),
        F.lit("Model Prediction:"), F.concat(F.lit("  "), F.col("model_prediction")), F.lit(""),
        F.concat(F.lit("Prediction Status: "), verdict), F.lit(""),
        F.lit("Augmentation Applied:"),
        F.concat(F.lit("  - Image: "), _yes(F.col("has_image_augmentation"))),
        F.concat(F.lit("  - Text: "), _yes(F.col("has_text_augmentation"))),
    ]
    return observed.select("epoch", "sample_id", F.concat_ws("\n", *lines, augmented, *rest).alias("summary"))


def epoch_summary(observed: DataFrame) -> DataFrame:
    """``epoch, block, text``: block 0 heads the epoch, then one block per sample."""
    head = sample_accuracy(observed).select(
        "epoch", F.lit(0).cast("bigint").alias("block"),
        F.format_string(
            f"Epoch %d Sample Summary\n{WIDE}\n\nTotal samples: %d\nCorrect predictions: %d/%d (%.2f%%)\n",
            F.col("epoch"), F.col("samples"), F.col("correct"), F.col("samples"), F.col("accuracy") * 100,
        ).alias("text"),
    )
    augmented = F.when(
        F.col("has_text_augmentation"),
        F.concat(F.lit("  Question (augmented): "), F.array_join("augmented_question", " | ")),
    )
    body = observed.select(
        "epoch", (F.col("sample_id") + 1).cast("bigint").alias("block"),
        F.concat_ws(
            "\n",
            F.concat(F.lit("Sample "), F.col("sample_id").cast("string"), F.lit(":")),
            F.concat(F.lit("  Question (original): "), _text(F.col("original_question"))),
            augmented,
            F.concat(F.lit("  Ground truth: "), F.col("ground_truth")),
            F.concat(F.lit("  Prediction: "), F.col("model_prediction")),
            F.concat(F.lit("  Correct: "), F.when(F.col("is_correct"), "✓").otherwise("✗")),
            F.concat(F.lit("  Image augmented: "), _yes(F.col("has_image_augmentation"))),
            F.lit(""),
        ).alias("text"),
    )
    return head.unionByName(body)


def wrong_summary(wrong: DataFrame) -> DataFrame:
    """``epoch, block, text``: block 0 heads the epoch, then one numbered block per wrong sample."""
    head = wrong.groupBy("epoch").agg(F.count("*").alias("n")).select(
        "epoch", F.lit(0).cast("bigint").alias("block"),
        F.format_string(
            f"Epoch %d - Wrong Predictions Summary\n{WIDER}\n\nTotal wrong predictions: %d\n\n{THIN}",
            F.col("epoch"), F.col("n"),
        ).alias("text"),
    )
    best = []
    if "top5_predictions" in wrong.columns:
        ranked = F.transform(
            "top5_predictions",
            lambda p: F.format_string("  %d. %s (score: %.4f)", p["rank"], p["answer"], p["score"]),
        )
        best = [F.lit("Top-5 Predictions:"), F.array_join(ranked, "\n")]
    numbered = running(wrong, "epoch", "sample_idx", block=row_number())
    body = numbered.select(
        "epoch", "block",
        F.concat_ws(
            "\n",
            F.format_string("\n[%d] Sample Index: %d", F.col("block"), F.col("sample_idx")),
            F.concat(F.lit("Image: "), _text(F.col("image_path"))),
            F.concat(F.lit("Question: "), _text(F.col("question"))),
            F.concat(F.lit("Ground Truth: "), F.col("ground_truth")),
            F.concat(F.lit("Prediction: "), F.col("model_prediction")),
            *best, F.lit(THIN),
        ).alias("text"),
    )
    return head.unionByName(body)
