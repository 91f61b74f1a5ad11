"""Answer label encoders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaspark.functions import text
from qaspark.operators.lookups import null_safe_join
from qaspark.operators.ranks import dense_ids


PADDING_TOKEN, UNKNOWN_TOKEN, FIRST_TOKEN = 0, 1, 2
#: Questions whose ids are put together in one task.
QUESTIONS_A_TASK = 100_000


def union_answers(*splits: DataFrame) -> DataFrame:
    """The ``answer`` column of all splits."""
    return reduce(DataFrame.unionByName, [s.select("answer") for s in splits])


def fit_encoder(*splits: DataFrame) -> DataFrame:
    """``answer, label``: distinct answers of all splits in code-point order, from 0."""
    return dense_ids(union_answers(*splits), "answer", "label")


def first_answers(samples: DataFrame) -> DataFrame:
    """Rows with at least one answer; ``answer`` is the first of ``answers``."""
    return samples.filter(F.size("answers") > 0).withColumn("answer", F.col("answers")[0])


def fit_first_answer_encoder(*splits: DataFrame) -> DataFrame:
    return fit_encoder(*[first_answers(s) for s in splits])


def clean_answers(samples: DataFrame) -> DataFrame:
    """Answers without the words they repeat from the question."""
    return samples.withColumn("answer", text.strip_question_echo(F.col("question"), F.col("answer")))


def fit_clean_encoder(*splits: DataFrame) -> DataFrame:
    return fit_encoder(*[clean_answers(s) for s in splits])


def class_count(*splits: DataFrame) -> DataFrame:
    """Distinct answers of all splits: the size of their encoder, without building it."""
    return union_answers(*splits).agg(F.countDistinct("answer").alias("num_classes"))


def decoder(encoder: DataFrame) -> DataFrame:
    return encoder.select("label", "answer")


def fit_token_vocabulary(samples: DataFrame) -> DataFrame:
    """``token, token_id``: distinct question tokens with dense ids; 0 is left for padding, 1 for unknown tokens."""
    exploded = samples.select(F.explode(text.tokens(F.col("question"))).alias("token"))
    return dense_ids(exploded, "token", "token_id").withColumn("token_id", (F.col("token_id") + FIRST_TOKEN).cast("int"))


def encode_questions(samples: DataFrame, vocabulary: DataFrame, length: int = 64) -> DataFrame:
    """``row_idx, input_ids, attention_mask`` of fixed length.

    Only tokens that fit are looked up, so the per-row lists hold at most ``length`` ids. ``row_idx`` names a row: a
    repeated one fails the job, as its questions could not be told apart.

    A task holds a bounded number of questions, whatever the table: the vocabulary is the side that is hashed, so the
    rows of a frequent token stream by unsorted, and ids are put together in as many parts as the rows ask for.
    """
    parts = max(samples.sparkSession.sparkContext.defaultParallelism, -(-samples.count() // QUESTIONS_A_TASK))
    cut = F.slice(text.tokens(F.col("question")), 1, length)
    placed = samples.select("row_idx", F.posexplode_outer(cut).alias("pos", "token"))
    met = null_safe_join(placed, vocabulary.hint("shuffle_hash"), ["token"], "left").repartition(parts, "row_idx")
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    row = Window.partitionBy("row_idx").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ids = met.select(
        "row_idx", "pos", F.collect_list(F.when(F.col("pos").isNotNull(), F.coalesce("token_id", F.lit(UNKNOWN_TOKEN)))).over(row).alias("ids"),
        F.count_if(first).over(row).alias("firsts"),
    ).filter(first)
    once = F.when(F.col("firsts") <= 1, F.col("ids")).otherwise(
        F.raise_error(F.concat(F.lit("row_idx is repeated: "), F.coalesce(F.col("row_idx").cast("string"), F.lit("null")))).cast("array<int>"))
    ids = ids.select("row_idx", once.alias("ids"))
    return ids.select(
        "row_idx",
        text.pad_ids(F.col("ids"), length).alias("input_ids"),
        text.attention_mask(F.col("ids"), length).alias("attention_mask"),
    )
