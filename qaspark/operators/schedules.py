"""Schedule tables and their use on metric logs and samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from qaspark.functions import curriculum as C
from qaspark.functions import carry, paraphrase, patches
from qaspark.session import materialize

# Epochs of a chunk that is folded by itself, and chunks that are composed at once.
CHUNK, FAN = 4096, 256

# Experiments with their text, image and curriculum switches.
EXPERIMENTS = (
    ("exp1_baseline", False, False, False),
    ("exp2_text_augment", True, False, False),
    ("exp3_image_augment", False, True, False),
    ("exp4_text_image_augment", True, True, False),
    ("exp5_text_augment_cl", True, False, True),
    ("exp6_image_augment_cl", False, True, True),
    ("exp7_full_augment_cl", True, True, True),
)


def schedule_table(spark: SparkSession, schedules: Sequence[C.Schedule]) -> DataFrame:
    """``strategy, epoch, difficulty, phase, text_outputs`` for every epoch of each schedule."""
    parts = []
    for schedule in schedules:
        epoch = F.col("id")
        difficulty = schedule.difficulty(epoch)
        parts.append(
            spark.range(schedule.total_epochs).select(
                F.lit(schedule.strategy).alias("strategy"), epoch.alias("epoch"), difficulty.alias("difficulty")
            )
        )
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("phase", C.phase(F.col("difficulty"))).withColumn(
        "text_outputs", C.paraphrase_count(F.col("difficulty")) + 1
    )


def with_difficulty(log: DataFrame, schedule: C.Schedule, epoch: str = "epoch") -> DataFrame:
    """Add ``curriculum_difficulty`` to a log by formula, with no join; fractions of an epoch count down."""
    whole = F.floor(F.col(epoch)).cast("bigint")
    return log.withColumn("curriculum_difficulty", schedule.difficulty(whole))


def schedule_summary(table: DataFrame, key_epochs: Sequence[int]) -> DataFrame:
    """Rounded difficulties at the key epochs."""
    at = table.filter(F.col("epoch").isin(*sorted(set(key_epochs))))
    return at.select("strategy", "epoch", F.round("difficulty", 4).alias("difficulty"), "phase", "text_outputs")


def phase_counts(table: DataFrame, by: str = "strategy") -> DataFrame:
    """Epochs (rows) per phase with percentages."""
    stage = C.phase(F.col("difficulty"))
    counts = table.groupBy(by).agg(
        F.count("*").alias("epochs"),
        *[F.count_if(stage == name).alias(name) for name in ("easy", "medium", "hard")],
    )
    percent = [
        F.round(F.col(name) * 100.0 / F.col("epochs"), 1).alias(f"{name}_percent") for name in ("easy", "medium", "hard")
    ]
    return counts.select("*", *percent)


def applied_difficulty(log: DataFrame, run: str = "run_id", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``run, epoch, difficulty, applied``: the difficulty in force under the update threshold.

    The rule carries one value along the epochs of a run. So that a run of any length is many tasks, it is cut into
    chunks of ``chunk`` epochs: each states what it makes of any value it may start with (``functions.carry``), ``fan``
    of these are composed into one until a run has few, what every chunk starts with is told from the top down, and
    the chunks replay their rows. A null (or NaN) difficulty leaves the one in force; rows of one epoch are taken by
    difficulty, rows without an epoch before the run's first chunk.
    """
    value = F.col("difficulty").cast("double")
    rows = log.select(run, "epoch", F.when(~F.isnan(value), value).alias("difficulty"))
    low, high = rows.agg(F.min("epoch"), F.max("epoch")).first()
    start = F.lit(low or 0)
    chunked = rows.withColumn("block", F.floor((F.coalesce(F.col("epoch"), start) - start) / chunk).cast("bigint"))
    blocks = int((high - low) // chunk) + 1 if low is not None else 1
    levels: list[DataFrame] = []
    while blocks > 1 and (not levels or blocks > fan):
        if levels:
            blocks = -(-blocks // fan)
            levels.append(materialize(_composed(levels[-1], run, fan), "composed"))
        else:
            levels.append(materialize(_summarized(chunked, run), "summaries"))
    told: DataFrame | None = None
    for level in reversed(levels):
        told = _told(level, told, run, fan)
    return _replayed(chunked, told, run)


_SUMMARY = "block bigint, tests array<double>, exits array<double>"


def _made(rows: DataFrame, run: str, ddl: str) -> T.StructType:
    """Column ``run`` of the rows and others."""
    return T.StructType([rows.schema[run], *T.StructType.fromDDL(ddl).fields])


def _in_order(chunk: pa.Table) -> pa.Table:
    return chunk.sort_by([("epoch", "ascending"), ("difficulty", "ascending")], null_placement="at_start")


def _parts(group: pa.Table) -> tuple[list[int], list[carry.Summary]]:
    ordered = group.sort_by("block")
    return ordered.column("block").to_pylist(), list(zip(ordered.column("tests").to_pylist(), ordered.column("exits").to_pylist()))


def _table(schema: T.StructType, *columns: list) -> pa.Table:
    return pa.table([pa.array(values, type=field.type) for values, field in zip(columns, to_arrow_schema(schema))], schema=to_arrow_schema(schema))


def _summarized(chunked: DataFrame, run: str) -> DataFrame:
    schema = _made(chunked, run, _SUMMARY)

    def summary(key: tuple, chunk: pa.Table) -> pa.Table:
        tests, exits = carry.summarize(_in_order(chunk).column("difficulty").to_pylist(), C.UPDATE_ABOVE)
        return _table(schema, *([k.as_py()] for k in key), [tests], [exits])

    return chunked.groupBy(run, "block").applyInArrow(summary, schema)


def _composed(level: DataFrame, run: str, fan: int) -> DataFrame:
    """One summary for each ``fan`` of the level."""
    schema = _made(level, run, _SUMMARY)

    def summary(key: tuple, group: pa.Table) -> pa.Table:
        tests, exits = carry.compose(_parts(group)[1], C.UPDATE_ABOVE)
        return _table(schema, *([k.as_py()] for k in key), [tests], [exits])

    return level.withColumn("group", _group(fan)).groupBy(run, "group").applyInArrow(summary, schema)


def _told(level: DataFrame, above: DataFrame | None, run: str, fan: int) -> DataFrame:
    """run, block and start of every block of a level, from those of the level above (none: a run starts with nothing)."""
    schema = _made(level, run, "block bigint, start double")
    grouped = level.withColumn("group", _group(fan)).groupBy(run, "group")

    def starts(key: tuple, group: pa.Table, start: pa.Table | None = None) -> pa.Table:
        blocks, parts = _parts(group)
        first = start.column("start")[0].as_py() if start is not None and len(start) else None
        return _table(schema, [key[0].as_py()] * len(blocks), blocks, carry.starts(parts, first, C.UPDATE_ABOVE))

    if above is None:
        return grouped.applyInArrow(lambda key, group: starts(key, group), schema)
    return grouped.cogroup(above.groupBy(run, "block")).applyInArrow(lambda key, group, start: starts(key, group, start), schema)


def _replayed(chunked: DataFrame, told: DataFrame | None, run: str) -> DataFrame:
    schema = T.StructType([chunked.schema[run], chunked.schema["epoch"], chunked.schema["difficulty"], T.StructField("applied", T.DoubleType())])

    def replay(chunk: pa.Table, start: pa.Table | None = None) -> pa.Table:
        ordered = _in_order(chunk)
        first = start.column("start")[0].as_py() if start is not None and len(start) else None
        applied = carry.replay(ordered.column("difficulty").to_pylist(), first, C.UPDATE_ABOVE)
        return ordered.select([run, "epoch", "difficulty"]).append_column("applied", pa.array(applied, pa.float64()))

    grouped = chunked.groupBy(run, "block")
    if told is None:
        return grouped.applyInArrow(lambda key, chunk: replay(chunk), schema)
    return grouped.cogroup(told.groupBy(run, "block")).applyInArrow(lambda key, chunk, start: replay(chunk, start), schema)


def _group(fan: int) -> Column:
    return F.floor(F.col("block") / fan).cast("bigint")


def expand_epochs(samples: DataFrame, total_epochs: int) -> DataFrame:
    """Each sample once per epoch; a narrow explode of a constant array."""
    epochs = F.explode(F.sequence(F.lit(0), F.lit(total_epochs - 1))).alias("epoch")
    return samples.select("*", epochs)


def augmented_epochs(
    samples: DataFrame, schedule: C.Schedule, text: bool = True, image: bool = True, seed: int = 0, digits: int | None = None
) -> DataFrame:
    """Per sample and epoch: difficulty in force, phase, text views and the image action.

    The difficulty of an epoch is the schedule's under the update threshold, as the trainer applies it. Where there
    is a ``split`` only ``train`` rows are augmented. Every epoch draws its own paraphrases. A ``tagged`` column of
    the table is used; else questions are tagged by the word list, once per sample, before the epochs multiply it.
    ``digits`` rounds the difficulty that is stated, not the one that is applied.
    """
    spark = samples.sparkSession
    planned = schedule_table(spark, [schedule]).select(F.lit(0).alias("run_id"), "epoch", "difficulty")
    # The mark of an epoch's draw and its stated difficulty are made once an epoch, not once a row.
    stated = F.col("applied") if digits is None else F.round("applied", digits)
    in_force = applied_difficulty(planned).select(
        "epoch", F.col("applied").alias("_difficulty"), stated.alias("difficulty"), F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string")).alias("_draw"))
    train = F.coalesce(F.col("split") == "train", F.lit(False)) if "split" in samples.columns else F.lit(True)
    tagged = F.col("tagged") if "tagged" in samples.columns else paraphrase.lexicon_tag(paraphrase.segment(F.col("question")))
    # Rows that are not augmented carry no candidates through the epochs.
    prepared = samples.withColumn("_options", F.when(train & F.lit(text), paraphrase.candidates(F.col("question"), tagged)))
    rows = expand_epochs(prepared, schedule.total_epochs).join(F.broadcast(in_force), "epoch")  # one row per epoch
    views = paraphrase.pick_views(F.col("question"), F.col("_options"), F.col("_difficulty"), F.col("_draw"))
    views = F.when(train & F.lit(text), views).otherwise(F.array("question"))
    action = F.when(train & F.lit(image), patches.patch_action(F.col("_difficulty"))).otherwise("none")
    return rows.select(
        *samples.columns, "epoch", "difficulty", C.phase(F.col("_difficulty")).alias("phase"),
        views.alias("views"), action.alias("image_action"),
    )


def experiment_matrix(samples: DataFrame, total_epochs: int, strategy: str = "linear") -> DataFrame:
    """Experiments × epochs with the training volume each one feeds.

    Without curriculum the difficulty stays 0, so images are not altered and text has three views.
    """
    spark = samples.sparkSession
    schedule = C.Schedule(total_epochs, strategy)
    switches = spark.createDataFrame(
        list(EXPERIMENTS), "experiment string, text boolean, image boolean, curriculum boolean"
    )
    size = samples.agg(F.count("*").alias("n_samples"))
    rows = switches.select("*", F.explode(F.sequence(F.lit(0), F.lit(total_epochs - 1))).alias("epoch"))
    difficulty = F.when(F.col("curriculum"), schedule.difficulty(F.col("epoch"))).otherwise(F.lit(0.0))
    return (
        rows.withColumn("difficulty", difficulty)
        .withColumn("phase", C.phase(F.col("difficulty")))
        .withColumn("views", F.when(F.col("text"), C.paraphrase_count(F.col("difficulty")) + 1).otherwise(1))
        .withColumn("image_action", F.when(F.col("image"), patches.patch_action(F.col("difficulty"))).otherwise("none"))
        .withColumn("text_rows", F.col("views") * size.scalar())
        .drop("text", "image", "curriculum")
    )
