"""Text augmentation of samples and the registry of augmentations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.functions import paraphrase, patches
from qaspark.functions.curriculum import clamp
from qaspark.functions.let import let


def synonym_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(paraphrase.synonym_rows(), "pos string, word string, synonym string")


def tag_questions(samples: DataFrame) -> DataFrame:
    """Add ``tagged``; a table that brings its own ``array<struct<word, pos>>`` keeps it."""
    if "tagged" in samples.columns:
        return samples
    return samples.withColumn("tagged", paraphrase.lexicon_tag(paraphrase.segment(F.col("question"))))


RULES = ("synonym", "adverb", "passive")


def paraphrases(samples: DataFrame, rules: Sequence[str] = RULES) -> DataFrame:
    """``row_idx, rule, candidate``: every candidate of the rules with the rule that made it, before merging."""
    tagged = tag_questions(samples)
    t = F.col("tagged")

    def named(rule: str, candidate: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), candidate.alias("candidate"))

    makers = {
        "synonym": lambda t: F.transform(paraphrase.synonym_variants(t), lambda c: named("synonym", c)),
        "adverb": lambda t: F.array(named("adverb", paraphrase.fronted_adverb(t))),
        "passive": lambda t: F.array(named("passive", paraphrase.passive(t))),
    }
    every = let(t, lambda t: F.concat(*[makers[rule](t) for rule in rules]))
    # The outer form keeps the optimizer from computing the array a second time to test its size.
    made = tagged.select("row_idx", F.explode_outer(every).alias("r"))
    return made.select("row_idx", "r.*").filter("candidate is not null")


def paraphrase_candidates(samples: DataFrame) -> DataFrame:
    """Add ``candidates``: distinct paraphrases other than the question."""
    tagged = tag_questions(samples)
    return tagged.withColumn("candidates", paraphrase.candidates(F.col("question"), F.col("tagged"))).drop(*["tagged"] * ("tagged" not in samples.columns))


def paraphrase_views(samples: DataFrame, difficulty: Column | float = 0.0, seed: int = 0) -> DataFrame:
    """Add ``views``: the question and as many paraphrases as the difficulty asks for."""
    level = clamp(difficulty if isinstance(difficulty, Column) else F.lit(float(difficulty)))
    picked = paraphrase.pick_views(F.col("question"), F.col("candidates"), level, seed)
    return paraphrase_candidates(samples).withColumn("views", picked).drop("candidates")


def expand_views(samples: DataFrame, views: str = "views") -> DataFrame:
    """One row per view: ``view_idx`` 0 is the original, ``text`` the wording.

    Views are never empty; the outer form spares a second computation to test that.
    """
    others = [c for c in samples.columns if c != views]
    return samples.select(*others, F.posexplode_outer(views).alias("view_idx", "text"))


Augmentation = Callable[..., Callable[[DataFrame], DataFrame]]


def _rule_based(difficulty: float = 0.0, seed: int | None = None) -> Callable[[DataFrame], DataFrame]:
    return lambda df: paraphrase_views(df, difficulty, seed or 0)


def _masked(
    difficulty: float = 0.0, patch_size: int = patches.PATCH_SIZE, mask_ratio: float | None = None,
    seed: int | None = None,
) -> Callable[[DataFrame], DataFrame]:
    level = clamp(F.lit(float(difficulty)))
    plan = patches.patch_plan(
        F.col("image_id"), F.col("height"), F.col("width"), level, patch_size, mask_ratio, seed=seed or 0
    )
    return lambda df: df.withColumn("plan", plan)


def _nothing(**_options) -> Callable[[DataFrame], DataFrame]:
    """Text and images stay as they are; options of other augmentations are accepted and ignored."""
    return lambda df: df


TEXT: dict[str, Augmentation] = {"rule-based": _rule_based, "none": _nothing}
IMAGE: dict[str, Augmentation] = {"masked": _masked, "none": _nothing}


def register(kind: dict[str, Augmentation], name: str, factory: Augmentation) -> None:
    """Make a user's augmentation available: ``factory(**options)`` returns a DataFrame function."""
    if not callable(factory):
        raise ValueError("an augmentation is a function that returns a DataFrame function")
    kind[name.lower()] = factory


def create(kind: dict[str, Augmentation], name: str, **options) -> Callable[[DataFrame], DataFrame]:
    """The named augmentation, for ``df.transform``."""
    if name.lower() not in kind:
        raise ValueError(f"unknown augmentation {name}; known: {', '.join(kind)}")
    return kind[name.lower()](**options)


def augment(samples: DataFrame, function: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Apply an augmentation, or none for ``None``."""
    return samples if function is None else samples.transform(function)


def augment_column(
    samples: DataFrame, function: Callable[[Column], Column] | None, column: str = "question"
) -> DataFrame:
    """Replace a column by a column function or pandas UDF of it; ``None`` leaves it."""
    return samples if function is None else samples.withColumn(column, function(F.col(column)))
