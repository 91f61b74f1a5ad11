"""Question templates, difficulty scores and hard samples.

Input: ``row_idx, question, answer, img_path`` with a unique ``row_idx`` (see ``adapt``).

Every score depends on a row only through its template, answer, length and number of distinct
tokens. Rows are therefore counted per such *profile* in one scan; supports, ranges, averages and
the percentile come from the small profile table, and rows meet their score in one equi-join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.functions import text
from qaspark.operators.lookups import null_safe_join
from qaspark.operators.ranks import select_ranks, unit_key, unit_percentile
from qaspark.session import materialize

PROFILE = ("template", "answer", "n_tokens", "n_unique")
# More than any position in a text.
PLACES = 1 << 31
COLUMNS = ("row_idx", "question", "answer", "img_path")


@dataclass(frozen=True)
class DifficultyWeights:
    template_rarity: float = 0.4
    answer_rarity: float = 0.35
    question_complexity: float = 0.25

    def normalized(self) -> tuple[float, float, float]:
        parts = (self.template_rarity, self.answer_rarity, self.question_complexity)
        total = sum(parts)
        return tuple(p / total for p in parts) if total else (1 / 3, 1 / 3, 1 / 3)


@dataclass(frozen=True)
class TemplateConfig:
    dataset_name: str = "unknown"
    min_template_support: int = 3
    max_structural_tokens: int = 48
    structural_token_percentile: float = 0.2
    hardness_percentile: float = 0.8
    max_hard_samples: int = 256
    include_special_maps: bool = True
    special_words: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: dict(text.SPECIAL_WORDS)
    )
    weights: DifficultyWeights = field(default_factory=DifficultyWeights)

    def __post_init__(self):
        for name in ("structural_token_percentile", "hardness_percentile"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in [0, 1]")
        for name in ("max_structural_tokens", "max_hard_samples"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be at least 1")

    @property
    def classes(self) -> Mapping[str, Sequence[str]]:
        return self.special_words if self.include_special_maps else {}


def adapt(df: DataFrame, **names: str) -> DataFrame:
    """Bring any table to the input columns, e.g. ``adapt(df, row_idx="id", answer="label")``."""
    if not isinstance(df, DataFrame):
        raise TypeError("expected a DataFrame with question, answer and img_path columns")
    missing = [c for c in COLUMNS if names.get(c, c) not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(names.get(c, c)).alias(c) for c in COLUMNS])


def with_tokens(qa: DataFrame, config: TemplateConfig = TemplateConfig()) -> DataFrame:
    """Add ``tokens``: the normalised token array of the question."""
    return qa.withColumn("tokens", text.normalize_tokens(text.tokens(F.col("question")), config.classes))


def token_counts(qa: DataFrame, config: TemplateConfig = TemplateConfig()) -> DataFrame:
    """``token, n, first_row, first_pos``: frequency and first appearance of each token.

    Row and position travel as one decimal: numbers keep the aggregation hashed, where a struct would
    make Spark sort every token.
    """
    seen = F.col("row_idx").cast("decimal(20,0)") * F.lit(PLACES).cast("decimal(11,0)") + F.col("pos")
    counts = (
        with_tokens(qa, config)
        .select("row_idx", F.posexplode("tokens").alias("pos", "token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"), F.min(seen).alias("seen"))
    )
    return counts.select(
        "token", "n", F.expr(f"seen div {PLACES}").alias("first_row"),
        F.expr(f"cast(seen % {PLACES} as int)").alias("first_pos"),
    )


def structural_tokens(qa: DataFrame, config: TemplateConfig = TemplateConfig()) -> list[str]:
    """The structural vocabulary; at most ``max_structural_tokens`` plus the fixed ones.

    The counts are written once: their number gives the size of the vocabulary, their top its tokens. Only
    these reach the driver.
    """
    counts = materialize(token_counts(qa, config), "tokens")
    unique = counts.count()
    if not unique:
        return sorted(text.PUNCTUATION)
    keep = min(max(1, int(unique * config.structural_token_percentile)), config.max_structural_tokens)
    top = counts.orderBy(F.desc("n"), "first_row", "first_pos").select("token").limit(keep).collect()
    chosen = {row["token"] for row in top}
    return sorted(chosen | set(config.classes) | {text.NUMBER} | set(text.PUNCTUATION))


def with_templates(
    qa: DataFrame, vocabulary: Sequence[str], config: TemplateConfig = TemplateConfig()
) -> DataFrame:
    """Add ``template, n_tokens, n_unique``; narrow, no shuffle."""
    return (
        with_tokens(qa, config)
        .withColumn("template", text.build_template(F.col("tokens"), vocabulary))
        .withColumn("n_tokens", F.size("tokens"))
        .withColumn("n_unique", F.size(F.array_distinct("tokens")))
        .drop("tokens")
    )


def template_support(templated: DataFrame) -> DataFrame:
    return templated.groupBy("template").agg(F.count("*").alias("support"))


def answer_frequency(qa: DataFrame) -> DataFrame:
    return qa.groupBy("answer").agg(F.count("*").alias("frequency"))


def suggest(template_rarity: Column, answer_rarity: Column, complexity: Column) -> Column:
    """Augmentations for a hard sample, from the rounded scores."""
    text_first = template_rarity >= 0.6
    text_last = ~text_first & (complexity >= 0.6)
    picked = F.filter(
        F.array(
            F.when(text_first, F.lit("text")),
            F.when(answer_rarity >= 0.6, F.lit("image")),
            F.when(text_last, F.lit("text")),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(picked) == 0, F.array(F.lit("image"))).otherwise(picked)


def _ratio() -> Column:
    return F.col("n_unique") / F.greatest(F.lit(1), F.col("n_tokens"))


class TemplateReport:
    """Lazily built result tables of one extraction run."""

    def __init__(self, qa: DataFrame, config: TemplateConfig = TemplateConfig()):
        self.config = config
        self.qa = adapt(qa)

    @cached_property
    def structural_tokens(self) -> list[str]:
        return structural_tokens(self.qa, self.config)

    @cached_property
    def templated(self) -> DataFrame:
        return with_templates(self.qa, self.structural_tokens, self.config)

    @cached_property
    def profiles(self) -> DataFrame:
        """One row per profile with its count and first row; written once."""
        grouped = self.templated.groupBy(*PROFILE)
        return materialize(grouped.agg(F.count("*").alias("n"), F.min("row_idx").alias("first_idx")), "profiles")

    @cached_property
    def supported_profiles(self) -> DataFrame:
        """Profiles with the ``support`` of their template and ``frequency`` of their answer; written once."""
        support = self.profiles.groupBy("template").agg(F.sum("n").alias("support"))
        frequency = self.profiles.groupBy("answer").agg(F.sum("n").alias("frequency"))
        joined = null_safe_join(null_safe_join(self.profiles, support, ["template"]), frequency, ["answer"])
        return materialize(joined, "supported")

    @cached_property
    def ranges(self) -> DataFrame:
        """One row: smallest and largest support, answer frequency, length and token ratio."""
        values = {
            "support": F.col("support"), "frequency": F.col("frequency"), "length": F.col("n_tokens"), "ratio": _ratio(),
        }
        return self.supported_profiles.agg(*[
            agg(value.cast("double")).alias(f"{side}_{name}")
            for name, value in values.items() for side, agg in (("min", F.min), ("max", F.max))
        ])

    @cached_property
    def scored_profiles(self) -> DataFrame:
        """Profiles with ``difficulty`` and the three reason scores; narrow over the written table."""
        bounds = self.ranges.select(F.struct("*")).scalar()
        lit = {name: bounds[name] for name in self.ranges.columns}
        w_template, w_answer, w_question = self.config.weights.normalized()
        scored = (
            self.supported_profiles
            .withColumn("template_rarity", text.inverse_scale(F.col("support"), lit["min_support"], lit["max_support"]))
            .withColumn("answer_rarity", text.inverse_scale(F.col("frequency"), lit["min_frequency"], lit["max_frequency"]))
            .withColumn(
                "question_complexity",
                F.lit(0.6) * text.scale(F.col("n_tokens"), lit["min_length"], lit["max_length"])
                + F.lit(0.4) * text.scale(_ratio(), lit["min_ratio"], lit["max_ratio"]),
            )
            .withColumn(
                "difficulty",
                F.lit(w_template) * F.col("template_rarity")
                + F.lit(w_answer) * F.col("answer_rarity")
                + F.lit(w_question) * F.col("question_complexity"),
            )
            .withColumn("difficulty", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("difficulty"))))
        )
        for reason in ("template_rarity", "answer_rarity", "question_complexity"):
            scored = scored.withColumn(reason, F.round(reason, 4))
        return scored

    @cached_property
    def scored(self) -> DataFrame:
        """Each row with its template, difficulty and reasons.

        Rows carry the large side; adaptive execution broadcasts a small profile table and splits
        hot profiles of a large one.
        """
        scores = self.scored_profiles.drop("n", "first_idx")
        return null_safe_join(self.templated, scores, PROFILE)

    @cached_property
    def templates(self) -> DataFrame:
        """``template, support, avg_difficulty, representative_*`` for templates with enough support."""
        stats = (
            self.scored_profiles.groupBy("template")
            .agg(
                F.sum("n").alias("support"),
                F.round(F.sum(F.col("difficulty") * F.col("n")) / F.sum("n"), 4).alias("avg_difficulty"),
                F.min("first_idx").alias("first_idx"),
            )
            .filter(F.col("support") >= self.config.min_template_support)
        )
        questions = self.qa.select(
            F.col("row_idx").alias("first_idx"), F.col("question").alias("representative_question"),
            F.col("answer").alias("representative_answer"),
        )
        # A repeated id would give a template two first rows; such a table is refused.
        found = stats.join(questions, "first_idx").groupBy(
            "template", "support", "avg_difficulty", "first_idx"
        ).agg(*(F.max(name).alias(name) for name in ("representative_question", "representative_answer")), F.count("*").alias("rows"))
        repeated = F.raise_error(F.concat(F.lit("row_idx is not unique: "), F.col("first_idx").cast("string"))).cast("boolean")
        return found.filter(F.when(F.col("rows") == 1, F.lit(True)).otherwise(repeated)).select(
            "template", "support", "avg_difficulty", "representative_question", "representative_answer", "first_idx"
        ).orderBy(F.desc("avg_difficulty"), "first_idx")

    def get_template(self, template: str) -> DataFrame:
        return self.templates.filter(F.col("template") == template)

    @cached_property
    def members(self) -> DataFrame:
        """``template, row_idx``: the samples of each reported template, one row each.

        Long form on purpose: one template may hold a large share of all rows, and a list of them in
        one cell would have to pass through one task.
        """
        kept = (
            self.profiles.groupBy("template").agg(F.sum("n").alias("support"))
            .filter(F.col("support") >= self.config.min_template_support).select("template")
        )
        return null_safe_join(self.templated.select("template", "row_idx"), kept, ["template"])

    @cached_property
    def hard_threshold(self) -> float:
        return unit_percentile(
            self.scored_profiles, "difficulty", self.config.hardness_percentile, weight="n"
        )

    @cached_property
    def hard_samples(self) -> DataFrame:
        """The hardest rows at or above the percentile, hardest first.

        The threshold is compared at ten decimals, the order is by difficulty itself. Profiles hold the row
        counts, so the difficulty at which the hardest rows are reached is known before any row moves.
        """
        level, most = F.round("difficulty", 10), self.config.max_hard_samples
        hard = self.scored_profiles.filter(level >= F.lit(round(self.hard_threshold, 10)))
        keyed = hard.select(unit_key(F.col("difficulty")).alias("key"), "n")
        lowest = select_ranks(keyed, "key", lambda total: [max(total - most, 0)] if total else [], "n", step=4)
        if lowest:
            hard = hard.filter(unit_key(F.col("difficulty")) >= F.lit(min(lowest.values())))
        return (
            null_safe_join(self.templated, hard.drop("n", "first_idx"), PROFILE)
            .orderBy(F.desc("difficulty"), "row_idx")
            .limit(self.config.max_hard_samples)
            .select(
                F.col("row_idx").alias("index"), "question", "answer", "img_path", "template",
                F.round("difficulty", 4).alias("difficulty"),
                "template_rarity", "answer_rarity", "question_complexity",
                suggest(
                    F.col("template_rarity"), F.col("answer_rarity"), F.col("question_complexity")
                ).alias("suggested_augmentations"),
            )
        )

    @cached_property
    def payload(self) -> DataFrame:
        """Hard samples as one JSON record each, for augmentation jobs."""
        reasons = F.struct("template_rarity", "answer_rarity", "question_complexity")
        record = F.struct(
            "index", "img_path", "question", "answer", "template", "difficulty",
            reasons.alias("reason_scores"), "suggested_augmentations",
        )
        return self.hard_samples.select("index", F.to_json(record).alias("record"))


def extract(qa: DataFrame, config: TemplateConfig = TemplateConfig()) -> TemplateReport:
    return TemplateReport(qa, config)
