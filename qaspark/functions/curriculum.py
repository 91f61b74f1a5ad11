"""Difficulty schedules and the phases they imply."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strategy names, phase bounds, and the change that counts as an update.
STRATEGIES = ("linear", "cosine", "exponential", "step", "polynomial")
EASY_BELOW = 0.33
MEDIUM_BELOW = 0.66
UPDATE_ABOVE = 0.01


@dataclass(frozen=True)
class Schedule:
    """Difficulty as a function of the epoch.

    ``exponential`` falls from hard to easy by its formula; ``reverse`` runs it the other way.
    Epochs past the end are not clamped.
    """

    total_epochs: int
    strategy: str = "linear"
    min_difficulty: float = 0.0
    max_difficulty: float = 1.0
    warmup_epochs: int = 0
    gamma: float = 0.1
    step_size: int | None = None
    power: float = 2.0
    reverse: bool = False

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}; known: {', '.join(STRATEGIES)}")
        if not 0.0 <= self.min_difficulty <= self.max_difficulty <= 1.0:
            raise ValueError("need 0 <= min_difficulty <= max_difficulty <= 1")
        if self.warmup_epochs >= self.total_epochs:
            raise ValueError("warmup_epochs must be below total_epochs")
        if self.strategy == "step" and self.step < 1:
            raise ValueError("the step strategy needs a step of at least one epoch")

    @property
    def step(self) -> int:
        return self.total_epochs // 3 if self.step_size is None else self.step_size

    @property
    def key_epochs(self) -> list[int]:
        t = self.total_epochs
        return [0, t // 4, t // 2, 3 * t // 4, t - 1]

    def _progress(self, epoch: Column) -> Column:
        done = (epoch - self.warmup_epochs).cast("double")
        total = self.total_epochs - self.warmup_epochs
        share = done / F.lit(float(max(total - 1, 1)))
        if self.strategy == "linear":
            return share
        if self.strategy == "cosine":
            return (F.lit(1.0) - F.cos(F.lit(math.pi) * done / F.lit(float(max(total - 1, 1))))) / 2
        if self.strategy == "exponential":
            left = done if self.reverse else F.lit(float(total)) - done
            return F.lit(1.0) - F.pow(F.lit(self.gamma), left / F.lit(float(total)))
        if self.strategy == "step":
            return F.least(F.floor(done / F.lit(float(self.step))) * F.lit(self.gamma), F.lit(1.0))
        return F.pow(share, F.lit(self.power))

    def difficulty(self, epoch: Column) -> Column:
        span = self.max_difficulty - self.min_difficulty
        scaled = F.lit(self.min_difficulty) + self._progress(epoch) * F.lit(span)
        return F.when(epoch < self.warmup_epochs, F.lit(self.min_difficulty)).otherwise(scaled)


def clamp(difficulty: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), difficulty))


def phase(difficulty: Column) -> Column:
    return (
        F.when(difficulty < EASY_BELOW, F.lit("easy"))
        .when(difficulty < MEDIUM_BELOW, F.lit("medium"))
        .otherwise(F.lit("hard"))
    )


def paraphrase_count(difficulty: Column) -> Column:
    """Paraphrases beside the original: two when easy, one when medium, none when hard."""
    return F.when(difficulty < EASY_BELOW, F.lit(2)).when(difficulty < MEDIUM_BELOW, F.lit(1)).otherwise(F.lit(0))
