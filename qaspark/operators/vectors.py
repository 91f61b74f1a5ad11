"""Pooling of several vectors per item, and a late-fusion classifier."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.operators.lookups import null_safe_join

METHODS = ("mean", "sum", "max", "first")


def _checked(vector: str, dim: int | None) -> Column:
    """The vector, which must have ``dim`` elements if that is given."""
    if dim is None:
        return F.col(vector)
    wrong = F.raise_error(F.concat(F.lit(f"a vector has not {dim} elements but "), F.size(vector).cast("string")))
    return F.when(F.col(vector).isNull() | (F.size(vector) == dim), F.col(vector)).otherwise(wrong.cast("array<double>"))


def _pooled(views: DataFrame, aggregate: Callable[[Column], Column], item: str) -> DataFrame:
    """``item, pooled``: one aggregate per item and dimension of the column ``v``.

    Dimensions are rows, so any width is one hash aggregation that combines map-side: an item with very many views
    is no hot spot. Vectors of one item must agree in size; an item without any vector gives an empty one.
    """
    cells = views.select(item, *[c for c in views.columns if c.startswith("_")], F.posexplode_outer("_vector").alias("dim", "v"))
    sums = cells.groupBy(item, "dim").agg(aggregate(F.col("v").cast("double")).alias("value"), F.count("*").alias("n"))
    gathered = sums.groupBy(item).agg(
        F.array_sort(F.collect_list(F.when(F.col("dim").isNotNull(), F.struct("dim", "value")))).alias("cells"),
        F.min(F.when(F.col("dim").isNotNull(), F.col("n"))).alias("least"), F.max(F.when(F.col("dim").isNotNull(), F.col("n"))).alias("most"))
    uneven = F.raise_error(F.lit("the vectors of an item differ in size")).cast("boolean")
    even = gathered.filter(F.when((F.col("least") == F.col("most")) | F.col("least").isNull(), F.lit(True)).otherwise(uneven))
    return even.select(item, F.col("cells.value").alias("pooled"))


def pool_views(
    views: DataFrame, method: str, dim: int | None = None, item: str = "item", view: str = "view_idx", vector: str = "vector"
) -> DataFrame:
    """``item, pooled`` by mean, sum, max or the first view, or by ``weighted`` and ``gated`` with their defaults."""
    if method == "weighted":
        return pool_weighted(views, dim, None, item, view, vector)
    if method == "gated":
        return pool_gated(views, dim, "score", item, vector)
    if method not in METHODS:
        raise ValueError(f"unknown pooling {method}; known: {', '.join((*METHODS, 'weighted', 'gated'))}")
    checked = views.withColumn("_vector", _checked(vector, dim))
    if method == "first":
        return checked.groupBy(item).agg(F.min_by("_vector", view).cast("array<double>").alias("pooled"))
    return _pooled(checked.select(item, "_vector"), {"mean": F.avg, "sum": F.sum, "max": F.max}[method], item)


def pool_weighted(
    views: DataFrame, dim: int | None = None, weights: Sequence[float] | None = None,
    item: str = "item", view: str = "view_idx", vector: str = "vector",
) -> DataFrame:
    """Sum weighted by the softmax of the position weights of the views present.

    ``weights`` defaults to ten equal ones; an item may not have more views than weights.
    """
    values = list(weights) if weights is not None else [0.1] * 10
    top = max(values)
    table = F.array(*[F.exp(F.lit(float(v) - top)) for v in values])
    weight = F.when(F.col(view) < len(values), F.get(table, F.col(view).cast("int"))).otherwise(
        F.raise_error(F.lit(f"more than {len(values)} views")).cast("double")
    )
    rows = views.select(item, _checked(vector, dim).alias("_vector"), weight.alias("_w"))
    return _pooled(rows, lambda v: F.sum(v * F.col("_w")) / F.sum("_w"), item)


def pool_gated(
    views: DataFrame, dim: int | None = None, score: str = "score", item: str = "item", vector: str = "vector"
) -> DataFrame:
    """Sum weighted by the softmax of a per-view score within the item.

    The largest score per item is one small aggregate joined back, which keeps the exponent in range
    without sorting an item's views in one task.
    """
    peak = views.groupBy(item).agg(F.max(score).alias("_peak"))
    scaled = null_safe_join(views, peak, [item])
    rows = scaled.select(item, _checked(vector, dim).alias("_vector"), F.exp(F.col(score) - F.col("_peak")).alias("_w"))
    return _pooled(rows, lambda v: F.sum(v * F.col("_w")) / F.sum("_w"), item)


def pool_custom(
    views: DataFrame, aggregate: Callable[[Column], Column], dim: int | None = None, item: str = "item", vector: str = "vector"
) -> DataFrame:
    """A user's pooling: ``aggregate`` turns one dimension's column into an aggregate of it.

    Built-in aggregates combine map-side; a grouped-aggregate pandas UDF works too, for items whose
    views fit one batch.
    """
    return _pooled(views.select(item, _checked(vector, dim).alias("_vector")), aggregate, item)


def fusion_features(samples: DataFrame, image: str = "image_vector", text: str = "text_vector") -> DataFrame:
    """Add ``features``: image and text vector side by side, as an ML vector."""
    from pyspark.ml.functions import array_to_vector

    joined = F.concat(F.col(image).cast("array<double>"), F.col(text).cast("array<double>"))
    return samples.withColumn("features", array_to_vector(joined))


def fit_fusion(
    samples: DataFrame, image_dim: int, text_dim: int, classes: int, hidden: int = 32,
    iterations: int = 50, seed: int = 71,
):
    """Late-fusion answer classifier on precomputed vectors; expects ``label``.

    Spark's perceptron trains by distributed gradients; its hidden layer is a sigmoid.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    layers = [image_dim + text_dim, hidden, classes]
    learner = MultilayerPerceptronClassifier(
        layers=layers, maxIter=iterations, seed=seed, featuresCol="features", labelCol="label"
    )
    return learner.fit(fusion_features(samples))
