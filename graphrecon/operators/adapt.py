"""Class centroids, pseudo labels and the loss values of unsupervised adaptation."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrecon.functions.keys import let
from graphrecon.functions.rows import beside
from graphrecon.functions.scoring import class_cross_entropy, entropy
from graphrecon.functions.vectors import dot, unit


def soft_centroids(
    rows: DataFrame, epsilon: float = 1e-5, features: str = "features", probs: str = "probs"
) -> DataFrame:
    """Probability-weighted mean vector per class: ``class, centroid``.

    Whole vectors are summed inside each task before the shuffle; the result has as many rows as
    there are classes. A class without any mass gets zeros.
    """
    per_class = rows.select(
        array_to_vector(features).alias("v"), F.posexplode(probs).alias("class", "w")
    )
    mass = per_class.groupBy("class").agg(F.sum("w").alias("mass"))
    sums = (
        per_class.filter(F.col("w") > 0)
        .groupBy("class")
        .agg(vector_to_array(Summarizer.sum(F.col("v"), F.col("w"))).alias("s"))
    )
    met = beside(
        mass.join(sums, "class", "left"), rows.agg(F.max(F.size(features)).alias("width"))
    )
    whole = F.coalesce("s", F.array_repeat(F.lit(0.0), F.col("width")))
    mean = let(
        F.greatest(F.col("mass"), F.lit(epsilon)), lambda m: F.transform(whole, lambda x: x / m)
    )
    return met.select("class", mean.alias("centroid"))


def centroid_scores(
    rows: DataFrame, centroids: DataFrame, features: str = "features", epsilon: float = 1e-5
) -> DataFrame:
    """Add ``scores``: an array of (class, cosine to its centroid), in order of class.

    The centroids become one array (one entry per class) that goes to every task; each row looks
    through it by itself, so no pair of row and class is shuffled.
    """
    table = centroids.agg(
        F.array_sort(
            F.collect_list(F.struct("class", unit(F.col("centroid"), epsilon).alias("unit")))
        ).alias("__table")
    )
    met = beside(rows, table)
    scores = let(
        unit(F.col(features), epsilon),
        lambda mine: F.transform(
            "__table", lambda c: F.struct(c["class"], dot(mine, c["unit"]).alias("score"))
        ),
    )
    return met.select(*rows.columns, scores.alias("scores"))


def pseudo_labels(
    rows: DataFrame, centroids: DataFrame, key: str, features: str = "features", epsilon: float = 1e-5
) -> DataFrame:
    """Class of the centroid with the highest cosine, the first class on a tie."""
    ranked = F.transform("scores", lambda s: F.struct(s["score"], (-s["class"]).alias("first")))
    best = centroid_scores(rows, centroids, features, epsilon).select(
        key, F.array_max(ranked).alias("best")
    )
    return best.select(
        key, (-F.col("best.first")).alias("class"), F.col("best.score").alias("score")
    )


def entropy_loss(probs: str = "probs", epsilon: float = 1e-5) -> Column:
    """Aggregate: mean entropy of the rows."""
    return F.avg(entropy(F.col(probs), epsilon))


def diversity_loss(rows: DataFrame, probs: str = "probs", epsilon: float = 1e-5) -> DataFrame:
    """One row: sum of m ln m over the mean probability m of each class."""
    means = (
        rows.select(F.posexplode(probs).alias("class", "p"))
        .groupBy("class")
        .agg(F.greatest(F.avg("p"), F.lit(epsilon)).alias("m"))
    )
    return means.agg(F.sum(F.col("m") * F.log("m")).alias("diversity"))


def adaptation_losses(
    rows: DataFrame,
    label: str = "class",
    logits: str = "logits",
    probs: str = "probs",
    entropy_weight: float = 1.0,
    diversity_weight: float = 1.0,
    beta: float = 0.3,
    epsilon: float = 1e-5,
) -> DataFrame:
    """One row: entropy, diversity, pseudo-label cross entropy, and their weighted sum."""
    means = rows.agg(
        entropy_loss(probs, epsilon).alias("entropy"),
        F.avg(class_cross_entropy(F.col(logits), F.col(label))).alias("pseudo_ce"),
    )
    total = (
        entropy_weight * F.col("entropy")
        + diversity_weight * F.col("diversity")
        + beta * F.col("pseudo_ce")
    )
    both = beside(means, diversity_loss(rows, probs, epsilon))
    return both.select("entropy", "diversity", "pseudo_ce", total.alias("total"))
