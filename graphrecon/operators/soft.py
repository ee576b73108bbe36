"""Topology loss terms on pair probabilities, one value per sample.

Input: ``pairs(keys, a, b, p, y)``, every pair of a sample once, with its probability and its
label, and ``sizes(keys, n)``, the node count of each sample. The long pair table is the
adjacency; only the triangle sums turn one bounded sample at a time into a matrix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrecon.session import task_slots

EPSILON = 1e-8  # fixed value: guard in the denominators
DEGREE_BINS = 64  # fixed values: default numbers of histogram centres
CLUSTERING_BINS = 100
DENSITY_FORMS = ("squared_ratio", "log_ratio", "log_ratio_huber")


def density_penalty(pred: Column, true: Column, form: str = "log_ratio_huber") -> Column:
    """Penalty of a density off the true one; with no true edges, the predicted density squared."""
    if form not in DENSITY_FORMS:
        raise ValueError(f"form must be one of {DENSITY_FORMS}")
    if form == "squared_ratio":
        value = F.pow(pred / (true + EPSILON) - 1.0, F.lit(2.0))
    else:
        log_ratio = F.log((pred + EPSILON) / (true + EPSILON))
        value = log_ratio * log_ratio
        if form == "log_ratio_huber":
            value = F.when(F.abs(log_ratio) < 1.0, 0.5 * value).otherwise(F.abs(log_ratio) - 0.5)
    return F.when(true <= EPSILON, pred * pred).otherwise(value)


def pair_terms(
    pairs: DataFrame, sizes: DataFrame, keys: Sequence[str], form: str = "log_ratio_huber"
) -> DataFrame:
    """Soft similarity loss and soft density penalty per sample."""
    sums = pairs.groupBy(*keys).agg(
        F.sum("p").alias("sp"),
        F.sum("y").alias("sy"),
        F.sum(F.abs(F.col("p") - F.col("y"))).alias("sd"),
    )
    total = F.col("sp") + F.col("sy")
    similarity = F.when(total > EPSILON, F.col("sd") / (total + EPSILON)).otherwise(0.0)
    slots = (F.col("n") * (F.col("n") - 1)).cast("double")
    density = density_penalty(2.0 * F.col("sp") / slots, 2.0 * F.col("sy") / slots, form)
    return sums.join(sizes, list(keys)).select(
        *keys, similarity.alias("graph_similarity"), density.alias("relative_density")
    )


def _histogram_mmd(
    values: DataFrame, keys: Sequence[str], bins: int, width: float, sigma: float
) -> DataFrame:
    """MMD between soft histograms of ``pv`` and ``yv``, with centres even from 0 to ``last``."""
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    steps = max(2, bins) - 1
    spread = values.select(
        *keys, "pv", "yv", "last", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("bin")
    )
    centre = F.col("last") * F.col("bin") / float(steps)

    def bar(column: str) -> Column:
        off = (F.col(column) - centre) / width
        return F.sum(F.exp(-0.5 * off * off))

    bars = spread.groupBy(*keys, "bin").agg(bar("pv").alias("pw"), bar("yv").alias("yw"))
    totals = bars.groupBy(*keys).agg(F.sum("pw").alias("pt"), F.sum("yw").alias("yt"))
    gap = F.abs(F.col("pw") / (F.col("pt") + EPSILON) - F.col("yw") / (F.col("yt") + EPSILON))
    tv = bars.join(totals, list(keys)).groupBy(*keys).agg((F.sum(gap) * 0.5).alias("tv"))
    kernel = F.exp(-(F.col("tv") * F.col("tv")) / (2.0 * sigma * sigma))
    return tv.select(*keys, (2.0 - 2.0 * kernel).alias("mmd"))


def soft_degrees(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of probabilities ``pv`` and of labels ``yv`` around each node."""
    ends = pairs.select(*keys, F.explode(F.array("a", "b")).alias("id"), "p", "y")
    return ends.groupBy(*keys, "id").agg(F.sum("p").alias("pv"), F.sum("y").alias("yv"))


def degree_mmd(
    pairs: DataFrame, sizes: DataFrame, keys: Sequence[str], bins: int = DEGREE_BINS, sigma: float = 1.0
) -> DataFrame:
    """Soft degree MMD: Gaussian bars of width sigma, centres from 0 to n - 1."""
    last = F.greatest(F.lit(1), F.col("n") - 1).cast("double").alias("last")
    values = soft_degrees(pairs, keys).join(sizes, list(keys)).select(*keys, "pv", "yv", last)
    return _histogram_mmd(values, keys, bins, sigma, sigma)


def soft_clustering(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted local clustering of each node in [0, 1], of probabilities and of labels.

    Triangle mass over d (d - 1), 0 where that is not positive. All pairs of a sample carry
    weight, so its triangles are a matrix product; a sample is one row of bounded size, and
    the samples are spread over the tasks.
    """
    keys = list(keys)
    packed = pairs.groupBy(*keys).agg(F.collect_list(F.struct("a", "b", "p", "y")).alias("es"))
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    schema += f", id {kinds['a']}, pv double, yv double"
    named = packed.withColumn("ids", F.array_sort(
        F.array_distinct(F.flatten(F.transform("es", lambda e: F.array(e["a"], e["b"])))))
    ).select(
        *keys,
        "ids",
        F.transform("es", lambda e: F.array_position("ids", e["a"]).cast("int") - 1).alias("i"),
        F.transform("es", lambda e: F.array_position("ids", e["b"]).cast("int") - 1).alias("j"),
        F.transform("es", lambda e: e["p"].cast("double")).alias("p"),
        F.transform("es", lambda e: e["y"].cast("double")).alias("y"),
    )

    def coefficients(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
        a = np.zeros((n, n))
        a[i, j] = w
        a[j, i] = w
        degree = a.sum(axis=1)
        mass = ((a @ a) * a).sum(axis=1)
        slots = degree * (degree - 1.0)
        usable = slots > EPSILON
        return np.clip(np.where(usable, mass / np.where(usable, slots + EPSILON, 1.0), 0.0), 0, 1)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                n, i, j = len(row["ids"]), np.asarray(row["i"]), np.asarray(row["j"])
                columns = {c: coefficients(n, i, j, np.asarray(row[c])) for c in ("p", "y")}
                yield pd.DataFrame(
                    {
                        **{k: [row[k]] * n for k in keys},
                        "id": list(row["ids"]),
                        "pv": columns["p"],
                        "yv": columns["y"],
                    }
                )

    return named.repartition(task_slots(named.sparkSession)).mapInPandas(solve, schema)


def clustering_mmd(
    pairs: DataFrame, keys: Sequence[str], bins: int = CLUSTERING_BINS, sigma: float = 1.0
) -> DataFrame:
    """Soft clustering MMD: narrow bars of width sigma / bins, centres from 0 to 1."""
    values = soft_clustering(pairs, keys).withColumn("last", F.lit(1.0))
    return _histogram_mmd(values, keys, bins, max(sigma / max(1, bins), EPSILON), sigma)


def weighted_total(
    similarity: Column,
    density: Column,
    degree: Column,
    clustering: Column,
    alpha: float = 0.5,
    beta: float = 1.0,
    gamma: float = 0.3,
    delta: float = 0.3,
) -> Column:
    return alpha * similarity + beta * density + gamma * degree + delta * clustering


def grouped_objectives(
    similarity: Column,
    density: Column,
    degree: Column,
    clustering: Column,
    alpha: float = 0.5,
    beta: float = 1.0,
    gamma: float = 0.3,
    delta: float = 0.3,
) -> tuple[Column, Column]:
    """The density objective and the shape objective."""
    return beta * density, alpha * similarity + gamma * degree + delta * clustering


def validation_penalty(
    graph_sim: Column,
    relative_density: Column,
    deg_mmd: Column,
    cc_mmd: Column,
    alpha: float = 0.5,
    beta: float = 1.0,
    gamma: float = 0.3,
    delta: float = 0.3,
) -> Column:
    """Weighted penalty of hard metrics: similarity off 1, density off 1 squared, both MMDs."""
    off = relative_density - 1.0
    return alpha * (1.0 - graph_sim) + beta * off * off + gamma * deg_mmd + delta * cc_mmd


def topology_losses(
    pairs: DataFrame,
    sizes: DataFrame,
    keys: Sequence[str],
    degree_bins: int = DEGREE_BINS,
    clustering_bins: int = CLUSTERING_BINS,
    sigma: float = 1.0,
    form: str = "log_ratio_huber",
) -> DataFrame:
    """All four terms and their weighted total, one row per sample."""
    keys = list(keys)
    degree = degree_mmd(pairs, sizes, keys, degree_bins, sigma)
    clustering = clustering_mmd(pairs, keys, clustering_bins, sigma)
    terms = (
        pair_terms(pairs, sizes, keys, form)
        .join(degree.withColumnRenamed("mmd", "degree_mmd"), keys)
        .join(clustering.withColumnRenamed("mmd", "clustering_mmd"), keys)
    )
    names = ("graph_similarity", "relative_density", "degree_mmd", "clustering_mmd")
    return terms.withColumn("total_topology", weighted_total(*[F.col(n) for n in names]))
