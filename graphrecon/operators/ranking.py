"""Comparison tables: metric columns per strategy, ranks, average rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphrecon.functions.parsing import printed_float
from graphrecon.functions.schedules import ranking_value

# Strategy and metric names with their column spellings, in report order.
STRATEGY_PREFIX = {"BFS": "bfs", "DFS": "dfs", "RANDOM_WALK": "rw"}
METRIC_SUFFIX = {
    "graph_sim": "graph_sim",
    "relative_density": "relative_density",
    "deg_dist_mmd": "deg_dist",
    "cc_mmd": "cc",
    "laplacian_eigen_mmd": "spectral",
}
METRIC_COLUMNS = [f"{p}_{m}" for p in STRATEGY_PREFIX.values() for m in METRIC_SUFFIX.values()]


def flatten_metrics(long_rows: DataFrame) -> DataFrame:
    """``category, model, strategy, <five metrics>`` rows to one row of fifteen columns per model."""
    cells = [
        F.max(F.when(F.col("strategy") == s, F.col(m))).cast("double").alias(f"{p}_{c}")
        for s, p in STRATEGY_PREFIX.items()
        for m, c in METRIC_SUFFIX.items()
    ]
    return long_rows.groupBy("category", "model").agg(*cells)


def metric_ranks(
    wide: DataFrame, columns: Sequence[str] = METRIC_COLUMNS, key: str = "model"
) -> DataFrame:
    """Competition rank of each model in each metric: ``model, metric, value, rank``."""
    tall = wide.unpivot([key], list(columns), "metric", "value")
    window = Window.partitionBy("metric").orderBy(ranking_value(F.col("metric"), F.col("value")))
    return tall.withColumn("rank", F.rank().over(window))


def comparison_table(
    wide: DataFrame, columns: Sequence[str] = METRIC_COLUMNS, key: str = "model"
) -> DataFrame:
    """The rows with ``avg_rank_score`` and ``avg_rank``, best first. One row per model.

    The report has one row per compared model, so ranking them in one window is small work.
    """
    scores = metric_ranks(wide, columns, key).groupBy(key).agg(
        (F.sum("rank") / float(len(columns))).alias("avg_rank_score")
    )
    window = Window.partitionBy(F.lit(0)).orderBy("avg_rank_score")
    ranked = scores.withColumn("avg_rank", F.rank().over(window))
    return wide.join(ranked, key).orderBy("avg_rank", "avg_rank_score", key)


def with_own_rows(baselines: DataFrame, own: DataFrame) -> DataFrame:
    """Baseline rows and the rows of the model under test, one table ``category, model`` and metrics."""
    columns = ["category", "model", *METRIC_COLUMNS]
    return baselines.select(*columns).unionByName(own.select(*columns))


def require_unique_models(wide: DataFrame, key: str = "model") -> None:
    twice = wide.groupBy(key).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"model {twice[0][key]!r} occurs more than once")


def markdown_rows(
    table: DataFrame, columns: Sequence[str] = METRIC_COLUMNS
) -> DataFrame:
    """The table's rows as Markdown lines, values with four decimals."""
    cells = [printed_float(F.col(c)) for c in columns]
    inner = F.concat_ws(
        " | ", "category", "model", *cells, F.col("avg_rank").cast("string")
    )
    return table.select(
        "avg_rank", "avg_rank_score", "model", F.concat(F.lit("| "), inner, F.lit(" |")).alias("line")
    )
