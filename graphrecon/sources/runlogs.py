"""Run logs and result files: step tables, stage logs, metric files, baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphrecon.functions.parsing import log_label, strip_blanks

# Strategies whose metric files make a complete report.
STRATEGIES = ("BFS", "DFS", "RANDOM_WALK")
LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (\w+) (.*)$"  # fixed value: log line format
RUN_PATH = r"([^/]+)/([^/]+)/([^/]+)/[^/]+$"


def union_steps(tables: Sequence[DataFrame]) -> DataFrame:
    """Step tables with different columns on top of each other; absent columns are NULL."""
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table, allowMissingColumns=True)
    return whole


def paths_by_header(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, list[str]]]:
    """CSV files by their first line, from one scan of all files; empty files are left out."""
    if not paths:
        return []
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("path"), place.alias("at"))
    heads = lines.groupBy("path").agg(F.min_by("value", "at").alias("head"))
    groups: dict[str, list[str]] = {}
    for row in heads.orderBy("path").collect():
        groups.setdefault(row["head"], []).append(row["path"])
    return sorted(groups.items())


def read_steps(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Step CSVs of many runs with ``model, stage, run_id`` taken from ``model/stage/run/file``.

    One read for each distinct header, however many files there are.
    """
    tables = []
    for _, group in paths_by_header(spark, paths):
        raw = spark.read.csv(group, header=True)
        where = F.col("_metadata.file_path")
        tables.append(
            raw.select(
                *[F.regexp_extract(where, RUN_PATH, i).alias(n) for i, n in
                  ((1, "model"), (2, "stage"), (3, "run_id"))],
                "*",
            )
        )
    return union_steps(tables)


def objective_history(steps: DataFrame, header: str, keys: Sequence[str], order: str) -> DataFrame:
    """``keys, order, value`` of one metric column, its case ignored and blanks left out."""
    by_lower = {c.lower(): c for c in steps.columns}
    if header.lower() not in by_lower:
        raise ValueError(f"no column {header!r} among {steps.columns}")
    value = strip_blanks(F.col(f"`{by_lower[header.lower()]}`").cast("string"))
    history = steps.select(*keys, order, value.alias("t")).filter(
        F.col("t").isNotNull() & (F.col("t") != "")
    ).select(*keys, order, F.col("t").cast("double").alias("value"))
    if history.isEmpty():
        raise ValueError(f"column {header!r} has no values")
    return history


def parse_stage_log(lines: DataFrame) -> DataFrame:
    """``ts, level, event, fields`` from lines ``value``; other columns stay, other lines drop."""
    rest = [c for c in lines.columns if c != "value"]
    cut = lines.select(
        *rest,
        *[F.regexp_extract("value", LOG_LINE, i).alias(n) for i, n in
          ((1, "ts"), (2, "level"), (3, "body"))],
    ).filter(F.col("ts") != "")
    parts = F.split("body", r" \| ")
    fields = F.map_from_entries(
        F.transform(
            F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda p: F.struct(
                F.substring_index(p, ": ", 1).alias("key"),
                F.regexp_replace(p, r"^.*?: ", "").alias("value"),
            ),
        )
    )
    return cut.select(
        *rest,
        F.to_timestamp("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        "level",
        F.get(parts, F.lit(0)).alias("event"),
        fields.alias("fields"),
    )


def latest_per_strategy(metric_files: DataFrame) -> DataFrame:
    """Newest payload per strategy of ``strategy, modified, payload``; nothing unless all are there.

    ``modified`` ties go to the first path, as a later file has to be newer to replace it.
    """
    known = metric_files.withColumn("strategy", F.upper("strategy")).filter(
        F.col("strategy").isin(*STRATEGIES)
    )
    newest = known.groupBy("strategy").agg(
        F.max_by("payload", "modified").alias("payload"), F.max("modified").alias("modified")
    )
    complete = newest.agg((F.count_distinct("strategy") == len(STRATEGIES)).alias("complete"))
    return newest.filter(complete.scalar()).select("strategy", "modified", "payload")


METRICS_SCHEMA = (
    "split_strategy string, summary struct<graph_count:bigint,graph_sim:double,relative_density:double,"
    "deg_dist_mmd:double,cc_mmd:double,laplacian_eigen_mmd:double>"
)


def read_latest_metrics(spark: SparkSession, root: str, name: str = "topology_metrics.json") -> DataFrame:
    files = spark.read.schema(METRICS_SCHEMA).json(f"{root}/*/{name}", multiLine=True)
    return latest_per_strategy(
        files.select(
            F.coalesce(F.col("split_strategy"), F.lit("")).alias("strategy"),
            F.col("_metadata.file_modification_time").alias("modified"),
            F.col("summary").alias("payload"),
        )
    )


BASELINE_SCHEMA = (
    "rows array<struct<category:string,model:string,metrics:map<string,struct<graph_sim:double,"
    "relative_density:double,deg_dist_mmd:double,cc_mmd:double,laplacian_eigen_mmd:double>>>>"
)


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """``category, model, strategy`` and the five metrics of a baseline JSON with a ``rows`` list."""
    whole = spark.read.schema(BASELINE_SCHEMA).json(path, multiLine=True)
    if whole.filter(F.col("rows").isNull()).limit(1).count():
        raise ValueError("the baseline file has no rows list")
    return explode_baselines(whole)


def explode_baselines(whole: DataFrame) -> DataFrame:
    return (
        whole.select(F.explode("rows").alias("r"))
        .select("r.category", "r.model", F.explode("r.metrics").alias("strategy", "m"))
        .select("category", "model", "strategy", "m.*")
    )


def labelled(token: str):
    """Spelling of an event or field name in the log."""
    return log_label(F.lit(token))
