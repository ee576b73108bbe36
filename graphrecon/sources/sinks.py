"""Writers. Rows keep their order across part files where the format needs it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphrecon.functions.parsing import printed_float
from graphrecon.functions.rows import beside
from graphrecon.operators.ranking import METRIC_COLUMNS, markdown_rows

# Column order of the result files.
TOPOLOGY_COLUMNS = (
    "scope",
    "node_size",
    "graph_count",
    "graph_sim",
    "relative_density",
    "deg_dist_mmd",
    "cc_mmd",
    "laplacian_eigen_mmd",
)
TRIAL_COLUMNS = ("trial_number", "state", "value", "run_id", "params_json")
REPORT_COLUMNS = ("category", "model", *METRIC_COLUMNS, "avg_rank", "avg_rank_score")
MARKDOWN_HEAD = (
    "| Category | Model | BFS GS | BFS RD | BFS Deg. | BFS Clus. | BFS Spectral | "
    "DFS GS | DFS RD | DFS Deg. | DFS Clus. | DFS Spectral | "
    "RW GS | RW RD | RW Deg. | RW Clus. | RW Spectral | Avg. Rank |"
)


def write_pairs(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated ``u, v, label``: positives first, then negatives, each sorted."""
    order = [F.desc("label"), F.col("u"), F.col("v")]
    ordered = rows.select("u", "v", "label").repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.mode(mode).csv(path, sep="\t")


def write_predictions(
    pairs: DataFrame, predictions: DataFrame, path: str, mode: str = "errorifexists"
) -> None:
    """Tab-separated ``a, b, 0/1`` in the order of ``pair_index``; every pair needs a prediction."""
    joined = pairs.join(predictions, "pair_index", "full")
    bad = joined.filter(F.col("pred").isNull() | F.col("a").isNull()).limit(1).count()
    if bad:
        raise ValueError("pairs and predictions do not match one to one")
    spread = joined.repartitionByRange("pair_index").sortWithinPartitions("pair_index")
    spread.select("a", "b", F.col("pred").cast("int")).write.mode(mode).csv(path, sep="\t")


def topology_table(per_size: DataFrame, summary: DataFrame) -> DataFrame:
    """Rows per size in order, then one summary row with the summed graph count."""
    sizes = per_size.select(
        F.lit("node_size").alias("scope"), F.col("node_size").cast("string"), *TOPOLOGY_COLUMNS[2:]
    )
    last = summary.select(
        F.lit("summary").alias("scope"), F.lit("all").alias("node_size"), *TOPOLOGY_COLUMNS[2:]
    )
    place = F.coalesce(F.expr("try_cast(node_size as int)"), F.lit(2**31 - 1))
    return sizes.unionByName(last).orderBy(place)


def write_topology_csv(per_size: DataFrame, summary: DataFrame, path: str) -> None:
    """A table of a few dozen rows: one file."""
    topology_table(per_size, summary).coalesce(1).write.mode("overwrite").csv(path, header=True)


def topology_json(
    details: DataFrame, per_size: DataFrame, summary: DataFrame, run: Mapping[str, object] | None = None
) -> DataFrame:
    """One JSON document: the run's own fields, summary, per-size values and details, sizes as text keys.

    ``run`` may hold ``model``, ``run_id``, ``species``, ``split_strategy`` and ``decision_threshold``. The
    details are lists of the samples' similarities and densities by size and each size's discrepancies;
    their number is that of the drawn samples, so the document is one row.
    """
    def packed(columns: Sequence[str]):
        return F.struct(*[F.col(c) for c in sorted(columns)])

    def keyed(value) -> Column:
        entry = F.struct(F.col("node_size").cast("string").alias("k"), value.alias("v"))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    metrics = [c for c in TOPOLOGY_COLUMNS[3:] if c in per_size.columns]
    sampled = [c for c in ("graph_sim", "relative_density") if c in details.columns]
    mmds = [c for c in metrics if c not in ("graph_sim", "relative_density")]
    sizes = per_size.agg(
        keyed(packed([*metrics, "graph_count"])).alias("per_node_size"), *[keyed(F.col(c)).alias(c) for c in mmds]
    )
    lists = details.groupBy("node_size").agg(
        *[
            F.array_sort(F.collect_list(F.struct("sample_id", F.col(c).alias("value")))).getField("value").alias(c)
            for c in sampled
        ]
    )
    per_sample = lists.agg(*[keyed(F.col(c)).alias(c) for c in sampled])
    whole = summary.select(packed([*metrics, "graph_count"]).alias("summary"))
    fields = dict(run or {})
    if fields.get("split_strategy"):
        fields["split_strategy"] = str(fields["split_strategy"]).upper()
    return beside(sizes, whole, per_sample).select(
        F.to_json(
            F.struct(
                *[F.lit(fields[k]).alias(k) for k in sorted(fields)],
                F.struct(*sampled, *mmds).alias("details"),
                "per_node_size",
                "summary",
            )
        ).alias("value")
    )


def write_topology_json(
    details: DataFrame,
    per_size: DataFrame,
    summary: DataFrame,
    path: str,
    run: Mapping[str, object] | None = None,
) -> None:
    topology_json(details, per_size, summary, run).coalesce(1).write.mode("overwrite").text(path)


def write_details(details: DataFrame, path: str, per_size: DataFrame | None = None) -> None:
    """Every sample's values, beside the discrepancies of its size where ``per_size`` has them."""
    if per_size is not None:
        details = details.join(per_size.drop("graph_count", "graph_sim", "relative_density"), "node_size", "left")
    details.write.mode("overwrite").parquet(path)


def write_report(table: DataFrame, folder: str, model: str) -> tuple[str, str]:
    """Comparison table as CSV and Markdown, one row per model, best first, in ordered part files."""
    spark = table.sparkSession
    csv_path, md_path = f"{folder}/comparison_{model}_csv", f"{folder}/comparison_{model}_md"
    order = ["avg_rank", "avg_rank_score", "model"]
    flat = table.select(*REPORT_COLUMNS).orderBy(*order)
    flat.write.mode("overwrite").csv(csv_path, header=True)
    rule = "| " + " | ".join(["---"] * (len(METRIC_COLUMNS) + 3)) + " |"
    head = spark.createDataFrame([(0, MARKDOWN_HEAD), (1, rule)], "at int, line string").select(
        "at", F.lit(0.0).alias("score"), F.lit("").alias("model"), "line"
    )
    body = markdown_rows(table).select(
        (F.col("avg_rank") + 1).cast("int").alias("at"),
        F.col("avg_rank_score").alias("score"),
        "model",
        "line",
    )
    lines = head.unionByName(body).orderBy("at", "score", "model").select("line")
    lines.write.mode("overwrite").text(md_path)
    return csv_path, md_path


def append_rows(rows: DataFrame, path: str, run_column: str = "run_id") -> None:
    """Append to a step table kept by run; new columns may appear in later runs."""
    rows.write.mode("append").partitionBy(run_column).parquet(path)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def trial_rows(trials: DataFrame) -> DataFrame:
    """Trial table for CSV: value with eight decimals or blank, parameters as sorted JSON."""
    shown = F.when(F.col("value").isNull(), "").otherwise(printed_float(F.col("value"), 8))
    params = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("params"))))
    return trials.select(
        "trial_number",
        "state",
        shown.alias("value"),
        F.coalesce("run_id", F.lit("")).alias("run_id"),
        params.alias("params_json"),
    )


def write_trials(trials: DataFrame, path: str) -> None:
    """The table in ordered part files."""
    rows = trial_rows(trials).orderBy("trial_number")
    rows.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def all_exist(spark: SparkSession, paths: Sequence[str]) -> bool:
    """Whether every path is there, on whatever file system it names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        found.append(place.getFileSystem(conf).exists(place))
    return all(found)


def ensure_splits(spark: SparkSession, outputs: Mapping[str, str], build) -> bool:
    """Write ``build()`` (rows ``split, u, v, label``) unless every split is there already.

    Returns whether anything was written.
    """
    if all_exist(spark, list(outputs.values())):
        return False
    rows = build()
    for split, path in outputs.items():
        write_pairs(rows.filter(F.col("split") == split), path, mode="overwrite")
    return True


def write_vectors(matrices: DataFrame, metadata: Mapping[str, object], path: str) -> None:
    """Vector table and its one-row metadata table; the committer makes each write whole."""
    matrices.write.mode("overwrite").parquet(f"{path}/vectors")
    spark = matrices.sparkSession
    rows = [(k, str(v)) for k, v in sorted(metadata.items())]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/metadata")


def read_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    meta = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/metadata").collect()}
    return spark.read.parquet(f"{path}/vectors"), meta
