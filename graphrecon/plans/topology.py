"""Judge a reconstructed graph against the true one on many node samples at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrecon.functions.rows import beside
from graphrecon.operators import compare as C
from graphrecon.operators import graph as G
from graphrecon.session import materialize

KEYS = ("node_size", "sample_id")
MMD_NAMES = {
    "degree": "deg_dist_mmd",
    "clustering": "cc_mmd",
    "spectral": "laplacian_eigen_mmd",
}


@dataclass(frozen=True)
class TopologyResult:
    details: DataFrame  # node_size, sample_id, graph_sim, relative_density
    per_size: DataFrame  # node_size, graph_count, and the five means
    summary: DataFrame  # one row


def sample_graphs(
    samples: DataFrame, true_edges: DataFrame, pred_edges: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Edges of both graphs inside each sample, told apart by ``side``, in one pass."""
    both = true_edges.select("u", "v", F.lit("true").alias("side")).unionByName(
        pred_edges.select("u", "v", F.lit("pred").alias("side"))
    )
    return G.induced_edges(samples, both, keys, extra=["side"])


def sample_nodes(
    samples: DataFrame, true_nodes: DataFrame, pred_nodes: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Nodes of each sample with whether each graph has them (1 or 0)."""
    members = samples.select(*keys, "id").distinct()
    t = true_nodes.select("id", F.lit(1).alias("in_true"))
    p = pred_nodes.select("id", F.lit(1).alias("in_pred"))
    return (
        members.join(t, "id", "left").join(p, "id", "left").fillna(0, ["in_true", "in_pred"])
    )


def require_same_nodes(nodes: DataFrame, keys: Sequence[str] = KEYS) -> None:
    """Raise when a sample's prediction, given the nodes it lacks, has nodes that the truth has not."""
    row = nodes.filter("in_pred > in_true").select(*keys, "id").limit(1).collect()
    if row:
        raise ValueError(f"predicted and true graph differ in nodes: {row[0].asDict()}")


def overlap_details(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Similarity and relative density per sample.

    The prediction gets the missing nodes of a sample only if the truth has strictly more there.
    """
    keys = list(keys)
    counts = nodes.groupBy(*keys).agg(
        F.sum("in_true").alias("n_true"), F.sum("in_pred").alias("n_found")
    )
    cells = C.edge_overlap(edges, keys)
    rows = counts.join(cells, keys, "left").fillna(0)
    n_pred = F.greatest("n_true", "n_found")
    return rows.select(
        *keys,
        C.graph_similarity(F.col("diff_cells"), F.col("true_cells"), F.col("pred_cells")).alias(
            "graph_sim"
        ),
        C.relative_density(
            G.density(n_pred, F.col("pred_edges")), G.density(F.col("n_true"), F.col("true_edges"))
        ).alias("relative_density"),
        "n_true",
        n_pred.alias("n_pred"),
        "true_edges",
        "pred_edges",
        "shared_edges",
    )


def side_nodes(nodes: DataFrame, padded: bool, keys: Sequence[str] = KEYS) -> DataFrame:
    """Node rows per side. ``padded`` gives the prediction the sample's true nodes too."""
    found = F.col("in_pred") == 1
    pred = nodes.filter(found | (F.col("in_true") == 1)) if padded else nodes.filter(found)
    true = nodes.filter(F.col("in_true") == 1)
    return true.select(F.lit("true").alias("side"), *keys, "id").unionByName(
        pred.select(F.lit("pred").alias("side"), *keys, "id")
    )


def histograms(
    nodes: DataFrame, edges: DataFrame, spectral: bool = True, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Packed histograms ``metric, node_size, side, sample_id, hist`` of all samples.

    Degree counts use the completed prediction, clustering and spectrum the plain one; an empty
    predicted graph has no clustering histogram.
    """
    groups = ["side", *keys]
    degree = G.degrees(edges, side_nodes(nodes, True, keys), groups)
    local = G.local_clustering(side_nodes(nodes, False, keys), edges, groups)
    parts = [
        C.packed(C.degree_histogram(degree, groups), groups).withColumn("metric", F.lit("degree")),
        C.packed(C.clustering_histogram(local, groups), groups).withColumn(
            "metric", F.lit("clustering")
        ),
    ]
    if spectral:
        # every sample has a row here: an empty predicted graph is a histogram of zeros
        solved = C.spectral_histogram(side_nodes(nodes, False, keys), edges, groups)
        every = nodes.select(*keys).distinct().select(
            F.explode(F.array(F.lit("true"), F.lit("pred"))).alias("side"), *keys
        )
        empty = F.array().cast(C.HISTOGRAM)
        whole = every.join(solved, groups, "left").withColumn("hist", F.coalesce("hist", empty))
        parts.append(whole.withColumn("metric", F.lit("spectral")))
    columns = ["metric", "node_size", "side", "sample_id", "hist"]
    union = parts[0].select(*columns)
    for part in parts[1:]:
        union = union.unionByName(part.select(*columns))
    return union


def roll_up(details: DataFrame, mmds: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Per-size rows and the summary row.

    Similarity and density are averaged over all samples, discrepancies over the sizes.
    """
    means = [
        F.count(F.lit(1)).alias("graph_count"),
        F.avg("graph_sim").alias("graph_sim"),
        F.avg("relative_density").alias("relative_density"),
    ]
    per_size = details.groupBy("node_size").agg(*means)
    summary = details.agg(*means).select(
        "graph_count",
        F.coalesce("graph_sim", F.lit(0.0)).alias("graph_sim"),
        F.coalesce("relative_density", F.lit(0.0)).alias("relative_density"),
    )
    if mmds is None:
        return per_size, summary
    names = list(MMD_NAMES.items())
    wide = mmds.groupBy("node_size").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("mmd"))).alias(c) for m, c in names]
    )
    over_sizes = mmds.agg(
        *[F.coalesce(F.avg(F.when(F.col("metric") == m, F.col("mmd"))), F.lit(0.0)).alias(c) for m, c in names]
    )
    return per_size.join(wide, "node_size"), beside(summary, over_sizes)


def require_distinct_sizes(parts: Sequence[DataFrame]) -> DataFrame:
    """Results of several runs over different sizes, put together; a size given twice is an error."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    twice = (
        whole.select("node_size", "source")
        .distinct()
        .groupBy("node_size")
        .count()
        .filter("count > 1")
        .orderBy("node_size")
        .first()
    )
    if twice:
        raise ValueError(f"node size {twice['node_size']} was evaluated twice")
    return whole


def merge_results(results: Sequence[TopologyResult]) -> TopologyResult:
    """One result from runs over disjoint sizes; the summary is computed anew from both levels."""
    def tagged(name: str) -> DataFrame:
        tables = [
            getattr(r, name).withColumn("source", F.lit(i)) for i, r in enumerate(results)
        ]
        return require_distinct_sizes(tables).drop("source")

    details, per_size = tagged("details"), tagged("per_size")
    names = [c for c in MMD_NAMES.values() if c in per_size.columns]
    mmds = per_size.unpivot(["node_size"], names, "name", "mmd") if names else None
    if mmds is not None:
        back = {v: k for k, v in MMD_NAMES.items()}
        metric = F.coalesce(*[F.when(F.col("name") == v, F.lit(back[v])) for v in names])
        mmds = mmds.select("node_size", metric.alias("metric"), "mmd").filter("mmd is not null")
    _, summary = roll_up(details, mmds)
    return TopologyResult(details, per_size, summary)


def evaluate_graph(
    true_nodes: DataFrame,
    true_edges: DataFrame,
    pred_edges: DataFrame,
    samples: DataFrame,
    mmd: bool = True,
    spectral: bool = True,
    node_policy: str = "reference",
    pred_nodes: DataFrame | None = None,
) -> TopologyResult:
    """Compare a predicted with a true graph on ``samples(node_size, sample_id, pos, id)``.

    The big edge tables are read once: what lies inside the samples is written down and all
    metrics work on that.
    """
    found = G.endpoints(pred_edges) if pred_nodes is None else pred_nodes
    completed = G.add_missing_nodes(found, true_nodes, node_policy)
    edges = materialize(sample_graphs(samples, true_edges, pred_edges))
    nodes = materialize(sample_nodes(samples, true_nodes, completed))
    require_same_nodes(nodes)
    details = overlap_details(nodes, edges)
    mmds = None
    if mmd:
        sums = C.kernel_sums(histograms(nodes, edges, spectral), ["metric", "node_size"])
        mmds = materialize(C.mmd(sums, ["metric", "node_size"]))
    per_size, summary = roll_up(details, mmds)
    return TopologyResult(details, per_size, summary)
