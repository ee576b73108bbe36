"""Predicted against true graphs: overlap, density ratio, histograms and their discrepancy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrecon.functions.rows import beside
from graphrecon.session import task_slots

CLUSTERING_BINS = 100
SPECTRAL_BINS = 200
SPECTRAL_RANGE = (-1e-5, 2.0)  # fixed values: range of the eigenvalue histogram
EMPTY_SIDE = 1e6  # fixed value: discrepancy when a side has no sample
HISTOGRAM = "array<struct<bin:int,cnt:double>>"
#: Nodes of a graph up to which its dense matrix (8 bytes a cell) is solved in a task.
MOST_NODES = 4096


def edge_overlap(marked: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per group: weights of predicted, true and differing matrix cells, and edge counts.

    ``marked`` has a ``side`` column, ``true`` or ``pred``. An edge fills two cells of the
    adjacency matrix, a loop one. Each pair meets its counterpart by a group-by on the pair,
    which is the full outer comparison in one shuffle.
    """
    per_pair = marked.groupBy(*groups, "u", "v").agg(
        F.max((F.col("side") == "true").cast("int")).alias("t"),
        F.max((F.col("side") == "pred").cast("int")).alias("p"),
    )
    weight = F.when(F.col("u") == F.col("v"), 1).otherwise(2)
    return per_pair.groupBy(*groups).agg(
        F.sum(weight * F.col("t")).alias("true_cells"),
        F.sum(weight * F.col("p")).alias("pred_cells"),
        F.sum(weight * F.abs(F.col("t") - F.col("p"))).alias("diff_cells"),
        F.sum("t").alias("true_edges"),
        F.sum("p").alias("pred_edges"),
        F.sum(F.col("t") * F.col("p")).alias("shared_edges"),
    )


def graph_similarity(diff_cells: Column, true_cells: Column, pred_cells: Column) -> Column:
    """1 - |A - B| / (A + B) over matrix cells; two empty graphs are alike."""
    total = true_cells + pred_cells
    return F.when(total <= 0, 1.0).otherwise(1.0 - diff_cells / F.greatest(total, F.lit(1)))


def relative_density(pred_density: Column, true_density: Column) -> Column:
    return (
        F.when(true_density != 0, pred_density / F.when(true_density != 0, true_density))
        .when(pred_density != 0, F.lit(float("inf")))
        .otherwise(1.0)
    )


def degree_histogram(degree: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Number of nodes per degree, in long form ``(groups, bin, cnt)``."""
    return degree.groupBy(*groups, F.col("degree").cast("int").alias("bin")).agg(
        F.count(F.lit(1)).cast("double").alias("cnt")
    )


def clustering_bin(triangles: Column, degree: Column, bins: int = CLUSTERING_BINS) -> Column:
    """Equal bins over [0, 1], the last one closed.

    Bin i starts at the double ``i * (1 / bins)``; a coefficient next to such an edge is moved
    to the bin whose edges enclose it, as the usual histogram routine does.
    """
    slots = F.greatest(degree * (degree - 1), F.lit(1)).cast("double")
    value = (2 * triangles).cast("double") / slots
    step = F.lit(1.0 / bins)
    raw = F.least(F.floor(value * bins), F.lit(bins - 1))
    moved = (
        F.when(value < raw * step, raw - 1)
        .when((value >= (raw + 1) * step) & (raw < bins - 1), raw + 1)
        .otherwise(raw)
    )
    return F.when(degree < 2, 0).otherwise(moved).cast("int")


def clustering_histogram(coefficients: DataFrame, groups: Sequence[str]) -> DataFrame:
    return coefficients.groupBy(
        *groups, clustering_bin(F.col("triangles"), F.col("degree")).alias("bin")
    ).agg(F.count(F.lit(1)).cast("double").alias("cnt"))


def packed(histogram: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One row per histogram: an array of its filled bins (at most as many as there are bins)."""
    return histogram.groupBy(*groups).agg(
        F.collect_list(F.struct("bin", "cnt")).cast(HISTOGRAM).alias("hist")
    )


def _eigenvalues(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    a = np.zeros((n, n))
    a[u, v] = 1.0
    a[v, u] = 1.0
    degree = a.sum(axis=1)
    scale = np.where(degree > 0, 1.0 / np.sqrt(np.where(degree > 0, degree, 1.0)), 0.0)
    # rows without edges stay zero, on the diagonal too
    lap = (np.diag(degree) - a) * scale[:, None] * scale[None, :]
    try:
        return np.linalg.eigvalsh(lap)
    except np.linalg.LinAlgError:
        return np.zeros(n)


def _solved(nodes: DataFrame, edges: DataFrame, groups: Sequence[str], result, column: str) -> DataFrame:
    """``result`` of the eigenvalues of each small graph, one graph per row; larger ones than ``MOST_NODES`` raise."""
    groups = list(groups)
    sizes = nodes.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    fits = F.col("n") <= MOST_NODES
    message = F.format_string("a graph of %d nodes is too large for a dense spectrum; see laplacian_traces", F.col("n"))
    small = sizes.select(*groups, F.when(fits, F.col("n")).otherwise(F.raise_error(message)).alias("n"))
    node_rows = nodes.join(small, groups).groupBy(*groups, "n").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    edge_rows = edges.groupBy(*groups).agg(F.collect_list(F.struct("u", "v")).alias("es"))
    graphs = node_rows.join(edge_rows, groups, "left").select(
        *groups,
        F.size("ids").alias("n"),
        F.transform("es", lambda e: F.array_position("ids", e["u"]).cast("int") - 1).alias("us"),
        F.transform("es", lambda e: F.array_position("ids", e["v"]).cast("int") - 1).alias("vs"),
    )
    fields = [f for f in graphs.schema.fields if f.name in groups]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for n, us, vs in zip(batch["n"], batch["us"], batch["vs"]):
                u, v = (np.zeros(0, dtype=int) if x is None else np.asarray(x, dtype=int) for x in (us, vs))
                found.append(result(_eigenvalues(int(n), u, v)))
            yield batch[groups].assign(**{column.split()[0]: found})

    spread = graphs.repartition(task_slots(graphs.sparkSession))
    return spread.mapInPandas(solve, f"{schema}, {column}")


def spectral_histogram(
    nodes: DataFrame, edges: DataFrame, groups: Sequence[str], first_k: int = -1
) -> DataFrame:
    """Packed histogram of normalised-Laplacian eigenvalues, one small graph per row.

    Counts are divided by their sum, as far as that is above 1. A graph above ``MOST_NODES`` nodes is an error.
    """

    def counted(values: np.ndarray) -> list[dict]:
        some = values[1 : first_k + 1] if first_k > 0 else values
        counts = np.histogram(some, bins=SPECTRAL_BINS, range=SPECTRAL_RANGE)[0]
        total = max(1.0, float(counts.sum()))
        return [{"bin": int(b), "cnt": counts[b] / total} for b in np.flatnonzero(counts)]

    return _solved(nodes, edges, groups, counted, f"hist {HISTOGRAM}")


def spectra(nodes: DataFrame, edges: DataFrame, groups: Sequence[str]) -> DataFrame:
    """All normalised-Laplacian eigenvalues of each small graph, ascending, as ``eigenvalues``."""
    return _solved(nodes, edges, groups, lambda values: values.tolist(), "eigenvalues array<double>")


def laplacian_traces(nodes: DataFrame, edges: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Traces of the normalised Laplacian and of its square: the sums of its eigenvalues and of their squares.

    By products over the edges, for graphs of any size: a diagonal cell is 1 - loop / d, any other -1 / sqrt(d d').
    """
    groups = list(groups)
    cells = edges.select(
        *groups,
        F.explode(
            F.array_distinct(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("other")), F.struct(F.col("v").alias("id"), F.col("u").alias("other"))))
        ).alias("c"),
    ).select(*groups, "c.*").distinct()
    degree = cells.groupBy(*groups, "id").agg(
        F.count(F.lit(1)).cast("double").alias("d"), F.max((F.col("id") == F.col("other")).cast("double")).alias("loop")
    )
    other = degree.select(*groups, F.col("id").alias("other"), F.col("d").alias("e"))
    crossed = cells.filter(F.col("id") != F.col("other")).join(degree, [*groups, "id"]).join(other, [*groups, "other"])
    off = crossed.groupBy(*groups).agg(F.sum(1.0 / (F.col("d") * F.col("e"))).alias("off"))
    diagonal = 1.0 - F.col("loop") / F.col("d")
    on = degree.groupBy(*groups).agg(F.sum(diagonal).alias("trace"), F.sum(diagonal * diagonal).alias("squares"))
    if not groups:
        return beside(on, off).select("trace", (F.col("squares") + F.coalesce("off", F.lit(0.0))).alias("trace_squared"))
    every = nodes.select(*groups).distinct().join(on, groups, "left").join(off, groups, "left").fillna(0.0)
    return every.select(*groups, "trace", (F.col("squares") + F.col("off")).alias("trace_squared"))


def gaussian_tv(x: Column, y: Column, sigma: float = 1.0) -> Column:
    """Gaussian kernel of the total variation between two dense arrays, short ones zero-padded."""
    gaps = F.zip_with(
        x, y, lambda a, b: F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)))
    )
    tv = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g) / 2.0
    return F.exp(-(tv * tv) / (2.0 * sigma * sigma))


def _dense(hists: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(hists), width))
    items = [item for hist in hists for item in hist]
    if items:
        rows = np.repeat(np.arange(len(hists)), [len(h) for h in hists])
        np.add.at(out, (rows, [i["bin"] for i in items]), [i["cnt"] for i in items])
    return out / (out.sum(axis=1, keepdims=True) + 1e-6)


def _kernel_total(left: np.ndarray, right: np.ndarray, sigma: float) -> float:
    """Sum of the kernel over all pairs. Half the distance of two rows is their mean sum less what they share."""
    columns, total = np.ascontiguousarray(right.T), 0.0
    halves = right.sum(axis=1) / 2.0
    for row in left:
        some = np.flatnonzero(row)
        tv = row.sum() / 2.0 + halves - np.minimum(columns[some], row[some, None]).sum(axis=0)
        total += float(np.exp(-(tv * tv) / (2.0 * sigma * sigma)).sum())
    return total


def _block_pairs(packed_hists: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame:
    """Blocks of histograms, a row each, once for every pair of blocks ``__i <= __j`` of its key that it is in."""
    counts = packed_hists.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("__blocks")
    )
    dealt = packed_hists.join(counts, keys).withColumn(
        "__block", F.pmod(F.xxhash64("side", "sample_id"), F.col("__blocks")).cast("int")
    )
    blocks = dealt.groupBy(*keys, "__blocks", "__block").agg(
        F.collect_list(F.struct("side", "hist")).alias("hists")
    )
    cells = blocks.select(
        *keys,
        "hists",
        "__block",
        F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__other"),
    )
    return cells.withColumn("__i", F.least("__block", "__other")).withColumn("__j", F.greatest("__block", "__other")).drop("__other")


def kernel_sums(
    packed_hists: DataFrame, keys: Sequence[str], sigma: float = 1.0, block_rows: int = 4096
) -> DataFrame:
    """Sum and number of kernel values per (keys, side_a, side_b), over all ordered pairs.

    The histograms of a key are packed into blocks of about ``block_rows``; a task gets one pair
    of blocks and returns one partial sum per pair of sides. No pair of samples becomes a row, a block
    moves once for each other block, and a key with very many samples is spread over many tasks.
    """
    keys = list(keys)
    fields = {f.name: f.dataType.simpleString() for f in packed_hists.schema.fields}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys)

    def block_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i, j = key[-2], key[-1]
        width = 1 + max((item["bin"] for hists in rows["hists"] for x in hists for item in x["hist"]), default=0)
        blocks = {}
        for _, block in rows.iterrows():
            dense = _dense(pd.Series([x["hist"] for x in block["hists"]]), width)
            sides = np.array([x["side"] for x in block["hists"]])
            blocks[block["__block"]] = {a: dense[sides == a] for a in sorted(set(sides))}
        found = []
        for a, left in blocks.get(i, {}).items():
            for b, right in blocks.get(j, {}).items():
                total, n = _kernel_total(left, right, sigma), len(left) * len(right)
                found.append((*key[:-2], a, b, total, n))
                if i != j:  # the mirrored block pair is not dealt
                    found.append((*key[:-2], b, a, total, n))
        return pd.DataFrame(found, columns=[*keys, "side_a", "side_b", "total", "pairs"])

    cells = _block_pairs(packed_hists, keys, block_rows)
    spread = cells.repartition(task_slots(cells.sparkSession), *keys, "__i", "__j")
    parts = spread.groupBy(*keys, "__i", "__j").applyInPandas(
        block_sums, f"{schema}, side_a string, side_b string, total double, pairs bigint"
    )
    return parts.groupBy(*keys, "side_a", "side_b").agg(
        F.sum("total").alias("total"), F.sum("pairs").alias("pairs")
    )


def mmd(sums: DataFrame, keys: Sequence[str], a: str = "true", b: str = "pred") -> DataFrame:
    """Discrepancy within a, plus within b, minus twice across; an absent side counts 1e6."""

    def mean(x: str, y: str) -> Column:
        here = (F.col("side_a") == x) & (F.col("side_b") == y)
        return F.coalesce(
            F.sum(F.when(here, F.col("total"))) / F.sum(F.when(here, F.col("pairs"))),
            F.lit(EMPTY_SIDE),
        )

    return sums.groupBy(*keys).agg((mean(a, a) + mean(b, b) - 2.0 * mean(a, b)).alias("mmd"))
