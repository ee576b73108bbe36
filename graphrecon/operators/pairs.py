"""Work on pair tables: membership, labels, enumeration inside samples, shard merging."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrecon.functions.rows import beside
from graphrecon.operators.prefix import global_index
from graphrecon.session import task_slots


def inside_split(pairs: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs with both ends in the split."""
    ids = nodes.select("id").distinct()
    kept = pairs.join(ids.withColumnRenamed("id", a), a, "left_semi").join(
        ids.withColumnRenamed("id", b), b, "left_semi"
    )
    return kept.select(*pairs.columns)


def difference(edges: DataFrame, other: DataFrame) -> DataFrame:
    """Edges ``u, v`` of the first table that the second one lacks."""
    return edges.select("u", "v").join(other.select("u", "v"), ["u", "v"], "left_anti")


def without(candidates: DataFrame, *forbidden: DataFrame) -> DataFrame:
    """Canonical candidates ``u, v`` that occur in none of the forbidden pair tables."""
    for table in forbidden:
        candidates = candidates.join(table.select("u", "v"), ["u", "v"], "left_anti")
    return candidates


def label_by_edges(pairs: DataFrame, edges: DataFrame, name: str = "label") -> DataFrame:
    """Add 1 or 0: whether the canonical pair ``u, v`` is an edge."""
    known = edges.select("u", "v", F.lit(1).alias("__known"))
    return pairs.join(known, ["u", "v"], "left").select(
        *pairs.columns, F.coalesce("__known", F.lit(0)).alias(name)
    )


def pairs_in_samples(
    samples: DataFrame, keys: Sequence[str] = ("node_size", "sample_id")
) -> DataFrame:
    """Every pair of positions of each sample: ``keys, pos_a, pos_b, a, b``.

    A sample is bounded by its node size, and samples are spread by their keys.
    """
    keys = list(keys)
    left = samples.select(*keys, F.col("pos").alias("pos_a"), F.col("id").alias("a"))
    right = samples.select(*keys, F.col("pos").alias("pos_b"), F.col("id").alias("b"))
    return left.join(right, keys).filter(F.col("pos_a") < F.col("pos_b"))


def pair_blocks(rows: DataFrame, id_col: str, block_rows: int, parts_per_slot: int = 1) -> DataFrame:
    """Deal rows into blocks of at most about ``block_rows`` and repeat them per pair of blocks.

    Adds ``__block`` and the cell ``__i <= __j`` it meets. Rows of a cell are at most two
    blocks, however many rows the table has; a small table gets smaller blocks, so that there
    are cells for all tasks. ``parts_per_slot`` parts of cells share a task slot, as far as there are cells for them.
    """
    slots = task_slots(rows.sparkSession)
    blocks = max(math.ceil(rows.count() / block_rows), math.ceil(math.sqrt(4 * slots)))
    dealt = rows.withColumn(
        "__block", F.pmod(F.xxhash64(F.col(id_col)), F.lit(blocks)).cast("int")
    ).withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = dealt.withColumn("__i", F.least("__block", "__other")).withColumn(
        "__j", F.greatest("__block", "__other")
    )
    # a fixed width: the work of a cell is quadratic, so small cells must not be put together
    parts = min(parts_per_slot * slots, max(slots, blocks * (blocks + 1) // 2))
    return cells.drop("__other").repartition(parts, "__i", "__j")


def enumerate_pairs(
    nodes: DataFrame, include_self: bool = False, block_rows: int = 512
) -> DataFrame:
    """All unordered pairs of a node table as ``u < v`` (``u <= v`` with self pairs), by blocks."""
    dealt = pair_blocks(nodes.select("id").distinct(), "id", block_rows)
    left = dealt.filter(F.col("__block") == F.col("__i")).select(
        "__i", "__j", F.col("id").alias("a")
    )
    right = dealt.filter(F.col("__block") == F.col("__j")).select(
        "__i", "__j", F.col("id").alias("b")
    )
    ordered = F.col("a") <= F.col("b") if include_self else F.col("a") < F.col("b")
    met = left.join(right, ["__i", "__j"]).filter((F.col("__i") < F.col("__j")) | ordered)
    return met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def shard_faults(shards: DataFrame, total: int) -> DataFrame:
    """One row: rows out of bounds, indexes given twice or more, indexes missing."""
    per_index = shards.groupBy("pair_index").agg(F.count(F.lit(1)).alias("n"))
    inside = F.col("pair_index").between(0, total - 1)
    return per_index.agg(
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("out_of_bounds"),
        F.coalesce(F.sum((inside & (F.col("n") > 1)).cast("bigint")), F.lit(0)).alias("duplicates"),
        (F.lit(total) - F.coalesce(F.sum(inside.cast("bigint")), F.lit(0))).alias("missing"),
    )


def merge_shards(shards: DataFrame, total: int) -> DataFrame:
    """Predictions of all shards with every index 0 .. total-1 exactly once, or an error."""
    faults = shard_faults(shards, total).first()
    if faults["out_of_bounds"]:
        raise ValueError(f"{faults['out_of_bounds']} shard rows are out of bounds")
    if faults["duplicates"]:
        raise ValueError(f"{faults['duplicates']} pair indexes were predicted twice")
    if faults["missing"]:
        wanted = shards.sparkSession.range(total).withColumnRenamed("id", "pair_index")
        gap = wanted.join(shards, "pair_index", "left_anti").orderBy("pair_index").limit(10)
        shown = ", ".join(str(r["pair_index"]) for r in gap.collect())
        raise ValueError(f"{faults['missing']} pair indexes have no prediction: {shown}")
    return shards.select("pair_index", "pred")


def subgraph_pairs(
    samples: DataFrame,
    edges: DataFrame,
    positives: DataFrame | None = None,
    negatives: DataFrame | None = None,
    keys: Sequence[str] = ("sample_id",),
) -> DataFrame:
    """Pairs of each sample with topology label, loss label and loss mask.

    ``positives`` and ``negatives`` are the pairs assigned per sample (``keys, u, v``). Without
    any assignment each pair is supervised by its topology label; with one, only assigned pairs are.
    """
    keys = list(keys)
    pairs = (
        pairs_in_samples(samples, keys)
        .withColumn("u", F.least("a", "b"))
        .withColumn("v", F.greatest("a", "b"))
    )
    rows = label_by_edges(pairs, edges, "topo_label")
    assigned = positives is not None or negatives is not None
    for table, name in ((positives, "__p"), (negatives, "__n")):
        if table is None:
            rows = rows.withColumn(name, F.lit(0))
        else:
            mark = table.select(*keys, "u", "v", F.lit(1).alias(name)).distinct()
            rows = rows.join(mark, [*keys, "u", "v"], "left").fillna(0, [name])
    if assigned:
        label, mask = F.col("__p"), F.greatest("__p", "__n")
    else:
        label, mask = F.col("topo_label"), F.lit(1)
    return rows.select(
        *keys,
        "pos_a",
        "pos_b",
        "a",
        "b",
        F.col("topo_label").cast("double").alias("topo_label"),
        label.cast("double").alias("bce_label"),
        mask.cast("double").alias("bce_mask"),
    )


def supervised_pairs(
    positives: DataFrame, negatives: DataFrame, chunk_size: int | None = None
) -> DataFrame:
    """Unique positive pairs, then unique negative pairs, each sorted; optionally with chunks."""
    rows = (
        positives.select("u", "v")
        .distinct()
        .withColumn("label", F.lit(1))
        .unionByName(negatives.select("u", "v").distinct().withColumn("label", F.lit(0)))
    )
    if chunk_size is None:
        return rows
    return with_chunks(rows, [F.desc("label"), "u", "v"], chunk_size)


def with_chunks(rows: DataFrame, order_by: Sequence, size: int) -> DataFrame:
    """Number the rows in order and cut them into chunks of ``size``."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    placed = global_index(rows, order_by, "row_index")
    return placed.withColumn("chunk", F.floor(F.col("row_index") / size))


def sets_differ(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are only on the left, and only on the right."""
    tall = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    marks = tall.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return marks.agg(
        F.coalesce(F.sum(((F.col("l") == 1) & (F.col("r") == 0)).cast("bigint")), F.lit(0)).alias(
            "only_left"
        ),
        F.coalesce(F.sum(((F.col("l") == 0) & (F.col("r") == 1)).cast("bigint")), F.lit(0)).alias(
            "only_right"
        ),
    )


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)
    )


def validation_plan_totals(
    samples: DataFrame, keys: Sequence[str] = ("node_size", "sample_id")
) -> DataFrame:
    """Subgraphs, pairs and distinct ids of a set of samples (pairs are counted, not made)."""
    per_sample = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    totals = per_sample.agg(
        F.count(F.lit(1)).alias("subgraphs"),
        F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("bigint")), F.lit(0)).alias(
            "pairs"
        ),
    )
    return beside(totals, samples.agg(F.count_distinct("id").alias("ids")))
