"""Batch plans over labelled rows: fixed ratio, warm-up without replacement, mining pools."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrecon.functions.keys import order_key
from graphrecon.operators.prefix import random_rank
from graphrecon.session import materialize


def per_batch_counts(batch_size: int, ratio: float) -> tuple[int, int]:
    """Positives and negatives of a full batch."""
    if batch_size <= 0 or ratio <= 0:
        raise ValueError("batch_size and ratio must be positive")
    positives = max(1, math.floor(batch_size / (1.0 + ratio)))
    return positives, max(0, round(positives * ratio))


def negatives_for(positives: int, full: int, full_negatives: int, ratio: float) -> int:
    """Negatives that go with a batch of so many positives; short batches round up."""
    if positives <= 0:
        return 0
    return full_negatives if positives == full else max(0, math.ceil(positives * ratio))


def label_facts(rows: DataFrame) -> DataFrame:
    """One row: positives, negatives, and labels that are neither (NULL included)."""
    def count(hit) -> Column:
        return F.coalesce(F.sum(hit.cast("bigint")), F.lit(0))

    label = F.col("label")
    return rows.agg(
        count(label == 1).alias("positives"),
        count(label == 0).alias("negatives"),
        count(label.isNull() | ~label.isin(0, 1)).alias("other"),
    )


def _ranked(rows: DataFrame, seed: int, epoch: int) -> tuple[DataFrame, int, int]:
    """Rows with a random rank inside their class, and both class sizes."""
    facts = label_facts(rows).first()
    if facts["other"]:
        raise ValueError("labels must be 0 or 1")
    if not facts["positives"] or not facts["negatives"]:
        raise ValueError("at least one positive and one negative row are needed")
    pos, neg = int(facts["positives"]), int(facts["negatives"])
    keyed = rows.select(
        "row_id", "label", order_key(seed + epoch, "batch", F.col("label"), F.col("row_id")).alias("key")
    )
    ranked = random_rank(keyed, "key", ["row_id"], groups=["label"]).drop("key")
    return materialize(ranked), pos, neg


def ratio_batches(
    rows: DataFrame,
    batch_size: int,
    ratio: float = 3.0,
    drop_last: bool = False,
    seed: int = 0,
    epoch: int = 0,
) -> DataFrame:
    """Each positive once, negatives drawn with replacement: ``batch, row_id, label``."""
    ranked, pos, neg = _ranked(rows, seed, epoch)
    size, full_neg = per_batch_counts(batch_size, ratio)
    batches, rest = divmod(pos, size)
    tail = 0 if drop_last else negatives_for(rest, size, full_neg, ratio)
    positives = ranked.filter("label = 1").select(
        F.floor(F.col("rank") / size).cast("bigint").alias("batch"), "row_id", "label"
    )
    if drop_last:
        positives = positives.filter(F.col("batch") < batches)
    slots = rows.sparkSession.range(batches * full_neg + tail).select(
        F.least(F.floor(F.col("id") / max(1, full_neg)), F.lit(batches)).cast("bigint").alias("batch"),
        F.pmod(F.xxhash64(F.lit(seed + epoch), F.lit("negative"), "id"), F.lit(neg)).alias("rank"),
    )
    negatives = slots.join(ranked.filter("label = 0"), "rank").select("batch", "row_id", "label")
    return positives.unionByName(negatives)


def warmup_batches(
    rows: DataFrame,
    batch_size: int,
    ratio: float = 7.0,
    drop_last: bool = False,
    seed: int = 0,
    epoch: int = 0,
) -> DataFrame:
    """Each positive and each used negative once; ends before the negatives run out."""
    ranked, pos, neg = _ranked(rows, seed, epoch)
    size, full_neg = per_batch_counts(batch_size, ratio)
    batches, rest = divmod(pos, size)
    fit = batches if full_neg == 0 else min(batches, neg // full_neg)
    tail = 0
    if fit == batches and rest and not drop_last:
        wanted = negatives_for(rest, size, full_neg, ratio)
        tail = wanted if batches * full_neg + wanted <= neg else -1
    last = fit if (tail == -1 or fit < batches or not rest or drop_last) else fit + 1
    positives = ranked.filter("label = 1").select(
        F.floor(F.col("rank") / size).cast("bigint").alias("batch"), "row_id", "label"
    )
    used = fit * full_neg + max(0, tail)
    negatives = ranked.filter((F.col("label") == 0) & (F.col("rank") < used)).select(
        F.least(F.floor(F.col("rank") / max(1, full_neg)), F.lit(fit)).cast("bigint").alias("batch"),
        "row_id",
        "label",
    )
    return positives.filter(F.col("batch") < last).unionByName(negatives)


def pool_counts(pos: int, neg: int, pool_size: int) -> tuple[int, int]:
    """Positives and negatives per mining pool, in the natural ratio of the classes.

    A pool can only come out short when it holds all negatives; positives then fill it, if there
    are enough of them.
    """
    in_pos = min(round(pool_size * pos / (pos + neg)), pos)
    in_neg = min(pool_size - in_pos, neg)
    short = pool_size - in_pos - in_neg
    return (in_pos + short if short <= pos - in_pos else in_pos), in_neg


def mining_pools(
    rows: DataFrame, batch_size: int, multiplier: int = 16, seed: int = 0, epoch: int = 0
) -> DataFrame:
    """Disjoint candidate pools of ``multiplier * batch_size`` rows: ``pool, row_id, label``."""
    if batch_size <= 0 or multiplier <= 0:
        raise ValueError("batch_size and multiplier must be positive")
    ranked, pos, neg = _ranked(rows, seed, epoch)
    in_pos, in_neg = pool_counts(pos, neg, batch_size * multiplier)
    limits = [n // k for n, k in ((pos, in_pos), (neg, in_neg)) if k]
    pools = min(limits) if limits else 0
    per_class = F.when(F.col("label") == 1, F.lit(in_pos)).otherwise(F.lit(in_neg))
    return (
        ranked.filter(F.col("rank") < per_class * pools)
        .select(F.floor(F.col("rank") / per_class).cast("bigint").alias("pool"), "row_id", "label")
    )
