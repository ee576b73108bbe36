"""Hard-example choice inside bounded pools."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphrecon.session import task_slots


def hardest(
    losses: DataFrame, keep_ratio: float = 0.5, min_keep: int = 1, pool: str = "pool"
) -> DataFrame:
    """The ceil(n * ratio) rows of highest loss per pool (at least ``min_keep``)."""
    if not 0.0 < keep_ratio <= 1.0:
        raise ValueError("keep_ratio must lie in (0, 1]")
    if min_keep <= 0:
        raise ValueError("min_keep must be positive")
    everyone = Window.partitionBy(pool)
    hard_first = everyone.orderBy(F.desc("loss"), "row_id")
    keep = F.greatest(F.lit(min_keep), F.ceil(F.count(F.lit(1)).over(everyone) * keep_ratio))
    return (
        losses.withColumn("place", F.row_number().over(hard_first))
        .withColumn("__keep", keep)
        .filter(F.col("place") <= F.col("__keep"))
        .drop("__keep")
    )


def hardest_capped(
    losses: DataFrame, keep: int, cap: int, pool: str = "pool"
) -> DataFrame:
    """Per pool, the hardest ``keep`` rows in which no id occurs over ``cap`` times.

    Taken greedily from the highest loss down; a pair of an id with itself counts twice. When
    too few pass, the passed-over rows fill up in the same order (``filled``). The greedy choice needs one
    pool at a time; a pool is a few hundred rows, and pools are spread over the tasks.
    """
    if keep <= 0 or cap <= 0:
        raise ValueError("keep and cap must be positive")
    fields = {f.name: f.dataType.simpleString() for f in losses.schema.fields}
    schema = f"{pool} {fields[pool]}, row_id {fields['row_id']}, place int, filled boolean"

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["loss", "row_id"], ascending=[False, True], kind="stable")
        used: Counter = Counter()
        taken, passed = [], []
        for row_id, a, b in zip(rows["row_id"], rows["a"], rows["b"]):
            if len(taken) == keep:
                break
            load = Counter((a, b))
            if any(used[x] + n > cap for x, n in load.items()):
                passed.append(row_id)
            else:
                used.update(load)
                taken.append(row_id)
        chosen = (taken + passed)[: min(keep, len(rows))]
        return pd.DataFrame(
            {
                pool: rows[pool].iloc[0],
                "row_id": chosen,
                "place": range(1, len(chosen) + 1),
                "filled": [i >= len(taken) for i in range(len(chosen))],
            }
        )

    rows = losses.select(pool, "row_id", "loss", "a", "b")
    spread = rows.repartition(task_slots(rows.sparkSession), pool)
    return spread.groupBy(pool).applyInPandas(choose, schema)


def hard_examples(
    losses: DataFrame, keep: int, cap: int, epoch: int = 0, warmup_epochs: int = 0, pool: str = "pool"
) -> DataFrame:
    """The rows of an epoch's pools that are trained on: ``pool, row_id, place``.

    In the first ``warmup_epochs`` epochs all rows, in their order. Later the hardest ``keep``: under the ``cap`` where
    ``losses`` has the ids ``a, b``, by loss alone where it has not.
    """
    if warmup_epochs < 0:
        raise ValueError("warmup_epochs must not be negative")
    if keep <= 0 or cap <= 0:
        raise ValueError("keep and cap must be positive")
    if epoch >= warmup_epochs and {"a", "b"} <= set(losses.columns):
        return hardest_capped(losses, keep, cap, pool).drop("filled")
    rows = Window.partitionBy(pool)
    order = rows.orderBy("row_id") if epoch < warmup_epochs else rows.orderBy(F.desc("loss"), "row_id")
    placed = losses.select(pool, "row_id", F.row_number().over(order).alias("place"))
    return placed if epoch < warmup_epochs else placed.filter(F.col("place") <= keep)
