"""Metric series per run: best so far, early stop, smoothing, best epoch, trials.

A series holds one value per epoch; runs spread over tasks, and the smoothed mean takes runs of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphrecon.operators.prefix import in_order


def early_stopping(
    series: DataFrame,
    patience: int,
    mode: str = "max",
    run: str = "run",
    epoch: str = "epoch",
    value: str = "value",
) -> DataFrame:
    """Per epoch: strict improvement, best so far, epochs without improvement, whether to stop."""
    if mode not in ("max", "min"):
        raise ValueError("mode must be max or min")
    ordered = Window.partitionBy(run).orderBy(epoch)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pick = F.max if mode == "max" else F.min
    past = pick(value).over(before)
    better = F.col(value) > past if mode == "max" else F.col(value) < past
    marked = series.withColumn("improved", (past.isNull() | better).cast("int")).withColumn(
        "best", pick(value).over(upto)
    )
    streak = marked.withColumn("__streak", F.sum("improved").over(upto))
    waited = F.sum(1 - F.col("improved")).over(
        Window.partitionBy(run, "__streak").orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        streak.withColumn("no_improve", waited)
        .withColumn("should_stop", (F.col("no_improve") >= patience).cast("int"))
        .drop("__streak")
    )


def ema_normalized(
    series: DataFrame,
    decay: float = 0.95,
    clip: float = 5.0,
    floor: float = 1e-8,
    keys: Sequence[str] = ("run",),
    epoch: str = "epoch",
    value: str = "value",
) -> DataFrame:
    """Each value over its running mean (the first value seeds it), cut at ``clip``.

    Adds ``ema`` and ``normalized``. A step takes the mean x to max(a x + b, c), and such steps, one after the other, are one
    such step again. So each part of the ordered table is made one step, the steps' results (one row a part) give
    every part the mean it starts with, and a run may be of any length: nothing is gathered by run.
    """
    keys = list(keys)
    rows = in_order(series.select(*keys, epoch, F.col(value).cast("double").alias(value)), [*keys, epoch])

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, bool, int, pd.DataFrame]]:
        """Stretches of one run: its name, whether it begins here, the part, the rows."""
        last = None
        for batch in batches:
            names = list(zip(*[batch[k].tolist() for k in keys]))
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    yield names[i], names[i] != last, int(batch["__part"].iloc[i]), batch.iloc[i:j]
                    last = names[i]

    def as_steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row a part: its first and last run, and the last one's stretch as a step and as a mean from its own seed."""
        first, found = "", None
        for name, new, part, some in segments(batches):
            first = first or str(name)
            if new:
                found = [part, str(name), 1.0, 0.0, -math.inf, math.nan]
            for x in some[value].tolist():
                shift = (1.0 - decay) * x
                found[2:] = [
                    decay * found[2],
                    decay * found[3] + shift,
                    max(decay * found[4] + shift, floor),
                    max(x if math.isnan(found[5]) else decay * found[5] + shift, floor),
                ]
        if found:
            yield pd.DataFrame([[first, *found]], columns=["first", "part", "last", "a", "b", "c", "own"])

    summed = rows.mapInPandas(as_steps, "first string, part long, last string, a double, b double, c double, own double")
    before, run, carried = {}, "", math.nan
    for r in sorted(summed.collect(), key=lambda r: r["part"]):  # one row for each part of the table
        before[r["part"]] = carried = carried if r["first"] == run else math.nan
        goes_on = r["first"] == r["last"] and not math.isnan(carried)
        run, carried = r["last"], max(r["a"] * carried + r["b"], r["c"]) if goes_on else r["own"]

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean = None
        for _, new, part, some in segments(batches):
            if new:
                mean = before[part] if mean is None else math.nan
            means = []
            for x in some[value].tolist():
                mean = max(x if math.isnan(mean) else decay * mean + (1.0 - decay) * x, floor)
                means.append(mean)
            kept = some[[*keys, epoch, value]]
            yield kept.assign(ema=means, normalized=[min(x / m, clip) for x, m in zip(some[value].tolist(), means)])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in (*keys, epoch, value)], "ema double", "normalized double"])
    return rows.mapInPandas(smooth, schema)


def best_epoch(
    series: DataFrame, mode: str = "max", run: str = "run", epoch: str = "epoch", value: str = "value"
) -> DataFrame:
    """Best value of each run and the first epoch that reached it."""
    score = F.col(value) if mode == "max" else -F.col(value)
    best = F.max_by(F.struct(epoch, value), F.struct(score, -F.col(epoch)))
    return series.groupBy(run).agg(best.alias("b")).select(
        run, F.col(f"b.{epoch}").alias("best_epoch"), F.col(f"b.{value}").alias("best_value")
    )


def objective(value: Column, direction: str) -> Column:
    """Aggregate: the best of a history."""
    name = direction.strip().lower()
    if name not in ("maximize", "minimize"):
        raise ValueError("direction must be maximize or minimize")
    return F.max(value) if name == "maximize" else F.min(value)


def trial_run_id(prefix: Column, number: Column) -> Column:
    """``prefix_t0007``: the number padded to four digits, longer ones whole."""
    text = number.cast("string")
    return F.concat(prefix, F.lit("_t"), F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text))


def trial_table(
    trials: DataFrame, history: DataFrame, direction: str, prefix: str
) -> DataFrame:
    """Trials ``trial_number, state`` with run id and objective of ``history(run_id, value)``."""
    best = history.groupBy("run_id").agg(objective(F.col("value"), direction).alias("value"))
    named = trials.withColumn("run_id", trial_run_id(F.lit(prefix), F.col("trial_number")))
    return named.join(best, "run_id", "left")


def stage_timing(events: DataFrame, start: str, done: str, run: str = "run") -> DataFrame:
    """Seconds between the first start event and the last done event of each run."""
    first = F.min(F.when(F.col("event") == start, F.col("ts")))
    last = F.max(F.when(F.col("event") == done, F.col("ts")))
    seconds = F.unix_timestamp(last) - F.unix_timestamp(first)
    return events.groupBy(run).agg(seconds.alias("seconds"))


def log_columns(log: DataFrame, names: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Columns of a training log under their printed names, in the order of ``names``, after ``keys``."""
    return log.select(*keys, *[F.col(c).alias(shown) for c, shown in names.items()])


def mean_over_groups(rows: DataFrame, value: Column, groups: Sequence[str]) -> DataFrame:
    """``mean`` of the groups' sums of ``value``, and the number of ``groups``."""
    sums = rows.groupBy(*groups).agg(F.sum(value).alias("__sum"))
    return sums.agg(F.avg("__sum").alias("mean"), F.count(F.lit(1)).alias("groups"))
