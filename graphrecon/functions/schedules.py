"""Epoch schedules, monitors and ranking directions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ramp_scale(
    epoch: Column, warmup_epochs: int, ramp_epochs: int, schedule: str = "linear"
) -> Column:
    """0 during warm-up, then a linear or cosine rise to 1."""
    if warmup_epochs < 0 or ramp_epochs < 0:
        raise ValueError("warmup_epochs and ramp_epochs must not be negative")
    if schedule.lower() not in ("linear", "cosine"):
        raise ValueError("schedule must be linear or cosine")
    done = epoch - warmup_epochs
    if ramp_epochs == 0:
        rise = F.lit(1.0)
    else:
        part = done / float(ramp_epochs)
        if schedule.lower() == "cosine":
            part = 0.5 * (1.0 - F.cos(F.lit(math.pi) * part))
        rise = F.when(done >= ramp_epochs, 1.0).otherwise(part)
    return F.when(epoch < warmup_epochs, 0.0).otherwise(rise)


def learning_rate_factor(step: Column, total_steps: int, gamma: float, power: float) -> Column:
    return F.pow(1.0 + gamma * step.cast("double") / float(max(1, total_steps)), F.lit(-power))


def is_progress_point(step: Column, total_steps: Column, every_n_steps: int = 0) -> Column:
    """First step, last step, and every fourth part of the epoch (or a longer asked interval)."""
    total = F.greatest(F.lit(1), total_steps)
    interval = F.greatest(F.lit(2), F.ceil(total / 4), F.lit(every_n_steps))
    return (step > 0) & ((step == 1) | (step == total) | (step % interval == 0))


def validation_due(epoch: Column, scale: Column, cadence: int) -> Column:
    """Run the costly validation once the topology weight is on, before that every ``cadence``."""
    waiting = ((epoch + 1) % cadence == 0) if cadence > 0 else F.lit(False)
    return (scale > 0) | waiting


def ranking_value(metric: Column, value: Column) -> Column:
    """Lower is better: similarity negated, density as distance from 1, others as they are."""
    return (
        F.when(metric.endswith("graph_sim"), -value)
        .when(metric.endswith("relative_density"), F.abs(value - 1.0))
        .otherwise(value)
    )


def monitor_value(
    monitor: Column,
    *,
    graph_sim: Column,
    relative_density: Column,
    auprc: Column,
    loss: Column,
) -> Column:
    """Number watched for checkpoints; an unknown name falls back to graph similarity."""
    return (
        F.when(monitor == "val_loss", loss)
        .when(monitor.isin("internal_val_graph_sim", "val_graph_sim"), graph_sim)
        .when(
            monitor.isin("internal_val_relative_density", "val_relative_density"),
            -F.abs(relative_density - 1.0),
        )
        .when(monitor == "val_auprc", auprc)
        .otherwise(graph_sim)
    )


def monitor_mode(monitor: str) -> str:
    return "min" if monitor == "val_loss" else "max"
