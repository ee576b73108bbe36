"""Scores, probabilities and losses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphrecon.functions.keys import let


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def decide(prob: Column, threshold: float | Column) -> Column:
    """1 when the probability reaches the threshold, the threshold itself included."""
    bound = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (prob >= bound).cast("int")


def finite_or_zero(value: Column) -> Column:
    value = value.cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, 0.0).otherwise(value)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def two_class_probabilities(logit: Column, epsilon: float = 1e-5) -> Column:
    """[negative, positive] probabilities kept inside [epsilon, 1 - epsilon]."""
    positive = sigmoid(logit)
    return F.array(
        clamp(1.0 - positive, epsilon, 1.0 - epsilon), clamp(positive, epsilon, 1.0 - epsilon)
    )


def softmax(logits: Column, epsilon: float = 1e-5) -> Column:
    """Clamped class probabilities of an array of logits."""

    def shares(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
        return let(
            total, lambda t: F.transform(powers, lambda p: clamp(p / t, epsilon, 1.0 - epsilon))
        )

    def powered(z: Column) -> Column:
        return let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))

    return let(logits, lambda z: let(powered(z), shares))


def smooth_label(label: Column, smoothing: float) -> Column:
    if not 0.0 <= smoothing < 1.0:
        raise ValueError("smoothing must lie in [0, 1)")
    return label.cast("double") * (1.0 - smoothing) + 0.5 * smoothing


def logit_loss(
    logit: Column, label: Column, pos_weight: float = 1.0, smoothing: float = 0.0
) -> Column:
    """Binary cross entropy of a logit, positives weighted, without overflow for big logits."""
    if pos_weight <= 0.0:
        raise ValueError("pos_weight must be above 0")
    y = smooth_label(label, smoothing)
    weight = 1.0 + (pos_weight - 1.0) * y
    softplus = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    return (1.0 - y) * logit + weight * softplus


def masked_mean(loss: Column, mask: Column) -> Column:
    """Aggregate: mean of the losses under the mask, 0 when nothing is masked in."""
    total = F.sum(mask)
    return F.coalesce(F.when(total > 0, F.sum(loss * mask) / total), F.lit(0.0))


def class_cross_entropy(logits: Column, label: Column) -> Column:
    """Cross entropy of an array of logits against a class number."""

    def loss(z: Column) -> Column:
        return let(
            F.array_max(z),
            lambda top: F.log(F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
            + top
            - F.get(z, label),
        )

    return let(logits, loss)


def entropy(probabilities: Column, epsilon: float) -> Column:
    """Sum of -p ln p over an array of probabilities."""
    kept = F.transform(probabilities, lambda p: F.greatest(p, F.lit(epsilon)))
    return F.aggregate(kept, F.lit(0.0), lambda s, p: s - p * F.log(p))
