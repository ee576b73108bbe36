"""Pair classification: counts at a threshold, ranking metrics, threshold choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrecon.functions.rows import beside
from graphrecon.functions.scoring import decide, finite_or_zero
from graphrecon.operators.prefix import running_totals

# Metric names in report order.
METRICS = (
    "auroc",
    "auprc",
    "accuracy",
    "sensitivity",
    "specificity",
    "precision",
    "recall",
    "f1",
    "mcc",
)
_CURVE_METRICS = ("auroc", "auprc")


def confusion(scored: DataFrame, threshold: float = 0.5, groups: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn of ``scored(label, prob)``, one row per group."""
    pred = decide(F.col("prob"), threshold)

    def hits(label: int, decision: int) -> Column:
        hit = (F.col("label") == label) & (pred == decision)
        return F.coalesce(F.sum(hit.cast("bigint")), F.lit(0))

    return scored.groupBy(*groups).agg(
        hits(1, 1).alias("tp"),
        hits(0, 1).alias("fp"),
        hits(1, 0).alias("fn"),
        hits(0, 0).alias("tn"),
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / F.when(bottom > 0, bottom)).otherwise(0.0)


def threshold_metrics() -> dict[str, Column]:
    """Metric name to expression over the columns tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return {
        "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
        "sensitivity": _ratio(tp, tp + fn),
        "specificity": _ratio(tn, tn + fp),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2.0 * tp, 2.0 * tp + fp + fn),
        "mcc": _ratio(tp * tn - fp * fn, F.sqrt(product)),
    }


def score_curve(scored: DataFrame, weight: str | None = None) -> DataFrame:
    """One row per distinct probability, with counts at and above it; a row counts ``weight`` times, if given.

    Equal probabilities are merged first (Spark merges inside each task before the shuffle), so
    a probability shared by a third of all pairs is one row here.
    """
    times = F.lit(1) if weight is None else F.col(weight)
    merged = scored.groupBy("prob").agg(
        F.sum((F.col("label") == 1).cast("bigint") * times).alias("pos"),
        F.sum((F.col("label") == 0).cast("bigint") * times).alias("neg"),
    )
    return running_totals(merged, [F.desc("prob")], ["pos", "neg"])


def curve_metrics(curve: DataFrame) -> DataFrame:
    """AUROC (ties count half) and step-wise average precision; 0 when a class is missing."""
    terms = curve.select(
        "pos",
        "neg",
        (F.col("neg") * (F.col("pos_upto") - F.col("pos") / 2.0)).alias("ranked"),
        (F.col("pos") * F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto"))).alias("step"),
    )
    total = terms.agg(
        F.sum("pos").cast("double").alias("p"),
        F.sum("neg").cast("double").alias("n"),
        F.sum("ranked").alias("ranked"),
        F.sum("step").alias("step"),
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return total.select(
        F.when(both, F.col("ranked") / F.when(both, F.col("p") * F.col("n")))
        .otherwise(0.0)
        .alias("auroc"),
        F.when(both, F.col("step") / F.when(both, F.col("p"))).otherwise(0.0).alias("auprc"),
    )


def curve_confusion(curve: DataFrame, threshold: float) -> DataFrame:
    """tp, fp, fn, tn from the merged probabilities, without another look at the pairs."""
    hit = F.col("prob") >= threshold

    def total(column: str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(column))), F.lit(0))

    return curve.agg(
        total("pos", hit).alias("tp"),
        total("neg", hit).alias("fp"),
        total("pos", ~hit).alias("fn"),
        total("neg", ~hit).alias("tn"),
    )


def best_f1(curve: DataFrame) -> DataFrame:
    """One row: the probability with the best F1 as ``threshold``, and that ``f1``.

    F1 values equal to nine digits count as tied: the probability nearest 0.5 wins, then the
    lowest. With one class only the threshold is 0.5.
    """
    sums = curve.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    keyed = beside(curve, sums)
    f1 = 2.0 * F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto") + F.col("p"))
    best = keyed.agg(
        F.max("p").alias("p"),
        F.max("n").alias("n"),
        F.min_by(
            F.struct("prob", f1.alias("f1")),
            F.struct(-F.round(f1, 9), F.abs(F.col("prob") - 0.5), F.col("prob")),
        ).alias("best"),
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return best.select(
        F.when(both, F.col("best.prob")).otherwise(0.5).alias("threshold"),
        F.when(both, F.col("best.f1")).otherwise(0.0).alias("f1"),
    )


def resolve_threshold(option: object, valid: DataFrame | None = None) -> tuple[float, str]:
    """Threshold and mode from a number, ``{mode: fixed, value}`` or ``{mode: best_f1_on_valid}``."""
    if isinstance(option, bool):
        raise ValueError("decision threshold must be a number or a mapping")
    mode = "fixed"
    if isinstance(option, dict):
        mode = str(option.get("mode", "fixed")).lower()
        if mode == "best_f1_on_valid":
            if valid is None:
                raise ValueError("best_f1_on_valid needs scored validation pairs")
            row = best_f1(score_curve(valid)).first()
            return float(row["threshold"]), mode
        if mode != "fixed":
            raise ValueError("mode must be fixed or best_f1_on_valid")
        option = option.get("value", 0.5)
    if not isinstance(option, (int, float, str)):
        raise ValueError("decision threshold must be a number or a mapping")
    value = float(option)
    if not 0.0 <= value <= 1.0:
        raise ValueError("decision threshold must lie in [0, 1]")
    return value, mode


def evaluate(
    scored: DataFrame,
    metrics: Sequence[str] = METRICS,
    threshold: float = 0.5,
    prefix: str | None = None,
    loss: Column | None = None,
) -> DataFrame:
    """One row with the chosen metrics; unknown names are left out, ``loss`` is averaged."""
    wanted = [m for m in (name.lower() for name in metrics) if m in METRICS]
    curve = score_curve(scored) if any(m in _CURVE_METRICS for m in wanted) else None
    counts = confusion(scored, threshold) if curve is None else curve_confusion(curve, threshold)
    row = counts.select(*[finite_or_zero(e).alias(n) for n, e in threshold_metrics().items()])
    if curve is not None:
        row = beside(row, curve_metrics(curve))
    if loss is not None:
        row = beside(row, scored.agg(F.avg(loss).alias("loss")))
        wanted = [*wanted, "loss"]
    name = (lambda m: f"{prefix}_{m}") if prefix else (lambda m: m)
    return row.select(*[F.col(m).alias(name(m)) for m in wanted])


def class_counts(scored: DataFrame) -> DataFrame:
    """Positives, negatives and the natural ratio of negatives per positive."""
    counts = scored.agg(
        F.coalesce(F.sum((F.col("label") == 1).cast("bigint")), F.lit(0)).alias("pos"),
        F.coalesce(F.sum((F.col("label") == 0).cast("bigint")), F.lit(0)).alias("neg"),
    )
    ratio = F.col("neg") / F.greatest(F.lit(1), F.col("pos"))
    return counts.withColumn("ratio", ratio)
