"""Pair classification on all scored lines, and the ranking metrics on all vector pairs too."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphrecon.catalog import tables as T
from graphrecon.catalog.registry import query
from graphrecon.functions.keys import rounded
from graphrecon.functions.scoring import logit_loss
from graphrecon.operators import classify as C

_COUNTS = """
counts AS (SELECT sum((label=1 AND prob>=0.5)::BIGINT)::DOUBLE AS tp,
  sum((label=0 AND prob>=0.5)::BIGINT)::DOUBLE AS fp,
  sum((label=1 AND prob<0.5)::BIGINT)::DOUBLE AS fn,
  sum((label=0 AND prob<0.5)::BIGINT)::DOUBLE AS tn FROM scored)
"""
_HEAD = f"WITH {T.SCORED_SQL}, {_COUNTS} "
# Fixed-threshold metrics over one row of counts.
_METRIC_SQL = {
    "accuracy": "(tp+tn)/(tp+fp+fn+tn)",
    "sensitivity": "tp/(tp+fn)",
    "specificity": "tn/(tn+fp)",
    "precision": "tp/(tp+fp)",
    "recall": "tp/(tp+fn)",
    "f1": "2*tp/(2*tp+fp+fn)",
    "mcc": "(tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn))",
}


def _select(*names: str) -> str:
    return "SELECT " + ", ".join(f"round({_METRIC_SQL[n]},6) AS {n}" for n in names) + " FROM counts"


def _curve_sql(table: str) -> str:
    """Counts at and above each distinct probability, plus the totals."""
    return f"""
merged AS (SELECT prob, sum((label=1)::BIGINT)::DOUBLE AS pos, sum((label=0)::BIGINT)::DOUBLE AS neg
  FROM {table} GROUP BY prob),
curve AS (SELECT prob, pos, neg, sum(pos) OVER w AS pu, sum(neg) OVER w AS nu,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM merged WINDOW w AS (ORDER BY prob DESC))
"""


_AUROC = "round(sum(neg*(pu-pos/2))/(max(p)*max(n)),6)"
_AUPRC = "round(sum(pos*pu/(pu+nu))/max(p),6)"
_BEST = """SELECT prob AS threshold, round(2*pu/(pu+nu+p),6) AS f1 FROM curve
  ORDER BY round(2*pu/(pu+nu+p),9) DESC, abs(prob-0.5), prob LIMIT 1"""


@query(
    "e1_confusion_counts",
    _HEAD + "SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn FROM counts",
)
def e1(spark, sf):
    return C.confusion(T.scored_lines(spark, sf), 0.5)


def _metrics(spark, sf, *names):
    row = C.evaluate(T.scored_lines(spark, sf), names, 0.5)
    return row.select(*[rounded(F.col(n)).alias(n) for n in names])


@query("e2_accuracy", _HEAD + _select("accuracy"))
def e2(spark, sf):
    return _metrics(spark, sf, "accuracy")


@query("e3_sensitivity_specificity", _HEAD + _select("sensitivity", "specificity"))
def e3(spark, sf):
    return _metrics(spark, sf, "sensitivity", "specificity")


@query("e4_precision_recall_f1", _HEAD + _select("precision", "recall", "f1"))
def e4(spark, sf):
    return _metrics(spark, sf, "precision", "recall", "f1")


@query("e5_matthews", _HEAD + _select("mcc"))
def e5(spark, sf):
    return _metrics(spark, sf, "mcc")


@query("e6_auroc", f"WITH {T.SCORED_SQL}, {_curve_sql('scored')} SELECT {_AUROC} AS auroc FROM curve")
def e6(spark, sf):
    return _metrics(spark, sf, "auroc")


@query("e7_auprc", f"WITH {T.SCORED_SQL}, {_curve_sql('scored')} SELECT {_AUPRC} AS auprc FROM curve")
def e7(spark, sf):
    return _metrics(spark, sf, "auprc")


@query(
    "e6_e7_vector_pairs",
    f"WITH {T.VECTOR_SQL}, {_curve_sql('vpairs')} "
    f"SELECT {_AUROC} AS auroc, {_AUPRC} AS auprc FROM curve",
)
def e67_vectors(spark, sf):
    row = C.curve_metrics(C.score_curve(T.vector_scores(spark, sf), "pairs"))
    return row.select(rounded(F.col("auroc")).alias("auroc"), rounded(F.col("auprc")).alias("auprc"))


_LOSS_SQL = """((1.0::DOUBLE-y)*logit + (1.0::DOUBLE + w*y)*(ln(1.0::DOUBLE+exp(-abs(logit)))
  + greatest(-logit, 0.0::DOUBLE)))"""


@query(
    "e8_mean_loss",
    f"WITH {T.SCORED_SQL} SELECT round(avg({_LOSS_SQL}),6) AS loss "
    "FROM (SELECT logit, label::DOUBLE AS y, 0.0::DOUBLE AS w FROM scored)",
)
def e8(spark, sf):
    lines = T.scored_lines(spark, sf)
    row = C.evaluate(lines, [], loss=logit_loss(F.col("logit"), F.col("label")))
    return row.select(rounded(F.col("loss")).alias("loss"))


@query("e9_best_f1_threshold", f"WITH {T.SCORED_SQL}, {_curve_sql('scored')} {_BEST}")
def e9(spark, sf):
    best = C.best_f1(C.score_curve(T.scored_lines(spark, sf)))
    return best.select("threshold", rounded(F.col("f1")).alias("f1"))


@query("e9_vector_pairs", f"WITH {T.VECTOR_SQL}, {_curve_sql('vpairs')} {_BEST}")
def e9_vectors(spark, sf):
    best = C.best_f1(C.score_curve(T.vector_scores(spark, sf), "pairs"))
    return best.select("threshold", rounded(F.col("f1")).alias("f1"))


@query(
    "e10_threshold_resolution",
    f"WITH {T.SCORED_SQL}, {_curve_sql('scored')}, best AS ({_BEST}) "
    "SELECT threshold, 'best_f1_on_valid' AS mode, "
    "(SELECT count(*) FROM scored WHERE prob >= threshold) AS positives FROM best",
)
def e10(spark, sf):
    lines = T.scored_lines(spark, sf)
    threshold, mode = C.resolve_threshold({"mode": "best_f1_on_valid"}, lines)
    return lines.filter(F.col("prob") >= threshold).agg(
        F.lit(threshold).alias("threshold"),
        F.lit(mode).alias("mode"),
        F.count(F.lit(1)).alias("positives"),
    )


@query(
    "e11_metric_selection",
    f"WITH {T.SCORED_SQL}, {_COUNTS}, {_curve_sql('scored')} "
    f"SELECT (SELECT {_AUROC} FROM curve) AS auroc, round({_METRIC_SQL['f1']},6) AS f1, "
    f"round({_METRIC_SQL['accuracy']},6) AS accuracy FROM counts",
)
def e11(spark, sf):
    row = C.evaluate(T.scored_lines(spark, sf), ["AUROC", "f1", "unknown", "accuracy"])
    return row.select(*[rounded(F.col(c)).alias(c) for c in row.columns])


@query("e12_metric_prefix", f"WITH {T.SCORED_SQL}, {_COUNTS} SELECT round({_METRIC_SQL['recall']},6) "
       f"AS val_recall, round({_METRIC_SQL['mcc']},6) AS val_mcc FROM counts")
def e12(spark, sf):
    row = C.evaluate(T.scored_lines(spark, sf), ["recall", "mcc"], prefix="val")
    return row.select(*[rounded(F.col(c)).alias(c) for c in row.columns])


@query(
    "a6_class_counts",
    f"WITH {T.SCORED_SQL} SELECT pos, neg, round(neg/greatest(1,pos)::DOUBLE,6) AS ratio FROM "
    "(SELECT sum((label=1)::INT)::BIGINT AS pos, sum((label=0)::INT)::BIGINT AS neg FROM scored)",
)
def a6(spark, sf):
    counts = C.class_counts(T.scored_lines(spark, sf))
    return counts.select("pos", "neg", rounded(F.col("ratio")).alias("ratio"))


@query(
    "w8_prefix_counts",
    f"WITH {T.SCORED_SQL}, {_curve_sql('scored')} SELECT prob, pu::BIGINT AS pos_upto, "
    "nu::BIGINT AS neg_upto FROM curve",
)
def w8(spark, sf):
    return C.score_curve(T.scored_lines(spark, sf)).select("prob", "pos_upto", "neg_upto")
