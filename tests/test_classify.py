import math
import random

import pytest
from pyspark.sql import functions as F

from graphrecon.functions import scoring as S
from graphrecon.operators import classify as C
from graphrecon.operators.prefix import global_index, random_rank, running_totals


def scored(spark, labels, probs):
    return spark.createDataFrame(list(zip(labels, probs)), "label int, prob double")


def values(row):
    return {k: v for k, v in row.first().asDict().items()}


def test_metrics_at_half(spark):
    got = values(C.evaluate(scored(spark, [0, 0, 1, 1], [0.1, 0.6, 0.9, 0.2])))
    for name in ("accuracy", "sensitivity", "specificity", "precision", "recall", "f1"):
        assert got[name] == 0.5
    assert got["mcc"] == 0.0


def test_metrics_at_lower_threshold_and_inclusive_decision(spark):
    rows = scored(spark, [0, 0, 1, 1], [0.1, 0.4, 0.45, 0.8])
    got = values(C.evaluate(rows, ["accuracy", "precision", "recall", "f1", "nonsense"], 0.3, "val"))
    assert list(got) == ["val_accuracy", "val_precision", "val_recall", "val_f1"]
    assert got["val_accuracy"] == 0.75 and got["val_recall"] == 1.0
    assert math.isclose(got["val_precision"], 2 / 3) and math.isclose(got["val_f1"], 0.8)
    assert values(C.confusion(rows, 0.45))["tp"] == 2
    assert values(C.best_f1(C.score_curve(rows)))["threshold"] == 0.45


def test_single_class(spark):
    rows = scored(spark, [1, 1], [0.2, 0.9])
    assert values(C.evaluate(rows, ["auroc", "auprc"])) == {"auroc": 0.0, "auprc": 0.0}
    assert values(C.best_f1(C.score_curve(rows)))["threshold"] == 0.5


def test_curve_against_brute_force_with_ties(spark):
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 1)) for _ in range(400)]
    got = values(C.curve_metrics(C.score_curve(scored(spark, *zip(*rows)))))
    pos = [p for y, p in rows if y]
    neg = [p for y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    ap = 0.0
    for t in sorted({p for _, p in rows}, reverse=True):
        above = [y for y, p in rows if p >= t]
        ap += sum(y for y, p in rows if p == t) / len(pos) * sum(above) / len(above)
    assert math.isclose(got["auroc"], auc) and math.isclose(got["auprc"], ap)


def test_threshold_options(spark):
    assert C.resolve_threshold(0.25) == (0.25, "fixed")
    assert C.resolve_threshold({"mode": "fixed", "value": 0.7}) == (0.7, "fixed")
    valid = scored(spark, [0, 0, 1, 1], [0.1, 0.4, 0.45, 0.8])
    assert C.resolve_threshold({"mode": "best_f1_on_valid"}, valid) == (0.45, "best_f1_on_valid")
    for bad in (True, {"mode": "other"}, 1.5, None):
        with pytest.raises(ValueError):
            C.resolve_threshold(bad)


def test_losses(spark):
    rows = spark.createDataFrame([(2.0, 1), (-3.0, 0), (900.0, 0)], "x double, y int")
    plain, heavy = S.logit_loss(F.col("x"), F.col("y")), S.logit_loss(F.col("x"), F.col("y"), 3.0, 0.2)
    got = rows.select(plain.alias("a"), heavy.alias("b")).collect()
    assert math.isclose(got[0]["a"], math.log(1 + math.exp(-2)))
    assert math.isclose(got[2]["a"], 900.0)
    y = 0.9
    want = (1 - y) * math.log(1 + math.exp(2)) + 3 * y * math.log(1 + math.exp(-2))
    assert math.isclose(got[0]["b"], want)
    with pytest.raises(ValueError):
        S.logit_loss(F.col("x"), F.col("y"), pos_weight=0)
    masked = rows.agg(S.masked_mean(F.col("x"), F.lit(0))).first()[0]
    assert masked == 0.0


def test_class_probabilities(spark):
    logits = F.array(F.lit(1.0), F.lit(2.0), F.lit(40.0))
    soft = S.softmax(logits, 0.01)
    ce = S.class_cross_entropy(logits, F.lit(0))
    row = spark.range(1).select(soft.alias("p"), ce.alias("ce")).first()
    assert row["p"] == [0.01, 0.01, 0.99] and math.isclose(row["ce"], 39.0)


def test_orders_over_many_parts(spark):
    rng = random.Random(1)
    items = [(i, rng.randrange(20), rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(items, "id long, k int, w int").repartition(7)
    at = {r["id"]: r["idx"] for r in global_index(df, [F.desc("k"), "id"]).collect()}
    assert [i for i, _ in sorted(at.items(), key=lambda x: x[1])] == [
        i for i, _, _ in sorted(items, key=lambda x: (-x[1], x[0]))
    ]
    upto = {r["id"]: r["w_upto"] for r in running_totals(df, ["k", "id"], ["w"]).collect()}
    total = 0
    for i, _, w in sorted(items, key=lambda x: (x[1], x[0])):
        total += w
        assert upto[i] == total
    keyed = df.withColumn("key", F.shiftright(F.xxhash64("id"), 4).bitwiseAND(F.lit((1 << 60) - 1)))
    ranked = random_rank(keyed, "key", ["id"], groups=["w"]).collect()
    for w in range(5):
        mine = sorted((r["key"], r["id"], r["rank"]) for r in ranked if r["w"] == w)
        assert [m[2] for m in mine] == list(range(len(mine)))
