import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphrecon.functions import schedules as H
from graphrecon.functions import vectors as X
from graphrecon.functions.keys import chosen_pairs, order_key
from graphrecon.operators import adapt as A
from graphrecon.operators import curves as C
from graphrecon.operators import ranking as R
from graphrecon.operators import vectors as V
from graphrecon.operators.training import (
    all_pair_cells,
    held_out_scores,
    score_with,
    train_all_pairs,
    train_pair_classifier,
)
from graphrecon.sources import sinks as K


def wide(spark, *models):
    columns = ", ".join(f"{c} double" for c in R.METRIC_COLUMNS)
    rows = [("base", name, *values) for name, values in models]
    return spark.createDataFrame(rows, f"category string, model string, {columns}")


def flat(graph_sim, density, mmd):
    return [graph_sim, density, mmd, mmd, mmd] * 3


def test_ranks_of_two_models(spark, tmp_path):
    rows = wide(spark, ("old", flat(0.4, 2.0, 0.3)), ("new", flat(0.5, 0.9, 0.1)))
    table = R.comparison_table(rows).collect()
    assert [(r["model"], r["avg_rank"]) for r in table] == [("new", 1), ("old", 2)]
    _, md = K.write_report(R.comparison_table(rows), str(tmp_path), "new")
    text = [r["value"] for r in spark.read.text(md).collect()]
    assert text[0].startswith("| Category | Model | BFS GS") and text[1].count("---") == 18
    assert text[2].startswith("| base | new | 0.5000 | 0.9000 | 0.1000") and text[2].endswith("| 1 |")


def test_ties_share_a_rank_and_leave_a_gap(spark):
    rows = wide(spark, ("a", flat(0.5, 1.1, 0.1)), ("b", flat(0.5, 0.9, 0.1)), ("c", flat(0.1, 3.0, 0.9)))
    ranks = {(r["model"], r["metric"]): r["rank"] for r in R.metric_ranks(rows).collect()}
    assert [ranks[(m, "bfs_cc")] for m in "abc"] == [1, 1, 3]
    with pytest.raises(ValueError):
        R.require_unique_models(rows.unionByName(rows))


def series(spark, values, run="r"):
    return spark.createDataFrame([(run, i, float(v)) for i, v in enumerate(values)], "run string, epoch int, value double")


def test_early_stopping(spark):
    rows = C.early_stopping(series(spark, [1, 1, 3, 2, 2, 4]), patience=2).orderBy("epoch").collect()
    assert [r["improved"] for r in rows] == [1, 0, 1, 0, 0, 1]
    assert [r["no_improve"] for r in rows] == [0, 1, 0, 1, 2, 0]
    assert [r["should_stop"] for r in rows] == [0, 0, 0, 0, 1, 0]
    low = C.early_stopping(series(spark, [3, 2, 2]), patience=1, mode="min").orderBy("epoch").collect()
    assert [r["improved"] for r in low] == [1, 1, 0]


def test_ema(spark):
    rows = C.ema_normalized(series(spark, [2, 4, 100, 0]), decay=0.5, clip=1.5).orderBy("epoch").collect()
    assert [r["ema"] for r in rows] == [2, 3, 51.5, 25.75]
    assert [r["normalized"] for r in rows] == [1.0, 4 / 3, 1.5, 0.0]


def test_ema_of_long_runs_equals_the_fold(spark):
    import random

    rng, rows = random.Random(3), []
    for run, size in (("a", 1), ("b", 7000), ("c", 2), ("d", 900), ("e", 1)):
        rows += [(run, i, rng.expovariate(0.2) if i % 5 else 0.0) for i in range(size)]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "run string, epoch int, value double").repartition(9)
    got = {(r["run"], r["epoch"]): (r["ema"], r["normalized"]) for r in C.ema_normalized(df, 0.9, 2.0, 0.01).collect()}
    assert len(got) == len(rows)
    mean = run = None
    for name, i, x in sorted(rows):
        mean = max(x if name != run else 0.9 * mean + (1.0 - 0.9) * x, 0.01)
        run = name
        assert got[name, i] == pytest.approx((mean, min(x / mean, 2.0)), rel=1e-9)
    assert C.ema_normalized(df.filter("false")).count() == 0


def test_best_epoch_and_trials(spark):
    best = C.best_epoch(series(spark, [1, 5, 5])).first()
    assert (best["best_epoch"], best["best_value"]) == (1, 5.0)
    row = series(spark, [0.3, 0.5, 0.4]).agg(
        C.objective(F.col("value"), "maximize").alias("a"), C.objective(F.col("value"), " Minimize").alias("b")
    ).first()
    assert (row["a"], row["b"]) == (0.5, 0.3)
    names = spark.range(1).select(C.trial_run_id(F.lit("x"), F.lit(7)), C.trial_run_id(F.lit("x"), F.lit(12345))).first()
    assert tuple(names) == ("x_t0007", "x_t12345")


def test_schedules(spark):
    epochs = spark.range(8).withColumnRenamed("id", "e")
    linear = [r[0] for r in epochs.select(H.ramp_scale(F.col("e"), 2, 4)).collect()]
    assert linear == [0, 0, 0, 0.25, 0.5, 0.75, 1, 1]
    cosine = [r[0] for r in epochs.select(H.ramp_scale(F.col("e"), 2, 4, "cosine")).collect()]
    assert cosine[4] == pytest.approx(0.5) and cosine[3] == pytest.approx(0.5 * (1 - math.cos(math.pi / 4)))
    at_once = [r[0] for r in epochs.select(H.ramp_scale(F.col("e"), 2, 0)).collect()]
    assert at_once == [0, 0, 1, 1, 1, 1, 1, 1]
    steps = spark.range(0, 13).filter(H.is_progress_point(F.col("id"), F.lit(12))).collect()
    assert [r[0] for r in steps] == [1, 3, 6, 9, 12]
    due = epochs.filter(H.validation_due(F.col("e"), H.ramp_scale(F.col("e"), 5, 2), 2)).collect()
    assert [r[0] for r in due] == [1, 3, 5, 6, 7]
    with pytest.raises(ValueError):
        H.ramp_scale(F.col("e"), 1, 1, "steps")


def test_centroids_and_pseudo_labels(spark):
    rows = spark.createDataFrame(
        [(0, [2.0, 0.0], [1.0, 0.0, 0.0]), (1, [0.0, 4.0], [0.0, 1.0, 0.0])],
        "id int, features array<double>, probs array<double>",
    )
    centroids = A.soft_centroids(rows)
    got = {r["class"]: r["centroid"] for r in centroids.collect()}
    assert got == {0: [2.0, 0.0], 1: [0.0, 4.0], 2: [0.0, 0.0]}
    labels = {r["id"]: r["class"] for r in A.pseudo_labels(rows, centroids, "id").collect()}
    assert labels == {0: 0, 1: 1}


def test_entropy_and_diversity(spark):
    rows = spark.createDataFrame([([0.5, 0.5],), ([1.0, 0.0],)], "probs array<double>")
    e = rows.agg(A.entropy_loss(epsilon=1e-5)).first()[0]
    assert e == pytest.approx((math.log(2) - 1e-5 * math.log(1e-5)) / 2)
    d = A.diversity_loss(rows).first()["diversity"]
    assert d == pytest.approx(0.75 * math.log(0.75) + 0.25 * math.log(0.25))


def test_vector_functions(spark):
    m = F.array(F.array(F.lit(1.0), F.lit(5.0)), F.array(F.lit(3.0), F.lit(1.0)))
    row = spark.range(1).select(
        X.mean_pool(m).alias("mean"), X.max_pool(m).alias("top"), X.first_row(m).alias("first"),
        X.vector_error(m, 2, 2).alias("ok"), X.vector_error(m, 3, 2).alias("wide"), X.vector_error(m, 2, 1).alias("long"),
        X.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))).alias("cos"),
    ).first()
    assert (row["mean"], row["top"], row["first"]) == ([2.0, 3.0], [3.0, 5.0], [1.0, 5.0])
    assert row["ok"] is None and row["wide"].startswith("width") and row["long"].startswith("longer")
    assert row["cos"] == pytest.approx(0.96)


def test_lookup_audit_and_hot_ids(spark):
    vectors = spark.createDataFrame([(f"n{i}", [float(i), 1.0]) for i in range(20)], "id string, vec array<double>")
    pairs = spark.createDataFrame([("n0", f"n{i}") for i in range(20)] + [("n1", "gone")], "a string, b string")
    got = V.lookup_vectors(pairs.where("b <> 'gone'"), vectors)
    assert sorted((r["a"], r["b"], r["vec_b"][0]) for r in got.collect()) == sorted(("n0", f"n{i}", float(i)) for i in range(20))
    with pytest.raises(ValueError, match="gone"):
        V.lookup_vectors(pairs, vectors)
    scored = V.score_pairs(pairs, vectors, F.get("vec_b", F.lit(0)), missing="keep").collect()
    assert len(scored) == 21
    assert [(r["a"], r["logit"], r["state"]) for r in scored if r["b"] == "gone"] == [("n1", None, "first")]
    assert [r["id"] for r in V.missing_ids(pairs, vectors).collect()] == ["gone"]
    with pytest.raises(ValueError, match="gone"):
        V.require_vectors(pairs, vectors)
    audited = V.audit(pairs.select(F.col("b").alias("id")), vectors.select("id", F.array("vec").alias("rows")), 2, 1)
    assert V.to_rebuild(audited, {"dim": 2}, {"dim": 2}).count() == 1
    assert V.to_rebuild(audited, {"dim": 3}, {"dim": 2}).count() == 21


@pytest.mark.parametrize("block_rows", [4, 100])
def test_similarity_blocks_against_numpy(spark, block_rows):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(17, 6))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "id long, f array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = unit @ unit.T
    got = V.similarity_blocks(df, ["f"], block_rows=block_rows).collect()
    assert len(got) == 17 * 16 // 2 and all(r["u"] < r["v"] for r in got)
    assert all(r["f"] == pytest.approx(want[r["u"], r["v"]]) for r in got)
    near = V.similarity_blocks(df, ["f"], {"f": 0.3}, block_rows).collect()
    assert {(r["u"], r["v"]) for r in near} == {(i, j) for i in range(17) for j in range(i + 1, 17) if want[i, j] >= 0.3}


def test_classifier_learns_similarity(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(2, 4)) * 3
    rows = [(f"v{i}", [float(x) for x in centre[i % 2] + rng.normal(size=4) * 0.3]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "id string, vec array<double>")
    pairs = spark.createDataFrame(
        [(f"v{i}", f"v{j}", int(i % 2 == j % 2)) for i in range(30) for j in range(i)], "a string, b string, label int"
    )
    fitted = train_pair_classifier(pairs, vectors, pairs, penalties=(10.0, 0.001))
    assert fitted.auprc > 0.99
    scored = score_with(fitted, pairs, vectors)
    assert scored.filter((F.col("prob") >= 0.5) != (F.col("label") == 1)).count() == 0


def _labelled_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(rng.normal(size=(41, 3)))]
    return spark.createDataFrame(rows, "id long, vec array<double>")


def _pairs_of(vectors, cut):
    a = vectors.select(F.col("id").alias("a"), F.col("vec").alias("x"))
    b = vectors.select(F.col("id").alias("b"), F.col("vec").alias("y"))
    label = (F.round(X.cosine(F.col("x"), F.col("y")), 6) >= cut).cast("int").alias("label")
    return a.crossJoin(b).filter("a < b").select("a", "b", label)


@pytest.mark.parametrize("block_rows", [7, 2048])
def test_all_pairs_train_as_listed_ones(spark, block_rows):
    """The classifier that forms no row per pair is Spark's own one, on the same pairs."""
    vectors = _labelled_vectors(spark)
    pairs = _pairs_of(vectors, 0.2)
    held = order_key(2, "holdout", F.col("a"), F.col("b")) < int(0.2 * 2**60)
    cells = all_pair_cells(vectors, 0.2, 2, "holdout", 0.2, block_rows)
    found = train_all_pairs(cells, 0.01, 200, 1e-12)
    want = train_pair_classifier(pairs.filter(~held), vectors, penalties=(0.01,), max_iter=200)
    assert np.allclose(found.coefficients, want.model.coefficients.toArray(), atol=2e-3)
    assert found.intercept == pytest.approx(want.model.intercept, abs=2e-3)
    scores = held_out_scores(found, cells)
    assert [tuple(r) for r in scores.groupBy("label").agg(F.sum("pairs")).orderBy("label").collect()] == [
        tuple(r) for r in pairs.filter(held).groupBy("label").count().orderBy("label").collect()
    ]
    listed = score_with(want, pairs.filter(held), vectors)
    mean = scores.agg(F.sum(F.col("prob") * F.col("pairs")) / F.sum("pairs")).first()[0]
    assert mean == pytest.approx(listed.agg(F.avg("prob")).first()[0], abs=1e-3)


def test_all_pairs_of_one_label_raise(spark):
    cells = all_pair_cells(_labelled_vectors(spark), -1.0, 2, "holdout", 0.2)
    with pytest.raises(ValueError, match="both labels"):
        train_all_pairs(cells)


@pytest.mark.parametrize("ids", [list(range(5, 30, 3)), ["a", "b|", "ä", "zz"]])
def test_chosen_pairs_are_those_of_the_order_key(spark, ids):
    chosen = chosen_pairs(3, "cut", ids, ids, 0.4)
    kind = "long" if isinstance(ids[0], int) else "string"
    rows = spark.createDataFrame([(a, b) for a in ids for b in ids if a < b], f"a {kind}, b {kind}")
    keyed = rows.filter(order_key(3, "cut", F.col("a"), F.col("b")) < int(0.4 * 2**60)).collect()
    want = {(r["a"], r["b"]) for r in keyed}
    assert 0 < len(want) < rows.count()
    for i, a in enumerate(ids):
        for j, b in enumerate(ids):
            if a != b:
                assert chosen[i, j] == ((min(a, b), max(a, b)) in want)


def test_trained_classifier_writes_no_row_per_pair(spark, sf, monkeypatch):
    from graphrecon.catalog import QUERIES, tables

    def listed(*_):
        raise AssertionError("all pairs are listed")

    monkeypatch.setattr(tables, "vector_pairs", listed)
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    row = QUERIES["f1_trained_classifier"](spark, sf).first()
    assert 0.15 * n * (n - 1) / 2 < row["pairs"] < 0.25 * n * (n - 1) / 2 and row["auroc"] > 0.9


def test_classifier_of_all_pairs_takes_few_passes(spark, monkeypatch):
    from graphrecon.operators import training

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(rng.normal(size=(500, 8)))]
    cells = all_pair_cells(spark.createDataFrame(rows, "id long, vec array<double>"), 0.2, 2, "holdout", 0.2)
    passes, summed = [], training._summed
    monkeypatch.setattr(training, "_summed", lambda *given: passes.append(1) or summed(*given))
    monkeypatch.setattr(training, "PILOT_PAIRS", 8000, raising=False)
    found = train_all_pairs(cells)
    assert len(passes) < 9
    monkeypatch.setattr(training, "PILOT_PAIRS", 400, raising=False)  # another start, the same end
    other = train_all_pairs(cells, max_iter=100, tol=1e-9)
    assert np.allclose(found.coefficients, other.coefficients, rtol=0.02, atol=0.02)


def test_chosen_pairs_of_long_ids(spark):
    ids = ["a" * n + str(n) for n in (1, 20, 21, 22, 23, 24, 50, 120)]
    chosen = chosen_pairs(3, "cut", ids[:5], ids[3:], 0.5)
    rows = spark.createDataFrame([(a, b) for a in ids[:5] for b in ids[3:]], "a string, b string")
    key = order_key(3, "cut", F.least("a", "b"), F.greatest("a", "b"))
    want = [r[0] for r in rows.select(key < int(0.5 * 2**60)).collect()]
    assert chosen.ravel().tolist() == want


def test_edges_of_large_tables_meet_in_larger_blocks(spark, monkeypatch):
    """A vector is copied once per block, so the copies of a job that keeps few pairs must not grow with 512 rows a block."""
    asked, blocks = [], V.pair_blocks
    monkeypatch.setattr(V, "pair_blocks", lambda rows, id_col, size: asked.append(size) or blocks(rows, id_col, 700))
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(600, 3))  # more than a stripe
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, f array<double>")
    got = {(r["u"], r["v"]): r["f"] for r in V.similarity_blocks(df, ["f"], {"f": 0.999}).collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    cosine = unit @ unit.T
    assert set(got) == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(cosine >= 0.999, 1)))}
    assert all(abs(x - cosine[u, v]) < 1e-12 for (u, v), x in got.items())
    assert asked == [4096]
