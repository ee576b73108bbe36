"""Ranking reports, metric series and written result files."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphrecon.catalog import tables as T
from graphrecon.catalog.registry import query
from graphrecon.functions import parsing as X
from graphrecon.functions.keys import rounded
from graphrecon.operators import curves as C
from graphrecon.operators import ranking as R
from graphrecon.plans import topology as P
from graphrecon.sources import runlogs as L
from graphrecon.sources import sinks as K
from graphrecon.catalog.topology import _DETAIL_SQL, _MMD_SQL

# Brands as models, return flags as strategies. Sums of whole cents keep the means exact.
_METRICS = {
    "graph_sim": "sum(round(l_discount*100)::BIGINT)::DOUBLE/count(*)/10.0::DOUBLE",
    "relative_density": "sum(round(l_quantity)::BIGINT)::DOUBLE/count(*)/25.0::DOUBLE",
    "deg_dist_mmd": "sum(round(l_tax*100)::BIGINT)::DOUBLE/count(*)/8.0::DOUBLE",
    "cc_mmd": "sum(round(l_extendedprice*100)::BIGINT)::DOUBLE/count(*)/10000000.0::DOUBLE",
    "laplacian_eigen_mmd": "max(l_quantity)::DOUBLE/count(*)",
}
_FLAGS = {"A": "BFS", "N": "DFS", "R": "RANDOM_WALK"}
_MODEL_SQL = f"""
long AS (SELECT p_brand AS model, l_returnflag AS flag, {", ".join(f"{e} AS {n}" for n, e in _METRICS.items())}
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
wide AS (SELECT model, {", ".join(
    f"max(CASE WHEN flag='{f}' THEN {m} END) AS {R.STRATEGY_PREFIX[s]}_{c}"
    for f, s in _FLAGS.items() for m, c in R.METRIC_SUFFIX.items())} FROM long GROUP BY model)
"""


def _models(spark, sf):
    """Five metrics per brand and strategy, from all order lines."""
    lines = T.table(spark, sf, "lineitem").join(
        T.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey"
    )
    n = F.count(F.lit(1))

    def mean(column, scale, by):
        return F.sum(F.round(F.col(column) * scale).cast("bigint")).cast("double") / n / by

    flag = F.col("l_returnflag")
    strategy = F.when(flag == "A", "BFS").when(flag == "N", "DFS").otherwise("RANDOM_WALK")
    return lines.groupBy(
        F.lit("brand").alias("category"), F.col("p_brand").alias("model"), strategy.alias("strategy")
    ).agg(
        mean("l_discount", 100, 10.0).alias("graph_sim"),
        mean("l_quantity", 1, 25.0).alias("relative_density"),
        mean("l_tax", 100, 8.0).alias("deg_dist_mmd"),
        mean("l_extendedprice", 100, 1e7).alias("cc_mmd"),
        (F.max("l_quantity") / n).alias("laplacian_eigen_mmd"),
    )


def _wide(spark, sf):
    return R.flatten_metrics(_models(spark, sf))


@query("l1_flatten_metrics", f"WITH {_MODEL_SQL} SELECT 'brand' AS category, * FROM wide")
def l1(spark, sf):
    return _wide(spark, sf)


_RANK_SQL = f"""{_MODEL_SQL},
tall AS (UNPIVOT wide ON {", ".join(R.METRIC_COLUMNS)} INTO NAME metric VALUE value),
scores AS (SELECT model, metric, value, CASE WHEN metric LIKE '%graph_sim' THEN -value
  WHEN metric LIKE '%relative_density' THEN abs(value-1) ELSE value END AS score FROM tall),
ranks AS (SELECT model, metric, value, rank() OVER (PARTITION BY metric ORDER BY score) AS rank FROM scores),
means AS (SELECT model, sum(rank)::DOUBLE/15 AS avg_rank_score FROM ranks GROUP BY model),
final AS (SELECT model, avg_rank_score, rank() OVER (ORDER BY avg_rank_score) AS avg_rank FROM means)
"""


@query("w1_competition_rank", f"WITH {_RANK_SQL} SELECT model, metric, value, rank::INT AS rank FROM ranks")
def w1(spark, sf):
    return R.metric_ranks(_wide(spark, sf))


@query(
    "w2_average_rank",
    f"WITH {_RANK_SQL} SELECT model, round(avg_rank_score,6) AS avg_rank_score, avg_rank::INT AS avg_rank FROM final",
)
def w2(spark, sf):
    table = R.comparison_table(_wide(spark, sf))
    return table.select("model", rounded(F.col("avg_rank_score")).alias("avg_rank_score"), "avg_rank")


@query(
    "l2_comparison_table",
    f"WITH {_RANK_SQL} SELECT 'brand' AS category, wide.*, avg_rank_score, avg_rank::INT AS avg_rank "
    "FROM wide JOIN final USING (model)",
)
def l2(spark, sf):
    wide = _wide(spark, sf)
    R.require_unique_models(wide)
    return R.comparison_table(wide)


@query(
    "u5_baselines_and_model",
    f"WITH {_MODEL_SQL} SELECT 'brand' AS category, * FROM wide UNION ALL SELECT 'all', 'all brands', "
    + ", ".join(f"max({c})" for c in R.METRIC_COLUMNS) + " FROM wide",
)
def u5(spark, sf):
    wide = _wide(spark, sf)
    best = wide.agg(*[F.max(c).alias(c) for c in R.METRIC_COLUMNS]).select(
        F.lit("all").alias("category"), F.lit("all brands").alias("model"), *R.METRIC_COLUMNS
    )
    return R.with_own_rows(wide, best)


@query(
    "k6_report_markdown",
    f"""WITH {_RANK_SQL} SELECT '| brand | '||wide.model||' | '||{"||' | '||".join(
        f"printf('%.4f', {c})" for c in R.METRIC_COLUMNS)}||' | '||avg_rank||' |' AS line
FROM wide JOIN final USING (model)""",
)
def k6(spark, sf):
    """The report as CSV and Markdown; the Markdown body read back."""
    _, markdown = K.write_report(R.comparison_table(_wide(spark, sf)), T.scratch(spark), "brands")
    lines = spark.read.text(markdown).withColumnRenamed("value", "line")
    return lines.filter(F.col("line").startswith("| brand"))


@query("s10_baseline_file", f"WITH {_MODEL_SQL} SELECT 'brand' AS category, model, "
       "CASE flag WHEN 'A' THEN 'BFS' WHEN 'N' THEN 'DFS' ELSE 'RANDOM_WALK' END AS strategy, "
       + ", ".join(_METRICS) + " FROM long")
def s10(spark, sf):
    """Baselines written as one JSON document (a row per model) and loaded again."""
    folder = T.scratch(spark)
    metrics = F.struct(*_METRICS)
    per_model = _models(spark, sf).groupBy("category", "model").agg(
        F.map_from_entries(F.collect_list(F.struct("strategy", metrics))).alias("metrics")
    )
    document = per_model.agg(F.collect_list(F.struct("category", "model", "metrics")).alias("rows"))
    document.coalesce(1).write.json(folder)
    return L.read_baselines(spark, folder)


# ---- series ----------------------------------------------------------------------------------


@query(
    "w3_early_stopping",
    f"""WITH {T.SERIES_SQL}, m AS (SELECT *, (value > max(value) OVER (PARTITION BY run ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS better,
  max(value) OVER (PARTITION BY run ORDER BY epoch) AS best FROM series),
i AS (SELECT *, coalesce(better, true)::INT AS improved FROM m),
s AS (SELECT *, sum(improved) OVER (PARTITION BY run ORDER BY epoch) AS streak FROM i)
SELECT run, epoch, improved, best, (count(*) OVER (PARTITION BY run, streak ORDER BY epoch) - 1)::BIGINT AS no_improve,
  (count(*) OVER (PARTITION BY run, streak ORDER BY epoch) - 1 >= 5)::INT AS should_stop FROM s""",
)
def w3(spark, sf):
    rows = C.early_stopping(T.daily_series(spark, sf), patience=5)
    return rows.select("run", "epoch", "improved", "best", "no_improve", "should_stop")


@query(
    "w4_ema_normalisation",
    f"""WITH RECURSIVE {T.SERIES_SQL},
o AS (SELECT run, epoch, value, row_number() OVER (PARTITION BY run ORDER BY epoch) AS k FROM series),
r AS (SELECT run, epoch, k, value, greatest(value, 1e-8) AS ema FROM o WHERE k = 1
  UNION ALL SELECT o.run, o.epoch, o.k, o.value,
    greatest(0.95::DOUBLE*r.ema + (1.0::DOUBLE-0.95::DOUBLE)*o.value, 1e-8) FROM o JOIN r ON o.run=r.run AND o.k=r.k+1)
SELECT run, epoch, round(ema,6) AS ema, round(least(value/ema, 5.0),6) AS normalized FROM r""",
)
def w4(spark, sf):
    rows = C.ema_normalized(T.daily_series(spark, sf).select("run", "epoch", "value"))
    return rows.select(
        "run", "epoch", rounded(F.col("ema")).alias("ema"), rounded(F.col("normalized")).alias("normalized")
    )


@query(
    "w9_best_epoch",
    f"""WITH {T.SERIES_SQL} SELECT run, epoch AS best_epoch, value AS best_value FROM
  (SELECT *, row_number() OVER (PARTITION BY run ORDER BY value DESC, epoch) AS r FROM series) WHERE r = 1""",
)
def w9(spark, sf):
    return C.best_epoch(T.daily_series(spark, sf))


def _steps(spark, sf):
    """Step table per user: the day's mean as text, blank on days with a single event."""
    day = F.date_format("ts", "yyyyMMdd").cast("int")
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    n = F.count(F.lit(1))
    return T.table(spark, sf, "events").groupBy("user_id", day.alias("epoch")).agg(
        F.when(n > 1, (cents / n / 100.0).cast("string")).otherwise("").alias("VAL AUPRC")
    )


_STEP_SQL = """
steps AS (SELECT user_id, strftime(ts, '%Y%m%d')::INT AS epoch, count(*) AS n,
  sum(round(value*100)::BIGINT)::DOUBLE/count(*)/100.0::DOUBLE AS value FROM events GROUP BY 1, 2),
history AS (SELECT user_id, epoch, value FROM steps WHERE n > 1)
"""


@query("l3_objective_history", f"WITH {_STEP_SQL} SELECT user_id, epoch, value FROM history")
def l3(spark, sf):
    return L.objective_history(_steps(spark, sf), "Val auprc", ["user_id"], "epoch")


def _trials(spark, sf):
    history = L.objective_history(_steps(spark, sf), "Val auprc", ["user_id"], "epoch")
    named = history.select(
        C.trial_run_id(F.lit("hpo"), F.col("user_id")).alias("run_id"), "value"
    )
    trials = T.table(spark, sf, "events").groupBy(F.col("user_id").alias("trial_number")).agg(
        F.when(F.max("event_type") == "view", "COMPLETE").otherwise("PRUNED").alias("state"),
        F.map_from_arrays(
            F.array(F.lit("errors"), F.lit("clicks")),
            F.array(
                F.sum((F.col("event_type") == "error").cast("int")),
                F.sum((F.col("event_type") == "click").cast("int")),
            ),
        ).alias("params"),
    )
    return C.trial_table(trials, named, "maximize", "hpo")


_TRIAL_SQL = f"""{_STEP_SQL},
best AS (SELECT user_id, max(value) AS value FROM history GROUP BY 1),
trials AS (SELECT user_id AS trial_number, CASE WHEN max(event_type) = 'view' THEN 'COMPLETE' ELSE 'PRUNED' END AS state,
  'hpo_t'||CASE WHEN user_id < 10000 THEN lpad(user_id::VARCHAR, 4, '0') ELSE user_id::VARCHAR END AS run_id,
  sum((event_type='error')::INT) AS errors, sum((event_type='click')::INT) AS clicks FROM events GROUP BY user_id)
"""


@query(
    "l4_trial_table",
    f"WITH {_TRIAL_SQL} SELECT trial_number, state, run_id, value FROM trials LEFT JOIN best ON user_id = trial_number",
)
def l4(spark, sf):
    return _trials(spark, sf).select("trial_number", "state", "run_id", "value")


@query(
    "a15_trial_roll_up",
    f"""WITH {_TRIAL_SQL} SELECT state, count(*) AS trials, max(value) AS best, min(value) AS worst,
  arg_max(trial_number, value) AS best_trial FROM trials LEFT JOIN best ON user_id = trial_number GROUP BY state""",
)
def a15(spark, sf):
    return _trials(spark, sf).groupBy("state").agg(
        F.count(F.lit(1)).alias("trials"),
        C.objective(F.col("value"), "maximize").alias("best"),
        C.objective(F.col("value"), "minimize").alias("worst"),
        F.max_by("trial_number", "value").alias("best_trial"),
    )


@query(
    "k8_trials_csv",
    f"""WITH {_TRIAL_SQL} SELECT trial_number, state, coalesce(printf('%.8f', value), '') AS value, run_id,
  '{{"clicks":'||clicks||',"errors":'||errors||'}}' AS params_json
FROM trials LEFT JOIN best ON user_id = trial_number""",
)
def k8(spark, sf):
    folder = T.scratch(spark)
    K.write_trials(_trials(spark, sf), folder)
    rows = spark.read.csv(folder, header=True, escape='"').withColumn(
        "trial_number", F.col("trial_number").cast("bigint")
    )
    return rows.fillna("", ["value"])


@query(
    "p17_metric_header",
    "SELECT event_id, 'Val '||CASE event_type WHEN 'click' THEN 'click' ELSE event_type||'_x' END AS header FROM events",
)
def p17(spark, sf):
    kind = F.col("event_type")
    name = F.when(kind == "click", F.lit(" Val_Click")).otherwise(F.concat(kind, F.lit(" X ")))
    return T.table(spark, sf, "events").select("event_id", X.metric_header(name).alias("header"))


@query(
    "l5_training_curve",
    f"""WITH {T.SERIES_SQL} SELECT run, epoch AS "Epoch", n AS "Epoch Time", value AS "Val auprc" FROM series""",
)
def l5(spark, sf):
    """Columns of a training log in their configured order."""
    named = {"epoch": "Epoch", "n": "Epoch Time", "value": "Val auprc"}
    return C.log_columns(T.daily_series(spark, sf), named, ["run"])


@query(
    "l6_evaluation_row",
    f"""WITH {T.SCORED_SQL}, c AS (SELECT sum((label=1 AND prob>=0.5)::INT)::DOUBLE AS tp, sum((label=0 AND prob>=0.5)::INT)::DOUBLE AS fp,
  sum((label=1 AND prob<0.5)::INT)::DOUBLE AS fn, sum((label=0 AND prob<0.5)::INT)::DOUBLE AS tn FROM scored),
m AS (SELECT prob, sum(label)::DOUBLE AS pos, sum(1-label)::DOUBLE AS neg FROM scored GROUP BY prob),
k AS (SELECT *, sum(pos) OVER w AS pu, sum(neg) OVER w AS nu, sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM m WINDOW w AS (ORDER BY prob DESC)),
r AS (SELECT sum(neg*(pu-pos/2))/(max(p)*max(n)) AS auroc, sum(pos*pu/(pu+nu))/max(p) AS auprc FROM k)
SELECT 'test' AS split, round(auroc,6) AS auroc, round(auprc,6) AS auprc, round((tp+tn)/(tp+fp+fn+tn),6) AS accuracy,
  round(tp/(tp+fn),6) AS sensitivity, round(tn/(tn+fp),6) AS specificity, round(tp/(tp+fp),6) AS precision,
  round(tp/(tp+fn),6) AS recall, round(2*tp/(2*tp+fp+fn),6) AS f1,
  round((tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)),6) AS mcc FROM c, r""",
)
def l6(spark, sf):
    from graphrecon.operators.classify import METRICS, evaluate

    row = evaluate(T.scored_lines(spark, sf), METRICS)
    return row.select(F.lit("test").alias("split"), *[rounded(F.col(m)).alias(m) for m in METRICS])


@query(
    "a9_mean_over_subgraphs",
    f"""WITH {T.SCORED_SQL} SELECT round(avg(total),6) AS mean_loss, count(*) AS subgraphs FROM (SELECT l_orderkey,
  sum((1-label)*logit + ln(1+exp(-abs(logit))) + greatest(-logit, 0)) AS total FROM scored GROUP BY l_orderkey)""",
)
def a9(spark, sf):
    """Loss per order (a subgraph), then the mean over the orders."""
    from graphrecon.functions.scoring import logit_loss

    loss = logit_loss(F.col("logit"), F.col("label"))
    rows = C.mean_over_groups(T.scored_lines(spark, sf), loss, ["l_orderkey"])
    return rows.select(rounded(F.col("mean")).alias("mean_loss"), F.col("groups").alias("subgraphs"))


# ---- written files ---------------------------------------------------------------------------


@query(
    "k1_pair_file",
    f"WITH {T.TRADE_SQL} SELECT e.u, e.v, (k.u IS NOT NULL)::INT AS label FROM edges e LEFT JOIN kept k ON e.u=k.u AND e.v=k.v",
)
def k1(spark, sf):
    from graphrecon.operators.pairs import label_by_edges
    from graphrecon.sources.pairs import read_pairs

    folder = T.scratch(spark)
    rows = label_by_edges(T.trade_edges(spark, sf), T.trade_edges(spark, sf, kept_only=True))
    K.write_pairs(rows, folder)
    return read_pairs(spark, folder).select(F.col("a").alias("u"), F.col("b").alias("v"), "label")


@query(
    "k2_prediction_file",
    f"WITH {T.SCORED_SQL} SELECT a, b, (prob >= 0.5)::INT AS label, count(*) AS lines FROM scored GROUP BY ALL",
)
def k2(spark, sf):
    from graphrecon.catalog.pairs import _shards
    from graphrecon.session import materialize
    from graphrecon.sources.pairs import read_pairs

    folder = T.scratch(spark)
    rows = materialize(_shards(spark, sf))
    K.write_predictions(rows.select("pair_index", "a", "b"), rows.select("pair_index", "pred"), folder)
    return read_pairs(spark, folder).groupBy("a", "b", "label").agg(F.count(F.lit(1)).alias("lines"))


_MMDS = ("deg_dist_mmd", "cc_mmd")  # the spectral one, which SQL has no eigenvalues for, is in a test


def _result(spark, sf):
    """Details, per-size and summary rows with the discrepancies; the spectral one stays NULL."""
    nodes, true, pred = T.vector_graphs(spark, sf)
    result = P.evaluate_graph(nodes, true, pred, T.vector_samples(spark, sf), spectral=False, pred_nodes=nodes)
    return result.details, result.per_size, result.summary


_TOPO = f"""WITH {_MMD_SQL}, {_DETAIL_SQL.split(T.INDUCED_SQL + ",")[1]},
wide AS (SELECT node_size, max(mmd) FILTER (metric = 'degree') AS dm, max(mmd) FILTER (metric = 'clustering') AS cm
  FROM mmds GROUP BY node_size),
g AS (SELECT 'node_size' AS scope, node_size::VARCHAR AS node_size, count(*) AS graph_count, avg(gs) AS gs, avg(rd) AS rd,
    max(dm) AS dm, max(cm) AS cm FROM details JOIN wide USING (node_size) GROUP BY node_size
  UNION ALL SELECT 'summary', 'all', count(*), avg(gs), avg(rd), (SELECT avg(dm) FROM wide), (SELECT avg(cm) FROM wide) FROM details)"""
_FOUR = "round(gs,6) AS graph_sim, round(rd,6) AS relative_density, round(dm,6) AS deg_dist_mmd, round(cm,6) AS cc_mmd"
_NAMES = ("graph_sim", "relative_density", *_MMDS)


@query("k3_topology_csv", _TOPO + f" SELECT scope, node_size, graph_count, {_FOUR} FROM g")
def k3(spark, sf):
    folder = T.scratch(spark)
    _, per_size, summary = _result(spark, sf)
    K.write_topology_csv(per_size, summary, folder)
    rows = spark.read.csv(folder, header=True)
    return rows.select("scope", "node_size", F.col("graph_count").cast("bigint"), *[rounded(F.col(n)).alias(n) for n in _NAMES])


@query(
    "k4_topology_json",
    _TOPO + f" SELECT node_size, graph_count, {_FOUR} FROM g WHERE scope = 'node_size'",
)
def k4(spark, sf):
    folder = T.scratch(spark)
    K.write_topology_json(*_result(spark, sf), folder)
    fields = ",".join(f"{n}:double" for n in _NAMES)
    return (
        spark.read.schema(f"per_node_size map<string,struct<graph_count:bigint,{fields}>>")
        .json(folder)
        .select(F.explode("per_node_size").alias("node_size", "v"))
        .select("node_size", F.col("v.graph_count"), *[rounded(F.col(f"v.{n}")).alias(n) for n in _NAMES])
    )


@query(
    "k4_s13_metric_files",
    _TOPO
    + f""" SELECT s AS strategy, graph_count, {_FOUR}
FROM g, (VALUES ('BFS'), ('DFS'), ('RANDOM_WALK')) t(s) WHERE scope = 'summary'""",
)
def k4_s13(spark, sf):
    """Metric files of three runs written, and the newest of each strategy read back."""
    folder, result = T.scratch(spark), _result(spark, sf)
    for strategy in ("bfs", "dfs", "random_walk"):
        run = {"model": "m", "run_id": strategy, "species": "human", "split_strategy": strategy, "decision_threshold": 0.5}
        K.write_topology_json(*result, f"{folder}/{strategy}/topology_metrics.json", run)
    rows = L.read_latest_metrics(spark, folder)
    return rows.select("strategy", F.col("payload.graph_count"), *[rounded(F.col(f"payload.{n}")).alias(n) for n in _NAMES])


@query(
    "k5_details_table",
    _TOPO + """ SELECT node_size, sample_id, round(gs,6) AS graph_sim, round(rd,6) AS relative_density,
  round(wide.dm,6) AS deg_dist_mmd, round(wide.cm,6) AS cc_mmd FROM details JOIN wide USING (node_size)""",
)
def k5(spark, sf):
    """Every sample's values and, beside them, the discrepancies of its size."""
    folder = T.scratch(spark)
    details, per_size, _ = _result(spark, sf)
    K.write_details(details, folder, per_size)
    return spark.read.parquet(folder).select("node_size", "sample_id", *[rounded(F.col(n)).alias(n) for n in _NAMES])


@query(
    "k7_appended_steps",
    f"""WITH {T.SERIES_SQL} SELECT run AS run_id, epoch, value, CASE WHEN run = 'click' THEN NULL ELSE n::DOUBLE END AS n FROM series""",
)
def k7(spark, sf):
    """Rows of the runs appended one after the other; only some runs have the count column."""
    folder = T.scratch(spark)
    series = T.daily_series(spark, sf).withColumnRenamed("run", "run_id")
    K.append_rows(series.filter("run_id = 'click'").drop("n"), folder)
    K.append_rows(series.filter("run_id <> 'click'"), folder)
    rows = K.read_appended(spark, folder)
    return rows.select("run_id", "epoch", "value", F.col("n").cast("double").alias("n"))


@query(
    "k9_build_once",
    f"WITH {T.TRADE_SQL} SELECT 'train' AS split, count(*) AS pairs, 1 AS first, 0 AS second FROM kept",
)
def k9(spark, sf):
    folder = T.scratch(spark)
    outputs = {"train": f"{folder}/train"}

    def build():
        rows = T.trade_edges(spark, sf, kept_only=True)
        return rows.select(F.lit("train").alias("split"), "u", "v", F.lit(1).alias("label"))

    first = K.ensure_splits(spark, outputs, build)
    second = K.ensure_splits(spark, outputs, build)
    rows = spark.read.text(outputs["train"])
    return rows.agg(
        F.lit("train").alias("split"),
        F.count(F.lit(1)).alias("pairs"),
        F.lit(int(first)).alias("first"),
        F.lit(int(second)).alias("second"),
    )


@query(
    "k10_vector_store",
    "SELECT vec_id AS id, len(embedding)::INT AS size, round(list_sum(embedding::DOUBLE[]),6) AS total FROM embeddings",
)
def k10(spark, sf):
    folder = T.scratch(spark)
    store = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    K.write_vectors(store, {"source": "driver", "input_dim": 64}, folder)
    rows, meta = K.read_vectors(spark, folder)
    if meta != {"source": "driver", "input_dim": "64"}:
        raise ValueError(f"metadata changed: {meta}")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("id", F.size("embedding").alias("size"), rounded(total).alias("total"))
