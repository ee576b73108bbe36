"""Graph comparison on the vector graph: all vectors, cut into samples of 20 and of 40 nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphrecon.catalog import tables as T
from graphrecon.catalog.registry import query
from graphrecon.functions.keys import rounded
from graphrecon.operators import compare as C
from graphrecon.operators import graph as G
from graphrecon.operators import soft as S
from graphrecon.plans import topology as P
from graphrecon.session import materialize

# Similarity and density per sample; every vector is a node of both graphs.
_DETAIL_SQL = f"""{T.INDUCED_SQL},
sizes AS (SELECT node_size, sample_id, count(*) AS n FROM samples GROUP BY 1, 2),
sums AS (SELECT node_size, sample_id, sum(t)::DOUBLE AS st, sum(p)::DOUBLE AS sp, sum(abs(t-p))::DOUBLE AS sd
  FROM marked GROUP BY 1, 2),
details AS (SELECT node_size, sample_id, n,
  CASE WHEN coalesce(st+sp,0) <= 0 THEN 1.0::DOUBLE ELSE 1 - sd/(st+sp) END AS gs,
  CASE WHEN coalesce(st,0) > 0 THEN sp/st WHEN coalesce(sp,0) > 0 THEN 'inf'::DOUBLE ELSE 1.0::DOUBLE END AS rd
  FROM sizes LEFT JOIN sums USING (node_size, sample_id))
"""


def _sampled(spark, sf):
    """Samples, and written-down nodes and edges of both graphs inside them."""
    nodes, true, pred = T.vector_graphs(spark, sf)
    samples = T.vector_samples(spark, sf)
    edges = materialize(P.sample_graphs(samples, true, pred))
    return P.sample_nodes(samples, nodes, nodes), edges


def _details(spark, sf):
    return P.overlap_details(*_sampled(spark, sf))


@query(
    "g6_graph_similarity",
    f"WITH {_DETAIL_SQL} SELECT node_size, sample_id, round(gs,6) AS graph_sim FROM details",
)
def g6(spark, sf):
    return _details(spark, sf).select(
        "node_size", "sample_id", rounded(F.col("graph_sim")).alias("graph_sim")
    )


@query(
    "g7_relative_density",
    f"WITH {_DETAIL_SQL} SELECT node_size, sample_id, round(rd,6) AS relative_density FROM details",
)
def g7(spark, sf):
    return _details(spark, sf).select(
        "node_size", "sample_id", rounded(F.col("relative_density")).alias("relative_density")
    )


# Histograms per side, and the discrepancies made from them.
_SIDES = """
sided AS (SELECT 'true' AS side, node_size, sample_id, u, v FROM marked WHERE t = 1
  UNION ALL SELECT 'pred', node_size, sample_id, u, v FROM marked WHERE p = 1),
ends AS (SELECT side, node_size, sample_id, unnest([u,v]) AS id FROM sided),
sdeg AS (SELECT s.side, s.node_size, s.sample_id, s.id, count(e.id) AS degree
  FROM (SELECT 'true' AS side, * FROM samples UNION ALL SELECT 'pred', * FROM samples) s
  LEFT JOIN ends e ON e.side=s.side AND e.node_size=s.node_size AND e.sample_id=s.sample_id AND e.id=s.id
  GROUP BY 1,2,3,4),
dhist AS (SELECT 'degree' AS metric, side, node_size, sample_id, degree::INT AS bin, count(*)::DOUBLE AS cnt
  FROM sdeg GROUP BY ALL),
stri AS (SELECT a.side, a.node_size, a.sample_id, a.u AS x, a.v AS y, b.v AS z FROM sided a
  JOIN sided b ON a.side=b.side AND a.node_size=b.node_size AND a.sample_id=b.sample_id AND a.v=b.u
  JOIN sided c ON a.side=c.side AND a.node_size=c.node_size AND a.sample_id=c.sample_id AND c.u=a.u AND c.v=b.v),
st AS (SELECT side, node_size, sample_id, id, count(*) AS t FROM
  (SELECT side, node_size, sample_id, unnest([x,y,z]) AS id FROM stri) GROUP BY ALL),
local AS (SELECT side, node_size, sample_id,
  CASE WHEN degree < 2 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE*coalesce(t,0)/(degree*(degree-1)) END AS clustering
  FROM sdeg LEFT JOIN st USING (side, node_size, sample_id, id)),
craw AS (SELECT *, least(floor(clustering*100), 99) AS r FROM local),
chist AS (SELECT 'clustering' AS metric, side, node_size, sample_id,
  (CASE WHEN clustering < r*0.01::DOUBLE THEN r-1 WHEN clustering >= (r+1)*0.01::DOUBLE AND r < 99 THEN r+1
   ELSE r END)::INT AS bin, count(*)::DOUBLE AS cnt FROM craw GROUP BY ALL),
hist AS (SELECT * FROM dhist UNION ALL SELECT * FROM chist)
"""
_MMD_SQL = f"""{T.INDUCED_SQL}, {_SIDES},
total AS (SELECT metric, side, node_size, sample_id, sum(cnt) + 1e-6::DOUBLE AS s FROM hist GROUP BY ALL),
nh AS (SELECT metric, side, node_size, sample_id, bin, cnt/s AS w FROM hist
  JOIN total USING (metric, side, node_size, sample_id)),
mass AS (SELECT metric, side, node_size, sample_id, sum(w) AS m FROM nh GROUP BY ALL),
common AS (SELECT a.metric, a.node_size, a.side AS sa, a.sample_id AS ia, b.side AS sb, b.sample_id AS ib,
  sum(least(a.w, b.w)) AS c FROM nh a JOIN nh b
  ON a.metric=b.metric AND a.node_size=b.node_size AND a.bin=b.bin GROUP BY ALL),
kern AS (SELECT a.metric, a.node_size, a.side AS side_a, b.side AS side_b,
  exp(-pow((a.m + b.m - 2*coalesce(c,0))/2, 2)/2) AS k
  FROM mass a JOIN mass b ON a.metric=b.metric AND a.node_size=b.node_size
  LEFT JOIN common o ON o.metric=a.metric AND o.node_size=a.node_size AND o.sa=a.side AND o.ia=a.sample_id
    AND o.sb=b.side AND o.ib=b.sample_id),
disc AS (SELECT metric, node_size, side_a, side_b, avg(k) AS d, count(*) AS pairs FROM kern GROUP BY ALL),
mmds AS (SELECT metric, node_size,
  max(CASE WHEN side_a='true' AND side_b='true' THEN d END) + max(CASE WHEN side_a='pred' AND side_b='pred' THEN d END)
  - 2*max(CASE WHEN side_a='true' AND side_b='pred' THEN d END) AS mmd FROM disc GROUP BY ALL)
"""


def _histograms(spark, sf, metric, spectral=False):
    nodes, edges = _sampled(spark, sf)
    return P.histograms(nodes, edges, spectral).filter(F.col("metric") == metric)


@query(
    "g11_kernel_values",
    f"""WITH {_MMD_SQL}, met AS (SELECT a.metric, a.node_size, a.sample_id, a.m AS ma, b.m AS mb FROM mass a
  JOIN mass b USING (metric, node_size, sample_id) WHERE a.side='true' AND b.side='pred' AND metric='degree')
SELECT met.node_size, met.sample_id, round(exp(-pow((ma + mb - 2*coalesce(c,0))/2, 2)/2),6) AS kernel
FROM met LEFT JOIN common o ON o.metric=met.metric AND o.node_size=met.node_size AND o.sa='true'
  AND o.ia=met.sample_id AND o.sb='pred' AND o.ib=met.sample_id""",
)
def g11(spark, sf):
    """Kernel expression over dense arrays: true against predicted degrees of each sample."""
    hists = _histograms(spark, sf, "degree")
    width = max(T.SAMPLE_SIZES)
    total = F.aggregate("hist", F.lit(0.0), lambda s, h: s + h["cnt"]) + 1e-6
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda b: F.aggregate(
            F.filter("hist", lambda h: h["bin"] == b), F.lit(0.0), lambda s, h: s + h["cnt"]
        )
        / total,
    )
    rows = hists.groupBy("node_size", "sample_id").agg(
        F.max(F.when(F.col("side") == "true", dense)).alias("xa"),
        F.max(F.when(F.col("side") == "pred", dense)).alias("xb"),
    )
    kernel = C.gaussian_tv(F.col("xa"), F.col("xb"))
    return rows.select("node_size", "sample_id", rounded(kernel).alias("kernel"))


@query(
    "g12_discrepancy",
    f"""WITH {_MMD_SQL} SELECT metric, node_size, side_a, side_b, pairs, round(d,6) AS disc FROM disc""",
)
def g12(spark, sf):
    nodes, edges = _sampled(spark, sf)
    sums = C.kernel_sums(P.histograms(nodes, edges, spectral=False), ["metric", "node_size"])
    return sums.select(
        "metric",
        "node_size",
        "side_a",
        "side_b",
        "pairs",
        rounded(F.col("total") / F.col("pairs")).alias("disc"),
    )


def _mmd(spark, sf, metric, spectral=False):
    keys = ["metric", "node_size"]
    found = C.mmd(C.kernel_sums(_histograms(spark, sf, metric, spectral), keys), keys)
    return found.select("node_size", rounded(F.col("mmd")).alias("mmd"))


def _mmd_sql(metric):
    return f"WITH {_MMD_SQL} SELECT node_size, round(mmd,6) AS mmd FROM mmds WHERE metric = '{metric}'"


@query("g14_degree_mmd", _mmd_sql("degree"))
def g14(spark, sf):
    return _mmd(spark, sf, "degree")


@query("g15_clustering_mmd", _mmd_sql("clustering"))
def g15(spark, sf):
    return _mmd(spark, sf, "clustering")


@query("g10_spectral_histogram")
def g10(spark, sf):
    nodes, edges = _sampled(spark, sf)
    rows = C.spectral_histogram(
        P.side_nodes(nodes, padded=False), edges, ["side", "node_size", "sample_id"]
    )
    return rows.select("side", "node_size", "sample_id", F.explode("hist").alias("h")).select(
        "side", "node_size", "sample_id", "h.bin", rounded(F.col("h.cnt")).alias("share")
    )


_LAPLACIAN_SQL = f"""WITH {T.INDUCED_SQL}, {_SIDES},
inv AS (SELECT e.side, e.node_size, e.sample_id, sum(1.0::DOUBLE/(a.degree*b.degree)) AS t FROM sided e
  JOIN sdeg a ON a.side=e.side AND a.node_size=e.node_size AND a.sample_id=e.sample_id AND a.id=e.u
  JOIN sdeg b ON b.side=e.side AND b.node_size=e.node_size AND b.sample_id=e.sample_id AND b.id=e.v GROUP BY ALL),
moments AS (SELECT side, node_size, sample_id, sum((degree > 0)::INT)::DOUBLE AS m1 FROM sdeg GROUP BY ALL)
SELECT side, node_size, sample_id, round(m1,6) AS eigen_sum, round(m1 + 2*coalesce(t,0),6) AS eigen_squares,
  round(m1,6) AS trace, round(m1 + 2*coalesce(t,0),6) AS trace_squared
FROM moments LEFT JOIN inv USING (side, node_size, sample_id)"""


@query("g10_spectral_moments", _LAPLACIAN_SQL)
def g10_moments(spark, sf):
    """Sums of the eigenvalues and of their squares, beside the same traces by sparse products."""
    nodes, edges = _sampled(spark, sf)
    keys, sides = ["side", "node_size", "sample_id"], P.side_nodes(nodes, padded=False)
    solved = C.spectra(sides, edges, keys)
    total = F.aggregate("eigenvalues", F.lit(0.0), lambda s, x: s + x)
    squares = F.aggregate("eigenvalues", F.lit(0.0), lambda s, x: s + x * x)
    sums = solved.select(*keys, rounded(total).alias("eigen_sum"), rounded(squares).alias("eigen_squares"))
    traces = C.laplacian_traces(sides, edges, keys)
    return sums.join(traces, keys).select(
        *sums.columns, rounded(F.col("trace")).alias("trace"), rounded(F.col("trace_squared")).alias("trace_squared")
    )


@query("g16_spectral_mmd")
def g16(spark, sf):
    return _mmd(spark, sf, "spectral", spectral=True)


@query(
    "g13_g17_per_size",
    f"""WITH {_MMD_SQL}, {_DETAIL_SQL.split(T.INDUCED_SQL + ",")[1]}
SELECT node_size, count(*) AS graph_count, round(avg(gs),6) AS graph_sim, round(avg(rd),6) AS relative_density,
  (SELECT round(mmd,6) FROM mmds m WHERE m.node_size=d.node_size AND metric='degree') AS deg_dist_mmd,
  (SELECT round(mmd,6) FROM mmds m WHERE m.node_size=d.node_size AND metric='clustering') AS cc_mmd
FROM details d GROUP BY node_size""",
)
def g17(spark, sf):
    nodes, true, pred = T.vector_graphs(spark, sf)
    result = P.evaluate_graph(
        nodes, true, pred, T.vector_samples(spark, sf), spectral=False, pred_nodes=nodes
    )
    names = ("graph_sim", "relative_density", "deg_dist_mmd", "cc_mmd")
    return result.per_size.select(
        "node_size", "graph_count", *[rounded(F.col(n)).alias(n) for n in names]
    )


@query(
    "g18_topology_summary",
    f"""WITH {_MMD_SQL}, {_DETAIL_SQL.split(T.INDUCED_SQL + ",")[1]}
SELECT count(*) AS graph_count, round(avg(gs),6) AS graph_sim, round(avg(rd),6) AS relative_density,
  (SELECT round(avg(mmd),6) FROM mmds WHERE metric='degree') AS deg_dist_mmd,
  (SELECT round(avg(mmd),6) FROM mmds WHERE metric='clustering') AS cc_mmd FROM details""",
)
def g18(spark, sf):
    """Flagship: score the pairs inside samples of the whole table, rebuild the graph there, and judge it."""
    nodes, true, pred = T.vector_graphs(spark, sf)
    result = P.evaluate_graph(
        nodes, true, pred, T.vector_samples(spark, sf), spectral=False, pred_nodes=nodes
    )
    names = ("graph_sim", "relative_density", "deg_dist_mmd", "cc_mmd")
    return result.summary.select("graph_count", *[rounded(F.col(n)).alias(n) for n in names])


@query("g18_five_metrics")
def g18_five(spark, sf):
    """The flagship with the spectral discrepancy, which SQL has no eigenvalues for."""
    nodes, true, pred = T.vector_graphs(spark, sf)
    result = P.evaluate_graph(nodes, true, pred, T.vector_samples(spark, sf), pred_nodes=nodes)
    names = ("graph_sim", "relative_density", *P.MMD_NAMES.values())
    return result.summary.select("graph_count", *[rounded(F.col(n)).alias(n) for n in names])


@query(
    "a13_summary_levels",
    f"""WITH {_DETAIL_SQL} SELECT coalesce(node_size::VARCHAR, 'all') AS node_size, count(*) AS graph_count,
  round(avg(gs),6) AS graph_sim FROM details GROUP BY GROUPING SETS ((node_size), ())""",
)
def a13(spark, sf):
    per_size, summary = P.roll_up(_details(spark, sf), None)
    sizes = per_size.select(F.col("node_size").cast("string"), "graph_count", "graph_sim")
    rows = sizes.unionByName(summary.select(F.lit("all").alias("node_size"), "graph_count", "graph_sim"))
    return rows.withColumn("graph_sim", rounded(F.col("graph_sim")))


@query(
    "a14_merge_size_shards",
    f"""WITH {_DETAIL_SQL} SELECT count(*) AS graph_count, round(avg(gs),6) AS graph_sim,
  round(avg(rd),6) AS relative_density FROM details""",
)
def a14(spark, sf):
    details = _details(spark, sf)
    shards = []
    for size in T.SAMPLE_SIZES:
        part = details.filter(F.col("node_size") == size)
        per_size, summary = P.roll_up(part, None)
        shards.append(P.TopologyResult(part, per_size, summary))
    merged = P.merge_results(shards).summary
    return merged.select(
        "graph_count",
        rounded(F.col("graph_sim")).alias("graph_sim"),
        rounded(F.col("relative_density")).alias("relative_density"),
    )


# ---- loss terms on probabilities -------------------------------------------------------------

_KEYS = ["node_size", "sample_id"]
_SOFT_SQL = f"""{T.VECTOR_SQL}, {T.SAMPLES_SQL},
sp AS (SELECT a.node_size, a.sample_id, a.id AS a, b.id AS b, prob AS p, label::DOUBLE AS y
  FROM samples a JOIN samples b ON a.node_size=b.node_size AND a.sample_id=b.sample_id AND a.id<b.id
  JOIN vpairs v ON v.u=a.id AND v.v=b.id),
n AS (SELECT node_size, sample_id, count(*) AS n FROM samples GROUP BY 1, 2)
"""


def _soft_inputs(spark, sf):
    """Scored pairs of each sample, and the sample sizes."""
    samples = T.vector_samples(spark, sf)
    rows = T.sample_pairs(spark, sf).select(
        *_KEYS,
        F.col("u").alias("a"),
        F.col("v").alias("b"),
        F.col("prob").alias("p"),
        F.col("label").cast("double").alias("y"),
    )
    return materialize(rows), samples.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"))


@query(
    "g19_soft_similarity",
    f"""WITH {_SOFT_SQL} SELECT node_size, sample_id,
  round(CASE WHEN sum(p)+sum(y) > 1e-8 THEN sum(abs(p-y))/(sum(p)+sum(y)+1e-8::DOUBLE) ELSE 0 END,6) AS loss
FROM sp GROUP BY 1, 2""",
)
def g19(spark, sf):
    pairs, sizes = _soft_inputs(spark, sf)
    terms = S.pair_terms(pairs, sizes, _KEYS)
    return terms.select(*_KEYS, rounded(F.col("graph_similarity")).alias("loss"))


_DENSITY_SQL = f"""{_SOFT_SQL},
dens AS (SELECT node_size, sample_id, 2*sum(p)/max(n*(n-1))::DOUBLE AS dp, 2*sum(y)/max(n*(n-1))::DOUBLE AS dy
  FROM sp JOIN n USING (node_size, sample_id) GROUP BY 1, 2),
ratio AS (SELECT *, ln((dp+1e-8::DOUBLE)/(dy+1e-8::DOUBLE)) AS lr, dp/(dy+1e-8::DOUBLE) - 1 AS off FROM dens),
penalty AS (SELECT node_size, sample_id,
  CASE WHEN dy <= 1e-8 THEN dp*dp ELSE off*off END AS squared_ratio,
  CASE WHEN dy <= 1e-8 THEN dp*dp ELSE lr*lr END AS log_ratio,
  CASE WHEN dy <= 1e-8 THEN dp*dp WHEN abs(lr) < 1 THEN 0.5*lr*lr ELSE abs(lr)-0.5 END AS log_ratio_huber
  FROM ratio)
"""


@query(
    "g20_soft_density",
    f"""WITH {_DENSITY_SQL} SELECT node_size, sample_id, round(squared_ratio,6) AS squared_ratio,
  round(log_ratio,6) AS log_ratio, round(log_ratio_huber,6) AS log_ratio_huber FROM penalty""",
)
def g20(spark, sf):
    pairs, sizes = _soft_inputs(spark, sf)
    rows = None
    for form in S.DENSITY_FORMS:
        terms = S.pair_terms(pairs, sizes, _KEYS, form)
        one = terms.select(*_KEYS, rounded(F.col("relative_density")).alias(form))
        rows = one if rows is None else rows.join(one, _KEYS)
    return rows


def _soft_mmd_sql(values: str, steps: int, width: str, digits: int = 6) -> str:
    """SQL of a soft-histogram MMD over ``vals(node_size, sample_id, pv, yv, last)``."""
    return f"""{values},
bars AS (SELECT node_size, sample_id, k, sum(exp(-0.5*pow((pv - last*k/{steps}.0::DOUBLE)/{width},2))) AS pw,
  sum(exp(-0.5*pow((yv - last*k/{steps}.0::DOUBLE)/{width},2))) AS yw
  FROM vals, range({steps + 1}) r(k) GROUP BY ALL),
tots AS (SELECT node_size, sample_id, sum(pw) AS pt, sum(yw) AS yt FROM bars GROUP BY ALL),
tv AS (SELECT node_size, sample_id, 0.5*sum(abs(pw/(pt+1e-8::DOUBLE)-yw/(yt+1e-8::DOUBLE))) AS tv
  FROM bars JOIN tots USING (node_size, sample_id) GROUP BY ALL)
SELECT node_size, sample_id, round(2-2*exp(-tv*tv/2),{digits}) AS mmd FROM tv"""


_SOFT_DEGREE = f"""WITH {_SOFT_SQL},
vals AS (SELECT node_size, sample_id, id, sum(p) AS pv, sum(y) AS yv, max(greatest(1, n-1))::DOUBLE AS last
  FROM (SELECT node_size, sample_id, unnest([a,b]) AS id, p, y FROM sp)
  JOIN n USING (node_size, sample_id) GROUP BY ALL)"""


@query("g21_soft_degree_mmd", _soft_mmd_sql(_SOFT_DEGREE, 63, "1.0::DOUBLE"))
def g21(spark, sf):
    pairs, sizes = _soft_inputs(spark, sf)
    found = S.degree_mmd(pairs, sizes, _KEYS)
    return found.select(*_KEYS, rounded(F.col("mmd")).alias("mmd"))


_SOFT_CLUSTERING = f"""WITH {_SOFT_SQL},
w AS (SELECT node_size, sample_id, a AS i, b AS j, p, y FROM sp
  UNION ALL SELECT node_size, sample_id, b, a, p, y FROM sp),
d AS (SELECT node_size, sample_id, i, sum(p) AS dp, sum(y) AS dy FROM w GROUP BY ALL),
m AS (SELECT x.node_size, x.sample_id, x.i, sum(x.p*z.p*c.p) AS mp, sum(x.y*z.y*c.y) AS my
  FROM w x JOIN w z ON x.node_size=z.node_size AND x.sample_id=z.sample_id AND z.i=x.j
  JOIN w c ON c.node_size=x.node_size AND c.sample_id=x.sample_id AND c.i=x.i AND c.j=z.j GROUP BY ALL),
vals AS (SELECT node_size, sample_id, i,
  CASE WHEN dp*(dp-1) > 1e-8 THEN least(1,greatest(0,mp/(dp*(dp-1)+1e-8::DOUBLE))) ELSE 0.0::DOUBLE END AS pv,
  CASE WHEN dy*(dy-1) > 1e-8 THEN least(1,greatest(0,my/(dy*(dy-1)+1e-8::DOUBLE))) ELSE 0.0::DOUBLE END AS yv,
  1.0::DOUBLE AS last FROM d JOIN m USING (node_size, sample_id, i))"""


@query("g22_soft_clustering_mmd", _soft_mmd_sql(_SOFT_CLUSTERING, 99, "0.01::DOUBLE"))
def g22(spark, sf):
    pairs, _ = _soft_inputs(spark, sf)
    found = S.clustering_mmd(pairs, _KEYS)
    return found.select(*_KEYS, rounded(F.col("mmd")).alias("mmd"))


@query(
    "g23_validation_penalty",
    f"""WITH {_MMD_SQL}, {_DETAIL_SQL.split(T.INDUCED_SQL + ",")[1]},
s AS (SELECT avg(gs) AS gs, avg(rd) AS rd, (SELECT avg(mmd) FROM mmds WHERE metric='degree') AS dm,
  (SELECT avg(mmd) FROM mmds WHERE metric='clustering') AS cm FROM details)
SELECT round(0.5*(1-gs) + pow(rd-1,2) + 0.3*dm + 0.3*cm,6) AS penalty FROM s""",
)
def g23(spark, sf):
    nodes, true, pred = T.vector_graphs(spark, sf)
    result = P.evaluate_graph(
        nodes, true, pred, T.vector_samples(spark, sf), spectral=False, pred_nodes=nodes
    )
    names = ("graph_sim", "relative_density", "deg_dist_mmd", "cc_mmd")
    penalty = S.validation_penalty(*[F.col(n) for n in names])
    return result.summary.select(rounded(penalty).alias("penalty"))


_LOSSES_SQL = f"""WITH sim AS (WITH {_SOFT_SQL} SELECT node_size, sample_id,
  CASE WHEN sum(p)+sum(y) > 1e-8 THEN sum(abs(p-y))/(sum(p)+sum(y)+1e-8::DOUBLE) ELSE 0 END AS gs
  FROM sp GROUP BY 1, 2),
den AS (WITH {_DENSITY_SQL} SELECT node_size, sample_id, log_ratio_huber AS rd FROM penalty),
dg AS ({_soft_mmd_sql(_SOFT_DEGREE, 63, "1.0::DOUBLE", 15)}),
cl AS ({_soft_mmd_sql(_SOFT_CLUSTERING, 99, "0.01::DOUBLE", 15)})
SELECT node_size, sample_id, round(gs,6) AS graph_similarity, round(rd,6) AS relative_density,
  round(dg.mmd,6) AS degree_mmd, round(cl.mmd,6) AS clustering_mmd,
  round(0.5*gs + rd + 0.3*dg.mmd + 0.3*cl.mmd,6) AS total_topology
FROM sim JOIN den USING (node_size, sample_id) JOIN dg USING (node_size, sample_id)
JOIN cl USING (node_size, sample_id)"""


@query("g23_topology_losses", _LOSSES_SQL)
def g23_losses(spark, sf):
    pairs, sizes = _soft_inputs(spark, sf)
    losses = S.topology_losses(pairs, sizes, _KEYS)
    return losses.select(*_KEYS, *[rounded(F.col(c)).alias(c) for c in losses.columns if c not in _KEYS])


@query(
    "g24_long_adjacency",
    f"""WITH {_SOFT_SQL} SELECT node_size, sample_id, id, round(sum(p),6) AS soft_degree
FROM (SELECT node_size, sample_id, unnest([a,b]) AS id, p FROM sp) GROUP BY ALL""",
)
def g24(spark, sf):
    pairs, _ = _soft_inputs(spark, sf)
    rows = S.soft_degrees(pairs, _KEYS)
    return rows.select(*_KEYS, "id", rounded(F.col("pv")).alias("soft_degree"))
