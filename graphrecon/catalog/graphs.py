"""Graph building, counting and induction, on the whole trade graph and the vector graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphrecon.catalog import tables as T
from graphrecon.catalog.registry import query
from graphrecon.functions.keys import order_key, rounded
from graphrecon.functions.rows import beside
from graphrecon.operators import compare as C
from graphrecon.operators import cover as V
from graphrecon.operators import graph as G
from graphrecon.operators import pairs as P

_TRADE = f"WITH {T.TRADE_SQL} "


@query("g1_reconstruct_graph", _TRADE + "SELECT u, v FROM kept")
def g1(spark, sf):
    lines = T.arcs(spark, sf, kept_only=True).withColumn("pred", F.lit(1))
    return G.reconstruct(lines)


_COMPLETED = """
pnodes AS (SELECT DISTINCT unnest([u,v]) AS id FROM kept),
completed AS (SELECT id FROM pnodes UNION
  SELECT id FROM nodes WHERE (SELECT count(*) FROM nodes) > (SELECT count(*) FROM pnodes))
"""


@query("g2_add_missing_nodes", f"WITH {T.TRADE_SQL}, {_COMPLETED} SELECT id FROM completed")
def g2(spark, sf):
    pred = G.endpoints(T.trade_edges(spark, sf, kept_only=True))
    return G.add_missing_nodes(pred, T.trade_nodes(spark, sf))


def _in_train(column):
    """Random seven tenths of all ids make the training split."""
    return order_key(11, "split", column) < int(0.7 * 2**60)


_SPLIT = f"""
split AS (SELECT id, CASE WHEN {T.hash_sql(11, "split", "id")} < {int(0.7 * 2**60)}
  THEN 'train' ELSE 'test' END AS split FROM nodes),
train AS (SELECT id FROM split WHERE split = 'train'),
labelled AS (SELECT a, b, CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN -1 ELSE 1 END
  AS label FROM arcs),
inside AS (SELECT least(a,b) AS u, greatest(a,b) AS v, label FROM labelled
  WHERE a IN (SELECT id FROM train) AND b IN (SELECT id FROM train))
"""


def node_split(spark, sf):
    split = F.when(_in_train(F.col("id")), "train").otherwise("test")
    return T.trade_nodes(spark, sf).select(split.alias("split"), "id")


def train_nodes(spark, sf):
    return node_split(spark, sf).filter("split = 'train'").select("id")


def labelled_arcs(spark, sf):
    """All links, a return as negative 0, an accepted line as -1, the others as positive."""
    flag = F.col("l_returnflag")
    label = F.when(flag == "R", 0).when(flag == "A", -1).otherwise(1)
    lines = T.table(spark, sf, "lineitem")
    o, p, s = T.order_id(), T.part_id(), T.supplier_id()
    links = F.array(
        F.struct(o.alias("a"), p.alias("b")),
        F.struct(o.alias("a"), s.alias("b")),
        F.struct(p.alias("a"), s.alias("b")),
    )
    return lines.select(F.explode(links).alias("e"), label.alias("label")).select("e.*", "label")


@query(
    "g3_supervision_graph",
    f"WITH {T.TRADE_SQL}, {_SPLIT} SELECT (SELECT count(*) FROM train) AS nodes, u, v "
    "FROM (SELECT DISTINCT u, v FROM inside WHERE label > 0)",
)
def g3(spark, sf):
    nodes, edges = G.supervision_graph(labelled_arcs(spark, sf), train_nodes(spark, sf))
    return beside(edges, nodes.agg(F.count(F.lit(1)).alias("nodes"))).select("nodes", "u", "v")


@query(
    "g4_train_valid_graphs",
    f"""WITH {T.TRADE_SQL}, {_SPLIT},
fold AS (SELECT u, v, label, CASE WHEN {T.hash_sql(12, "fold", "u", "v")} < {int(0.8 * 2**60)}
  THEN 'train' ELSE 'valid' END AS part FROM inside)
SELECT part, count(*) AS edges, (SELECT count(*) FROM train) AS nodes
FROM (SELECT DISTINCT part, u, v FROM fold WHERE label > 0) GROUP BY part""",
)
def g4(spark, sf):
    low, high = F.least("a", "b"), F.greatest("a", "b")
    is_train = order_key(12, "fold", low, high) < int(0.8 * 2**60)
    pairs = labelled_arcs(spark, sf)
    universe = train_nodes(spark, sf)
    rows = None
    for part, chosen in (("train", is_train), ("valid", ~is_train)):
        nodes, edges = G.supervision_graph(pairs.filter(chosen), universe)
        size = G.graph_size(nodes, edges).select(F.lit(part).alias("part"), "edges", "nodes")
        rows = size if rows is None else rows.unionByName(size)
    return rows


@query(
    "g5_explicit_negatives",
    f"WITH {T.TRADE_SQL}, {_SPLIT} SELECT DISTINCT u, v FROM inside WHERE label <= 0",
)
def g5(spark, sf):
    return G.explicit_negatives(labelled_arcs(spark, sf), train_nodes(spark, sf))


@query(
    "j12_negative_partners",
    f"WITH {T.TRADE_SQL}, {_SPLIT}, neg AS (SELECT DISTINCT u, v FROM inside WHERE label <= 0) "
    "SELECT id, count(*) AS partners FROM (SELECT u AS id, v AS p FROM neg UNION SELECT v, u FROM neg) "
    "GROUP BY id",
)
def j12(spark, sf):
    negatives = G.explicit_negatives(labelled_arcs(spark, sf), train_nodes(spark, sf))
    return G.partners(negatives).groupBy("id").agg(F.count(F.lit(1)).alias("partners"))


@query(
    "a1_degree",
    _TRADE + "SELECT id, count(k) AS degree FROM nodes LEFT JOIN "
    "(SELECT unnest([u,v]) AS id, 1 AS k FROM kept) USING (id) GROUP BY id",
)
def a1(spark, sf):
    return G.degrees(T.trade_edges(spark, sf, kept_only=True), T.trade_nodes(spark, sf))


@query(
    "a2_degree_histogram",
    _TRADE + """, deg AS (SELECT id, count(k) AS degree FROM nodes LEFT JOIN
  (SELECT unnest([u,v]) AS id, 1 AS k FROM kept) USING (id) GROUP BY id)
SELECT degree::INT AS bin, count(*)::DOUBLE AS cnt FROM deg GROUP BY degree""",
)
def a2(spark, sf):
    degree = G.degrees(T.trade_edges(spark, sf, kept_only=True), T.trade_nodes(spark, sf))
    return C.degree_histogram(degree, [])


@query(
    "a3_density",
    _TRADE + "SELECT n AS nodes, m AS edges, round(2.0::DOUBLE*m/(n::DOUBLE*(n-1)),9) AS density FROM "
    "(SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM kept) AS m)",
)
def a3(spark, sf):
    size = G.graph_size(T.trade_nodes(spark, sf), T.trade_edges(spark, sf, kept_only=True))
    return size.select("nodes", "edges", rounded(F.col("density"), 9).alias("density"))


@query(
    "a4_edge_prior",
    _TRADE + "SELECT round(m/(n::DOUBLE*(n-1)/2),9) AS prior FROM "
    "(SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m)",
)
def a4(spark, sf):
    size = G.graph_size(T.trade_nodes(spark, sf), T.trade_edges(spark, sf))
    slots = F.col("nodes").cast("double") * (F.col("nodes") - 1) / 2.0
    return size.select(rounded(F.col("edges") / slots, 9).alias("prior"))


@query(
    "a5_supervised_positive_rate",
    f"""WITH {T.TRADE_SQL}, {_SPLIT}, c AS (SELECT
  (SELECT count(*) FROM (SELECT DISTINCT u,v FROM inside WHERE label > 0)) AS p,
  (SELECT count(*) FROM (SELECT DISTINCT u,v FROM inside WHERE label <= 0)) AS n),
r AS (SELECT p, n, p/(p+least(n, p*5))::DOUBLE AS rate FROM c)
SELECT p AS positives, n AS negatives, round(rate,9) AS rate, round(ln(rate/(1-rate)),9) AS prior_logit FROM r""",
)
def a5(spark, sf):
    nodes = train_nodes(spark, sf)
    pairs = labelled_arcs(spark, sf)
    _, edges = G.supervision_graph(pairs, nodes)
    both = edges.select(F.lit(1).alias("p")).unionByName(
        G.explicit_negatives(pairs, nodes).select(F.lit(0).alias("p"))
    )
    counts = both.agg(F.sum("p").alias("positives"), F.sum(1 - F.col("p")).alias("negatives"))
    rate = G.split_positive_rate(F.col("positives"), F.col("negatives"), 5)
    return counts.select(
        "positives",
        "negatives",
        rounded(rate, 9).alias("rate"),
        rounded(G.prior_logit(rate), 9).alias("prior_logit"),
    )


@query(
    "j7_restrict_to_available",
    f"""WITH {T.TRADE_SQL}, {_SPLIT}
SELECT u, v FROM edges WHERE u IN (SELECT id FROM train) AND v IN (SELECT id FROM train)""",
)
def j7(spark, sf):
    _, edges = G.keep_available(
        T.trade_nodes(spark, sf), T.trade_edges(spark, sf), train_nodes(spark, sf)
    )
    return edges


@query(
    "j9_triangles",
    f"WITH {T.TRIANGLE_SQL} SELECT id, t AS triangles FROM tcount",
)
def j9(spark, sf):
    return G.triangle_corners(T.trade_edges(spark, sf))


@query(
    "g8_local_clustering",
    f"WITH {T.TRIANGLE_SQL} SELECT id, degree, triangles, round(clustering,6) AS clustering FROM local",
)
def g8(spark, sf):
    local = G.local_clustering(T.trade_nodes(spark, sf), T.trade_edges(spark, sf))
    return local.select("id", "degree", "triangles", rounded(F.col("clustering")).alias("clustering"))


_BIN_SQL = """
raws AS (SELECT clustering AS c, least(floor(clustering*100), 99) AS r FROM local),
bins AS (SELECT (CASE WHEN c < r*0.01::DOUBLE THEN r-1
  WHEN c >= (r+1)*0.01::DOUBLE AND r < 99 THEN r+1 ELSE r END)::INT AS bin FROM raws)
"""


@query(
    "g9_clustering_histogram",
    f"WITH {T.TRIANGLE_SQL}, {_BIN_SQL} SELECT bin, count(*)::DOUBLE AS cnt FROM bins GROUP BY bin",
)
def g9(spark, sf):
    local = G.local_clustering(T.trade_nodes(spark, sf), T.trade_edges(spark, sf))
    return C.clustering_histogram(local, [])


@query(
    "j8_full_outer_compare",
    _TRADE + """, cmp AS (SELECT coalesce(e.u,k.u) AS u, coalesce(e.v,k.v) AS v,
  (e.u IS NOT NULL)::INT AS t, (k.u IS NOT NULL)::INT AS p
  FROM edges e FULL JOIN kept k ON e.u=k.u AND e.v=k.v)
SELECT sum(t)::BIGINT AS true_edges, sum(p)::BIGINT AS pred_edges, sum(t*p)::BIGINT AS shared_edges,
  sum(2*abs(t-p))::BIGINT AS diff_cells FROM cmp""",
)
def j8(spark, sf):
    marked = T.trade_edges(spark, sf).withColumn("side", F.lit("true")).unionByName(
        T.trade_edges(spark, sf, kept_only=True).withColumn("side", F.lit("pred"))
    )
    return C.edge_overlap(marked, []).select("true_edges", "pred_edges", "shared_edges", "diff_cells")


@query(
    "g6_g7_whole_graph",
    _TRADE + """, c AS (SELECT (SELECT count(*) FROM edges) AS t, (SELECT count(*) FROM kept) AS p)
SELECT round(1 - (t-p)/(t+p)::DOUBLE, 6) AS graph_sim, round(p/t::DOUBLE, 6) AS relative_density FROM c""",
)
def g67(spark, sf):
    marked = T.trade_edges(spark, sf).withColumn("side", F.lit("true")).unionByName(
        T.trade_edges(spark, sf, kept_only=True).withColumn("side", F.lit("pred"))
    )
    nodes = T.trade_nodes(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    row = beside(C.edge_overlap(marked, []), nodes)
    return row.select(
        rounded(
            C.graph_similarity(F.col("diff_cells"), F.col("true_cells"), F.col("pred_cells"))
        ).alias("graph_sim"),
        rounded(
            C.relative_density(
                G.density(F.col("n"), F.col("pred_edges")), G.density(F.col("n"), F.col("true_edges"))
            )
        ).alias("relative_density"),
    )


@query(
    "j6_induced_edges",
    f"WITH {T.INDUCED_SQL} SELECT node_size, sample_id, u, v FROM marked WHERE t = 1",
)
def j6(spark, sf):
    _, true, _ = T.vector_graphs(spark, sf)
    return G.induced_edges(T.vector_samples(spark, sf), true)


@query(
    "a7_cover_summary",
    _TRADE + """, uses AS (SELECT u, v, count(*) AS n FROM
  (SELECT least(a,b) AS u, greatest(a,b) AS v FROM arcs WHERE l_returnflag <> 'R') GROUP BY u, v)
SELECT (SELECT count(*) FROM edges) AS total_edges, count(*) AS covered_edges,
  round(count(*)/(SELECT count(*) FROM edges)::DOUBLE,6) AS coverage,
  round(sum(n)/count(*)::DOUBLE,6) AS mean_reuse FROM uses""",
)
def a7(spark, sf):
    uses = T.arcs(spark, sf, kept_only=True).select(
        F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")
    )
    row = V.cover_summary(T.trade_edges(spark, sf), uses)
    return row.select(
        "total_edges",
        "covered_edges",
        rounded(F.col("coverage")).alias("coverage"),
        rounded(F.col("mean_reuse")).alias("mean_reuse"),
    )


@query(
    "u3_set_equality",
    f"WITH {T.TRADE_SQL}, {_COMPLETED} SELECT "
    "(SELECT count(*) FROM nodes WHERE id NOT IN (SELECT id FROM pnodes)) AS only_left, "
    "(SELECT count(*) FROM pnodes WHERE id NOT IN (SELECT id FROM nodes)) AS only_right",
)
def u3(spark, sf):
    pred = G.endpoints(T.trade_edges(spark, sf, kept_only=True))
    return P.sets_differ(T.trade_nodes(spark, sf), pred, "id")
