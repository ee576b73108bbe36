"""Pair-table operators: sets, joins, enumeration, shards, materialised subgraph pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphrecon.catalog import tables as T
from graphrecon.catalog.graphs import _SPLIT, labelled_arcs, train_nodes
from graphrecon.catalog.registry import query
from graphrecon.functions.keys import canonical, order_key
from graphrecon.operators import graph as G
from graphrecon.operators import pairs as P
from graphrecon.operators import vectors as V
from graphrecon.operators.prefix import global_index, random_rank

_TRADE = f"WITH {T.TRADE_SQL} "
_SPLIT_WITH = f"WITH {T.TRADE_SQL}, {_SPLIT} "


@query(
    "p1_canonical_pair",
    _TRADE + "SELECT least(a,b) AS u, greatest(a,b) AS v, count(*) AS lines FROM arcs GROUP BY 1, 2",
)
def p1(spark, sf):
    return canonical(T.arcs(spark, sf)).groupBy("u", "v").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "j1_embedding_lookup",
    """WITH e AS (SELECT 'S'||vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings),
p AS (SELECT 'P'||l_partkey AS a, 'S'||l_suppkey AS b FROM lineitem),
f AS (SELECT 'P'||vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings)
SELECT a, b, count(*) AS lines, round(max(list_dot_product(f.vec, e.vec)),6) AS score,
  max(CASE WHEN f.id IS NOT NULL AND e.id IS NOT NULL THEN 'both' WHEN f.id IS NOT NULL THEN 'first'
    WHEN e.id IS NOT NULL THEN 'second' ELSE 'none' END) AS state
FROM p LEFT JOIN f ON f.id = a LEFT JOIN e ON e.id = b GROUP BY a, b""",
)
def j1(spark, sf):
    """Every order line as a part-supplier pair; each end meets its vector."""
    from graphrecon.functions.keys import rounded
    from graphrecon.functions.vectors import dot

    wide = F.col("embedding").cast("array<double>").alias("vec")
    base = T.table(spark, sf, "embeddings")
    ids = None
    for prefix in ("P", "S"):
        part = base.select(F.concat(F.lit(prefix), F.col("vec_id").cast("string")).alias("id"), wide)
        ids = part if ids is None else ids.unionByName(part)
    pairs = T.table(spark, sf, "lineitem").groupBy(
        T.part_id().alias("a"), T.supplier_id().alias("b")
    ).agg(F.count(F.lit(1)).alias("lines"))
    scored = V.score_pairs(pairs, ids, dot(F.col("vec_a"), F.col("vec_b")), missing="keep")
    return scored.select("a", "b", "lines", rounded(F.col("logit")).alias("score"), "state")


@query(
    "j1_missing_ids",
    """SELECT DISTINCT 'P'||l_partkey AS id FROM lineitem
WHERE l_partkey NOT IN (SELECT vec_id FROM embeddings)
UNION SELECT DISTINCT 'S'||l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT vec_id FROM embeddings)""",
)
def j1_missing(spark, sf):
    base = T.table(spark, sf, "embeddings")
    ids = base.select(
        F.explode(
            F.array(
                F.concat(F.lit("P"), F.col("vec_id").cast("string")),
                F.concat(F.lit("S"), F.col("vec_id").cast("string")),
            )
        ).alias("id")
    )
    pairs = T.table(spark, sf, "lineitem").select(T.part_id().alias("a"), T.supplier_id().alias("b"))
    return V.missing_ids(pairs, ids)


@query(
    "j2_both_ends_in_split",
    _SPLIT_WITH + "SELECT a, b, count(*) AS lines FROM labelled WHERE a IN (SELECT id FROM train) "
    "AND b IN (SELECT id FROM train) GROUP BY a, b",
)
def j2(spark, sf):
    inside = P.inside_split(T.arcs(spark, sf), train_nodes(spark, sf))
    return inside.groupBy("a", "b").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "j3_exclusion",
    _TRADE + "SELECT u, v FROM edges WHERE (u, v) NOT IN (SELECT (u, v) FROM kept)",
)
def j3(spark, sf):
    return P.without(T.trade_edges(spark, sf), T.trade_edges(spark, sf, kept_only=True))


@query(
    "j4_sample_pairs",
    f"""WITH {T.SAMPLES_SQL} SELECT a.node_size, a.sample_id, a.pos AS pos_a, b.pos AS pos_b,
  a.id AS a, b.id AS b FROM samples a JOIN samples b
  ON a.node_size=b.node_size AND a.sample_id=b.sample_id AND a.pos<b.pos""",
)
def j4(spark, sf):
    return P.pairs_in_samples(T.vector_samples(spark, sf))


@query(
    "j4_full_enumeration",
    """SELECT count(*) AS pairs, sum(CASE WHEN a.vec_id=b.vec_id THEN 1 ELSE 0 END)::BIGINT AS self_pairs,
  sum(a.vec_id)::BIGINT AS sum_u, sum(b.vec_id)::BIGINT AS sum_v
FROM embeddings a JOIN embeddings b ON a.vec_id <= b.vec_id""",
)
def j4_full(spark, sf):
    ids = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    pairs = P.enumerate_pairs(ids, include_self=True)
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum((F.col("u") == F.col("v")).cast("bigint")).alias("self_pairs"),
        F.sum("u").alias("sum_u"),
        F.sum("v").alias("sum_v"),
    )


@query(
    "j5_edge_labels",
    _TRADE + "SELECT e.u, e.v, (k.u IS NOT NULL)::INT AS label FROM edges e "
    "LEFT JOIN kept k ON e.u=k.u AND e.v=k.v",
)
def j5(spark, sf):
    return P.label_by_edges(T.trade_edges(spark, sf), T.trade_edges(spark, sf, kept_only=True))


def _shards(spark, sf):
    """Decisions of all scored lines, numbered in line order; each return flag is a shard."""
    lines = T.scored_lines(spark, sf).select(
        "l_orderkey", "l_linenumber", "a", "b", "logit", "l_returnflag",
        (F.col("prob") >= 0.5).cast("int").alias("pred"),
    )
    order = ["l_orderkey", "l_linenumber", "a", "b", "logit"]
    return global_index(lines, order, "pair_index")


_ROWS_SQL = f"""{T.SCORED_SQL},
numbered AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, a, b, logit) - 1 AS pair_index,
  (prob >= 0.5)::INT AS pred, l_returnflag FROM scored)"""


@query("j13_merge_shards", f"WITH {_ROWS_SQL} SELECT pair_index, pred FROM numbered")
def j13(spark, sf):
    rows = _shards(spark, sf).select("pair_index", "pred", F.col("l_returnflag").alias("shard"))
    total = T.table(spark, sf, "lineitem").count()
    shards = [rows.filter(F.col("shard") == f) for f in ("A", "N", "R")]
    whole = shards[0].unionByName(shards[1]).unionByName(shards[2])
    return P.merge_shards(whole, total)


@query(
    "j13_shard_faults",
    f"WITH {_ROWS_SQL} SELECT 0::BIGINT AS out_of_bounds, "
    "(SELECT count(*) FROM numbered WHERE l_returnflag = 'A') AS duplicates, "
    "(SELECT count(*) FROM numbered WHERE l_returnflag = 'R') AS missing",
)
def j13_faults(spark, sf):
    rows = _shards(spark, sf)
    shards = rows.filter("l_returnflag <> 'R'").unionByName(rows.filter("l_returnflag = 'A'"))
    total = T.table(spark, sf, "lineitem").count()
    return P.shard_faults(shards, total)


@query(
    "u1_union",
    _SPLIT_WITH + "SELECT u, v FROM inside WHERE label > 0 UNION SELECT u, v FROM inside WHERE label <= 0",
)
def u1(spark, sf):
    pairs, nodes = labelled_arcs(spark, sf), train_nodes(spark, sf)
    _, edges = G.supervision_graph(pairs, nodes)
    return edges.unionByName(G.explicit_negatives(pairs, nodes)).distinct()


@query("u2_difference", _TRADE + "SELECT u, v FROM edges EXCEPT SELECT u, v FROM kept")
def u2(spark, sf):
    return P.difference(T.trade_edges(spark, sf), T.trade_edges(spark, sf, kept_only=True))


@query(
    "u4_duplicate_keys",
    "SELECT l_partkey, l_suppkey, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def u4(spark, sf):
    return P.duplicate_keys(T.table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


@query(
    "a12_validation_plan_totals",
    f"""WITH {T.SAMPLES_SQL}, s AS (SELECT node_size, sample_id, count(*) AS n FROM samples GROUP BY 1, 2)
SELECT count(*) AS subgraphs, sum(n*(n-1)//2)::BIGINT AS pairs,
  (SELECT count(DISTINCT id) FROM samples) AS ids FROM s""",
)
def a12(spark, sf):
    return P.validation_plan_totals(T.vector_samples(spark, sf))


def _assigned(spark, sf):
    """Samples with true edges split by hash: some assigned as positives; some non-edges negative."""
    nodes, true, _ = T.vector_graphs(spark, sf)
    samples = T.vector_samples(spark, sf)
    inside = G.induced_edges(samples, true)
    key = order_key(5, "assign", F.col("u"), F.col("v"))
    positives = inside.filter(key < 2**59)
    pairs = P.pairs_in_samples(samples).select(
        "node_size", "sample_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")
    )
    negatives = P.without(pairs, true).filter(order_key(5, "assign", F.col("u"), F.col("v")) < 2**57)
    return samples, true, positives, negatives


@query(
    "n14_subgraph_pairs",
    f"""WITH {T.INDUCED_SQL}, k AS (SELECT a.node_size, a.sample_id, a.pos AS pos_a, b.pos AS pos_b,
  a.id AS a, b.id AS b, least(a.id,b.id) AS u, greatest(a.id,b.id) AS v
  FROM samples a JOIN samples b ON a.node_size=b.node_size AND a.sample_id=b.sample_id AND a.pos<b.pos),
l AS (SELECT k.*, t, {T.hash_sql(5, "assign", "u", "v")} AS h FROM k
  JOIN marked USING (node_size, sample_id, u, v))
SELECT node_size, sample_id, pos_a, pos_b, a, b, t::DOUBLE AS topo_label,
  (t = 1 AND h < {2**59})::INT::DOUBLE AS bce_label,
  ((t = 1 AND h < {2**59}) OR (t = 0 AND h < {2**57}))::INT::DOUBLE AS bce_mask FROM l""",
)
def n14(spark, sf):
    samples, true, positives, negatives = _assigned(spark, sf)
    return P.subgraph_pairs(samples, true, positives, negatives, ["node_size", "sample_id"])


_N15 = _SPLIT_WITH + """, rows AS (SELECT DISTINCT u, v, 1 AS label FROM inside WHERE label > 0
  UNION ALL SELECT DISTINCT u, v, 0 FROM inside WHERE label <= 0),
placed AS (SELECT *, row_number() OVER (ORDER BY label DESC, u, v) - 1 AS row_index FROM rows) """


def _supervised(spark, sf, size=None):
    pairs, nodes = labelled_arcs(spark, sf), train_nodes(spark, sf)
    _, edges = G.supervision_graph(pairs, nodes)
    return P.supervised_pairs(edges, G.explicit_negatives(pairs, nodes), size)


@query("n15_supervised_pairs", _N15 + "SELECT u, v, label FROM rows")
def n15(spark, sf):
    return _supervised(spark, sf)


@query("n16_fixed_chunks", _N15 + "SELECT u, v, label, row_index, row_index // 256 AS chunk FROM placed")
def n16(spark, sf):
    return _supervised(spark, sf, 256)


@query(
    "w5_global_index",
    _TRADE + "SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM nodes",
)
def w5(spark, sf):
    return global_index(T.trade_nodes(spark, sf), ["id"], "idx")


@query(
    "w5_random_order",
    _TRADE + f"""SELECT id, row_number() OVER (ORDER BY {T.hash_sql(3, "shuffle", "id")}, id) - 1 AS rank
FROM nodes""",
)
def w5_random(spark, sf):
    keyed = T.trade_nodes(spark, sf).withColumn("key", order_key(3, "shuffle", F.col("id")))
    return random_rank(keyed, "key", ["id"]).select("id", "rank")


@query(
    "w7_sorted_preview",
    _TRADE + "SELECT id FROM nodes WHERE id NOT IN (SELECT unnest([u,v]) FROM kept) ORDER BY id LIMIT 10",
)
def w7(spark, sf):
    kept = G.endpoints(T.trade_edges(spark, sf, kept_only=True))
    missing = T.trade_nodes(spark, sf).join(kept, "id", "left_anti")
    return V.preview(missing, "id", 10)
