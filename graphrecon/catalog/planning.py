"""Sampling and planning on the whole trade graph. Draws are random, so results are invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphrecon.catalog import tables as T
from graphrecon.catalog.graphs import _SPLIT, labelled_arcs, train_nodes
from graphrecon.catalog.registry import query
from graphrecon.functions.keys import rounded
from graphrecon.functions.rows import beside
from graphrecon.operators import cover as V
from graphrecon.operators import graph as G
from graphrecon.operators import negatives as N
from graphrecon.operators import pairs as P
from graphrecon.operators import sampling as S
from graphrecon.operators.traversal import adjacency
from graphrecon.plans.epoch import plan_epoch
from graphrecon.session import drop_shuffles, materialize, planned_once, write_down

_TRADE = f"WITH {T.TRADE_SQL} "
_SIZE, _PER_NODES = 12, 200  # nodes per sample; one sample per so many nodes


@query(
    "n1_exclusive_negatives",
    _TRADE + "SELECT 2*count(*) AS wanted, 2*count(*) AS distinct_pairs, 0::BIGINT AS loops, "
    "0::BIGINT AS known, 0::BIGINT AS unordered, 0::BIGINT AS unknown_ids FROM kept",
)
def n1(spark, sf):
    nodes = write_down(T.trade_nodes(spark, sf))
    with planned_once(spark):  # dealt out by pair, as the drawn ones are: nothing of them moves again
        edges = materialize(T.marked_edges(spark, sf))
    count = edges.filter("kept").count()
    drop_shuffles(spark)
    drawn = N.draw_pairs(nodes, 2 * count, 9, edges)  # written already
    known = P.label_by_edges(drawn, edges, "known")
    ids = nodes.select("id").distinct()
    strange = G.endpoints(drawn).join(ids, "id", "left_anti").agg(
        F.count(F.lit(1)).alias("unknown_ids")
    )
    facts = known.agg(
        F.count(F.lit(1)).alias("wanted"),
        F.count_distinct("u", "v").alias("distinct_pairs"),
        F.sum((F.col("u") == F.col("v")).cast("bigint")).alias("loops"),
        F.sum("known").alias("known"),
        F.sum((F.col("u") > F.col("v")).cast("bigint")).alias("unordered"),
    )
    return beside(facts, strange)


def _positive_splits(spark, sf):
    """Positive rows by return flag as the three splits, repeats kept; returned lines to test."""
    rows = labelled_arcs(spark, sf).withColumn("u", F.least("a", "b")).withColumn(
        "v", F.greatest("a", "b")
    )
    lines = {1: "train", -1: "valid", 0: "test"}
    return {name: rows.filter(F.col("label") == k).select("u", "v") for k, name in lines.items()}


@query(
    "n2_three_splits",
    _TRADE + """, rows AS (SELECT CASE l_returnflag WHEN 'R' THEN 'test' WHEN 'A' THEN 'valid' ELSE 'train' END AS split FROM arcs)
SELECT split, count(*) AS positives, count(*) AS negatives, count(*) AS distinct_negatives, 0::BIGINT AS known,
  0::BIGINT AS shared FROM rows GROUP BY split""",
)
def n2(spark, sf):
    none = T.trade_edges(spark, sf).filter(F.lit(False))
    rows = N.supervision_rows(_positive_splits(spark, sf), T.trade_nodes(spark, sf), None, none, 1, 5)  # written already
    negatives = rows.filter("label = 0")
    shared = negatives.groupBy("u", "v").agg(
        F.count_distinct("split").alias("splits")
    ).filter("splits > 1")
    known = P.label_by_edges(negatives, T.trade_edges(spark, sf), "known")
    marked = known.join(shared, ["u", "v"], "left")
    per = marked.groupBy("split").agg(
        F.count(F.lit(1)).alias("negatives"),
        F.count_distinct("u", "v").alias("distinct_negatives"),
        F.sum("known").alias("known"),
        F.count("splits").alias("shared"),
    )
    positives = rows.filter("label = 1").groupBy("split").agg(F.count(F.lit(1)).alias("positives"))
    return positives.join(per, "split")


def _graph(spark, sf, walks=True):
    nodes, edges = write_down(T.trade_nodes(spark, sf)), write_down(T.trade_edges(spark, sf))
    drop_shuffles(spark)
    return nodes, edges, adjacency(nodes, edges, walks)


def _raw_edges(spark, sf):
    """The graph's edges, one as often as lines have it: for steps that make one of equal ones when they meet anyway."""
    return T.arcs(spark, sf).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def _neighbours_only(spark, sf):
    return adjacency(T.trade_nodes(spark, sf), _raw_edges(spark, sf))


def _connected(samples, inside, keys):
    """Nodes of each sample without any neighbour inside it."""
    return samples.join(G.endpoints(inside, keys), [*keys, "id"], "left_anti")


def _sample_facts(spark, sf, strategy):
    """One sample of 12 nodes per 200 nodes: sizes, repeats, unknown and unlinked nodes.

    The trade graph has no isolated node and its pieces exceed 12 nodes, so every node of a
    traversal sample has a neighbour in it.
    """
    graph, edges, nodes = _neighbours_only(spark, sf), _raw_edges(spark, sf), T.trade_nodes(spark, sf)
    count = -(-graph.node_count // _PER_NODES)
    samples = write_down(
        S.training_samples(spark, graph, count, _SIZE, _SIZE, strategy, 21)
    )
    per = samples.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d"), F.max("pos").alias("p")
    )
    inside = write_down(G.induced_edges(samples, edges, ["sample_id"]).distinct())
    drop_shuffles(spark)
    loose = _connected(samples, inside, ["sample_id"]).agg(F.count(F.lit(1)).alias("unlinked"))
    strange = samples.join(nodes, "id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_ids"))
    facts = per.agg(
        F.count(F.lit(1)).alias("samples"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.sum(F.col("n") - F.col("d")).alias("repeated"),
    )
    order = _order_faults(samples, inside, edges, graph).select(*_ORDER_FAULTS[strategy])
    return beside(facts, loose, strange, order)


# What the order of a sample's nodes must show; the other strategies' samples break the middle two.
_ORDER_FAULTS = {
    "BFS": ["without_earlier_neighbour", "served_out_of_turn"],
    "DFS": ["without_earlier_neighbour", "left_too_early"],
    "RANDOM_WALK": ["without_earlier_neighbour"],
}


def _order_faults(samples, inside, edges, graph):
    """One row: new nodes without an earlier neighbour; nodes whose first neighbour in the sample stands before that of
    the node before them (a queue serves in turn); nodes that don't hang on the newest node with anything left (a stack does)."""
    near = inside.filter("u <> v").select("sample_id", F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
    other = samples.select("sample_id", F.col("id").alias("v"), F.col("pos").alias("at"))
    lists = near.select("sample_id", F.col("e.u").alias("id"), F.col("e.v").alias("v")).join(other, ["sample_id", "v"])
    lists = lists.groupBy("sample_id", "id").agg(F.collect_list("at").alias("near"))
    loops = edges.filter("u = v").select(F.col("u").alias("id"), F.lit(1).alias("loop")).distinct()
    degree = graph.spans.join(loops, "id", "left").select("id", (F.col("degree") - F.coalesce("loop", F.lit(0))).alias("degree"))
    nodes = samples.join(lists, ["sample_id", "id"], "left").join(degree, "id").groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("near", F.array().cast("array<int>")).alias("near"), "degree"))).alias("nodes")
    )

    def earlier(n):
        return F.filter(n["near"], lambda p: p < n["pos"])

    def count(found):
        return F.sum(F.size(F.filter("nodes", found)).cast("bigint"))

    new = F.filter("nodes", lambda n: n["pos"] > 0)
    first = F.transform(new, lambda n: F.array_min(earlier(n)))
    turned = F.filter(F.zip_with(first, F.slice(first, F.lit(2), F.size(first)), lambda a, b: b < a), lambda x: F.coalesce(x, F.lit(False)))

    def left_open(n):
        newest = F.array_max(earlier(n))
        between = F.filter("nodes", lambda k: (k["pos"] > newest) & (k["pos"] < n["pos"]))
        return F.exists(between, lambda k: k["degree"] > F.size(F.filter(k["near"], lambda p: p < n["pos"])))

    return nodes.agg(
        count(lambda n: (n["pos"] > 0) & (F.size(earlier(n)) == 0)).alias("without_earlier_neighbour"),
        F.sum(F.size(turned).cast("bigint")).alias("served_out_of_turn"),
        count(lambda n: (n["pos"] > 0) & F.coalesce(left_open(n), F.lit(False))).alias("left_too_early"),
    )


def _facts_sql(strategy):
    zeros = ", ".join(f"0::BIGINT AS {name}" for name in _ORDER_FAULTS[strategy])
    return (
        _TRADE + f"SELECT ceil(count(*)/{_PER_NODES}.0)::BIGINT AS samples, {_SIZE}::BIGINT AS least, {_SIZE}::BIGINT AS most, "
        f"0::BIGINT AS repeated, 0::BIGINT AS unlinked, 0::BIGINT AS unknown_ids, {zeros} FROM nodes"
    )


@query("n3_breadth_first", _facts_sql("BFS"))
def n3(spark, sf):
    return _sample_facts(spark, sf, "BFS")


@query("n4_depth_first", _facts_sql("DFS"))
def n4(spark, sf):
    return _sample_facts(spark, sf, "DFS")


@query("n5_random_walk", _facts_sql("RANDOM_WALK"))
def n5(spark, sf):
    return _sample_facts(spark, sf, "RANDOM_WALK")


@query(
    "n6_fallback_fill",
    _TRADE + f"SELECT ceil(count(*)/{_PER_NODES}.0)::BIGINT AS samples, {_SIZE}::BIGINT AS least, "
    f"{_SIZE}::BIGINT AS most, 0::BIGINT AS repeated FROM nodes",
)
def n6(spark, sf):
    """Samples of one node each, filled with random unseen nodes of the whole graph."""
    from graphrecon.operators.traversal import fill, nodes_only, random_starts

    graph = nodes_only(T.trade_nodes(spark, sf))
    count = -(-graph.node_count // _PER_NODES)
    wanted = spark.range(count).select(
        F.col("id").cast("int").alias("sample_id"), F.lit(_SIZE).alias("target")
    )
    keys = ["sample_id"]
    full = fill(random_starts(wanted, graph, keys, 3), graph, keys, 3)
    per = S.long_form(full, keys).groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d")
    )
    return per.agg(
        F.count(F.lit(1)).alias("samples"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.sum(F.col("n") - F.col("d")).alias("repeated"),
    )


@query(
    "n7_strategy_and_size",
    f"""SELECT o_orderkey, ['BFS','DFS','RANDOM_WALK'][{T.hash_sql(4, "strategy", "o_orderkey")} % 3 + 1] AS strategy,
  ({T.hash_sql(4, "size", "o_orderkey")} % 31 + 30)::INT AS target FROM orders""",
)
def n7(spark, sf):
    """A strategy and a size for as many samples as there are orders."""
    key = F.col("o_orderkey")
    return T.table(spark, sf, "orders").select(
        "o_orderkey",
        S.strategy_choice("mixed", 4, key).alias("strategy"),
        S.target_choice(30, 60, 10**6, 4, key).alias("target"),
    )


@query(
    "n8_training_samples",
    _TRADE + f"SELECT ceil(count(*)/{_PER_NODES}.0)::BIGINT AS samples, 0::BIGINT AS out_of_range, "
    "0::BIGINT AS repeated FROM nodes",
)
def n8(spark, sf):
    graph = _neighbours_only(spark, sf)
    count = -(-graph.node_count // _PER_NODES)
    samples = S.training_samples(spark, graph, count, 6, 12, "MIXED", 8)
    per = samples.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d")
    )
    return per.agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum((~F.col("n").between(6, 12)).cast("bigint")).alias("out_of_range"),
        F.sum(F.col("n") - F.col("d")).alias("repeated"),
    )


@query(
    "n9_size_buckets",
    _TRADE + f"""SELECT s AS node_size, ceil(count(*)/{4 * _PER_NODES}.0)::BIGINT AS samples, s::BIGINT AS least,
  s::BIGINT AS most, 0::BIGINT AS unsorted FROM nodes, (VALUES (6), (10)) t(s) GROUP BY s""",
)
def n9(spark, sf):
    from pyspark.sql import Window

    graph = _neighbours_only(spark, sf)
    count = -(-graph.node_count // (4 * _PER_NODES))
    samples = S.evaluation_samples(spark, graph, 17, "MIXED", [6, 10], count)
    keys = ["node_size", "sample_id"]
    before = F.lag("id").over(Window.partitionBy(*keys).orderBy("pos"))
    per = samples.withColumn("bad", (before >= F.col("id")).cast("int")).groupBy(*keys).agg(
        F.count_distinct("id").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    return per.groupBy("node_size").agg(
        F.count(F.lit(1)).alias("samples"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.sum("bad").alias("unsorted"),
    )


@query(
    "n10_edge_chunks",
    _TRADE + "SELECT count(*) AS edges, count(*) AS distinct_edges, 0::BIGINT AS too_many_edges, "
    "0::BIGINT AS too_many_nodes FROM edges",
)
def n10(spark, sf):
    """Chunks are judged as they are packed; that each edge is there once is seen by its pair alone."""
    chunks = V.partition_edges(write_down(T.trade_edges(spark, sf)), 225, 60, 2)  # written already
    drop_shuffles(spark)
    per = chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), _ends("u", "v").alias("nodes"))
    bad = per.agg(
        F.sum((F.col("n") > 225).cast("bigint")).alias("too_many_edges"),
        F.sum((F.col("nodes") > 60).cast("bigint")).alias("too_many_nodes"),
    )
    facts = chunks.agg(
        F.count(F.lit(1)).alias("edges"), F.count_distinct("u", "v").alias("distinct_edges")
    )
    return beside(facts, bad)


def _ends(u, v):
    """Number of different ends of a chunk's edges."""
    return F.size(F.array_union(F.collect_set(u), F.collect_set(v)))


@query(
    "n11_chunk_size",
    _TRADE + "SELECT count(*) AS edges, 885 AS default_size, least(885, greatest(1, count(*)//1000))::INT AS epoch_size FROM edges",
)
def n11(spark, sf):
    count = T.trade_edges(spark, sf).count()
    default = V.default_chunk_size(60)
    size = V.epoch_chunk_size(count, default, 1000)
    return T.trade_edges(spark, sf).agg(
        F.count(F.lit(1)).alias("edges"),
        F.lit(default).alias("default_size"),
        F.lit(size).alias("epoch_size"),
    )


@query(
    "n12_chunk_expansion",
    _TRADE + "SELECT count(*) AS edges, 0::BIGINT AS lost_core_nodes, 0::BIGINT AS repeated, "
    "0::BIGINT AS out_of_range FROM edges",
)
def n12(spark, sf):
    return _expansion(spark, sf, "BFS")


@query(
    "n12_mixed_expansion",
    _TRADE + "SELECT count(*) AS edges, 0::BIGINT AS lost_core_nodes, 0::BIGINT AS repeated, "
    "0::BIGINT AS out_of_range FROM edges",
)
def n12_mixed(spark, sf):
    """A third of the chunks each grown breadth first, depth first and by walks."""
    return _expansion(spark, sf, "MIXED")


def _expansion(spark, sf, strategy):
    nodes, edges, graph = _graph(spark, sf, walks=strategy != "BFS")
    chunks = write_down(V.partition_edges(edges, 40, 60, 2))
    grown = write_down(V.expand_chunks(chunks, graph, 55, 60, strategy, 6))
    ids = grown.groupBy("chunk").agg(F.collect_list("id").alias("ids"))
    per = V.core_nodes(chunks).join(ids, "chunk", "full").select(
        F.size(F.array_except(F.coalesce("visited", F.array()), F.coalesce("ids", F.array()))).cast("bigint").alias("lost"),
        F.size("ids").cast("bigint").alias("n"),
        F.size(F.array_distinct("ids")).cast("bigint").alias("d"),
    )
    facts = per.agg(
        F.sum("lost").alias("lost_core_nodes"),
        F.sum(F.col("n") - F.col("d")).alias("repeated"),
        F.sum((~F.col("n").between(55, 60)).cast("bigint")).alias("out_of_range"),
    )
    return beside(chunks.agg(F.count(F.lit(1)).alias("edges")), facts)


@query(
    "j10_negative_slices",
    f"""WITH {T.TRADE_SQL}, {_SPLIT},
p AS (SELECT count(*) AS n FROM (SELECT DISTINCT u, v FROM inside WHERE label > 0)),
q AS (SELECT count(*) AS n FROM (SELECT DISTINCT u, v FROM inside WHERE label <= 0))
SELECT least(2*p.n, q.n) AS dealt, least(2*p.n, q.n) AS distinct_pairs, 0::BIGINT AS overfull FROM p, q""",
)
def j10(spark, sf):
    pairs, nodes = labelled_arcs(spark, sf), train_nodes(spark, sf)
    _, edges = G.supervision_graph(pairs, nodes)
    negatives = materialize(G.explicit_negatives(pairs, nodes))
    chunks = materialize(V.partition_edges(edges, 40, 60, 2)).select("chunk", "u", "v")
    dealt = materialize(V.assign_negatives(chunks, negatives, 2, 4))
    want = chunks.groupBy("chunk").agg((2 * F.count(F.lit(1))).alias("want"))
    got = dealt.groupBy("chunk").agg(F.count(F.lit(1)).alias("got"))
    over = got.join(want, "chunk").agg(
        F.coalesce(F.sum((F.col("got") > F.col("want")).cast("bigint")), F.lit(0)).alias("overfull")
    )
    facts = dealt.agg(
        F.count(F.lit(1)).alias("dealt"), F.count_distinct("u", "v").alias("distinct_pairs")
    )
    return beside(facts, over)


def _plan(spark, sf, strategy="BFS"):
    pairs, nodes = labelled_arcs(spark, sf), train_nodes(spark, sf)
    ids, edges = G.supervision_graph(pairs, nodes)
    negatives = G.explicit_negatives(pairs, nodes)
    edges = materialize(edges)
    plan = plan_epoch(
        ids, edges, 0, 30, 60, strategy, 3, chunk_size=50, negatives=negatives, negative_ratio=1
    )
    return edges, negatives, plan


_COVER_SQL = f"""WITH {T.TRADE_SQL}, {_SPLIT}, p AS (SELECT DISTINCT u, v FROM inside WHERE label > 0)
SELECT count(*) AS total_edges, count(*) AS covered_edges, 1.0::DOUBLE AS coverage, 1.0::DOUBLE AS mean_reuse,
  0::BIGINT AS ends_outside, 0::BIGINT AS out_of_range FROM p"""


def _cover_facts(spark, sf, strategy):
    """Edges covered, ends of assigned edges that their grown subgraph lacks, subgraphs of a wrong size."""
    _, _, plan = _plan(spark, sf, strategy)
    lost = G.endpoints(plan.positives, ["chunk"]).join(plan.nodes.select("chunk", "id"), ["chunk", "id"], "left_anti")
    sizes = plan.nodes.groupBy("chunk").agg(F.count_distinct("id").alias("n"))
    bad = sizes.agg(F.sum((~F.col("n").between(30, 60)).cast("bigint")).alias("out_of_range"))
    summary = plan.summary.select(
        "total_edges",
        "covered_edges",
        rounded(F.col("coverage")).alias("coverage"),
        rounded(F.col("mean_reuse")).alias("mean_reuse"),
    )
    return beside(summary, lost.agg(F.count(F.lit(1)).alias("ends_outside")), bad)


@query("n13_edge_cover_epoch", _COVER_SQL)
def n13(spark, sf):
    return _cover_facts(spark, sf, "BFS")


@query("n13_mixed_cover_epoch", _COVER_SQL)
def n13_mixed(spark, sf):
    return _cover_facts(spark, sf, "MIXED")


@query(
    "a8_epoch_counters",
    f"""WITH {T.TRADE_SQL}, {_SPLIT},
p AS (SELECT count(*) AS n FROM (SELECT DISTINCT u, v FROM inside WHERE label > 0)),
q AS (SELECT count(*) AS n FROM (SELECT DISTINCT u, v FROM inside WHERE label <= 0))
SELECT p.n AS positive_pairs, p.n AS target_negative_pairs, least(p.n, q.n) AS negative_pairs,
  p.n + least(p.n, q.n) AS supervised_pairs, round(least(p.n, q.n)/p.n::DOUBLE,6) AS negative_ratio FROM p, q""",
)
def a8(spark, sf):
    _, _, plan = _plan(spark, sf, "MIXED")
    row = V.epoch_counters(plan.nodes, plan.positives, plan.negatives, 1)
    return row.select(
        "positive_pairs",
        "target_negative_pairs",
        "negative_pairs",
        "supervised_pairs",
        rounded(F.col("negative_ratio")).alias("negative_ratio"),
    )
