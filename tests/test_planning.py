import itertools
import math
import os
from collections import Counter, defaultdict

import pytest

from graphrecon.session import materialize
from pyspark.sql import functions as F

from graphrecon.operators import batches as B
from graphrecon.operators import cover as V
from graphrecon.operators import graph as G
from graphrecon.operators import mining as M
from graphrecon.operators import negatives as N
from graphrecon.operators import sampling as S
from graphrecon.operators import traversal as T
from graphrecon.plans.epoch import plan_epoch


def by_sample(df, key="sample_id"):
    out = defaultdict(list)
    for r in df.orderBy(key, "pos").collect():
        out[r[key]].append(r["id"])
    return dict(out)


def neighbours(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    return near


GRID = [((x, y), (x + dx, y + dy)) for x in range(6) for y in range(6) for dx, dy in ((0, 1), (1, 0)) if x + dx < 6 and y + dy < 6]
GRID = [(f"{a[0]}{a[1]}", f"{b[0]}{b[1]}") for a, b in GRID]


def start(spark, count, target, visited=None):
    df = spark.range(count).select(F.col("id").cast("int").alias("sample_id"), F.lit(target).alias("target"))
    return df if visited is None else df.withColumn("visited", F.array(*[F.lit(v) for v in visited]))


def test_breadth_first_order_is_by_distance(spark, edges, ids):
    near = neighbours(GRID)
    graph = T.adjacency(ids(sorted(near)), edges(*GRID))
    got = T.breadth_first(start(spark, 20, 20, ["00"]), graph, ["sample_id"], 1)
    orders = by_sample(S.long_form(got, ["sample_id"]))
    assert len({tuple(o) for o in orders.values()}) > 1  # random among equals
    for order in orders.values():
        assert len(order) == len(set(order)) == 20
        distance = [int(v[0]) + int(v[1]) for v in order]
        assert distance == sorted(distance)
        # a queue serves the children of earlier parents first
        parents = []
        for i, v in enumerate(order[1:], 1):
            parents.append(min(order.index(p) for p in near[v] if p in order[:i]))
        assert parents == sorted(parents)


def test_depth_first_follows_the_newest_open_node(spark, edges, ids):
    near = neighbours(GRID)
    graph = T.adjacency(ids(sorted(near)), edges(*GRID))
    got = T.depth_first(start(spark, 12, 15, ["00"]), graph, ["sample_id"], 1)
    for order in by_sample(S.long_form(got, ["sample_id"])).values():
        assert order[0] == "00" and len(order) == len(set(order)) == 15
        for i, v in enumerate(order[1:], 1):
            # the next node hangs on the newest visited node that still has an unseen neighbour
            newest = next(p for p in reversed(order[:i]) if near[p] - set(order[:i]))
            assert v in near[newest]


def test_walk_visits_along_edges(spark, edges, ids):
    near = neighbours(GRID)
    graph = T.adjacency(ids(sorted(near)), edges(*GRID))
    got = T.random_walk(start(spark, 10, 8, ["33"]), graph, ["sample_id"], 4)
    for order in by_sample(S.long_form(got, ["sample_id"])).values():
        assert order[0] == "33" and len(set(order)) == len(order) == 8
        for i, v in enumerate(order[1:], 1):
            assert near[v] & set(order[:i])


def test_two_components_restart_rules(spark, edges, ids):
    # a path of two and a triangle: after a path the queue is bare, after a triangle copies remain
    path = [("a", "b")]
    other = [("x", "y"), ("y", "z"), ("x", "z")]
    graph = T.adjacency(ids("abxyz"), edges(*path, *other))
    keys = ["sample_id"]
    from_path = T.breadth_first(start(spark, 4, 5, ["a"]), graph, keys, 1)
    assert all(len(r["visited"]) == 5 for r in from_path.collect())  # restarted in the triangle
    from_triangle = T.breadth_first(start(spark, 4, 5, ["x"]), graph, keys, 1)
    assert all(len(r["visited"]) == 3 for r in from_triangle.collect())  # left to the fill
    filled = T.fill(from_triangle, graph, keys, 1).collect()
    assert all(len(set(r["visited"])) == 5 for r in filled)
    always = T.breadth_first(start(spark, 4, 5, ["x"]), graph, keys, 1, always_restart=True)
    assert all(len(set(r["visited"])) == 5 for r in always.collect())
    for emit in ("visit", "push"):
        deep = T.depth_first(start(spark, 4, 5, ["a"]), graph, keys, 1, emit=emit)
        assert all(len(set(r["visited"])) == 5 for r in deep.collect())
    deep = T.depth_first(start(spark, 4, 5, ["x"]), graph, keys, 1)
    assert all(len(r["visited"]) == 3 for r in deep.collect())
    push = T.depth_first(start(spark, 4, 5, ["x"]), graph, keys, 1, emit="push")
    assert all(len(set(r["visited"])) == 5 for r in push.collect())


def test_walk_from_an_isolated_node_goes_on(spark, edges, ids):
    graph = T.adjacency(ids("abc"), edges("bc"))
    got = T.random_walk(start(spark, 6, 3, ["a"]), graph, ["sample_id"], 2)
    assert all(sorted(r["visited"]) == ["a", "b", "c"] for r in got.collect())


def test_hub_with_more_neighbours_than_are_looked_at(spark, edges, ids):
    leaves = [f"l{i:04d}" for i in range(600)]
    graph = T.adjacency(ids([*leaves, "hub"]), edges(*[("hub", x) for x in leaves]))
    got = T.breadth_first(start(spark, 30, 10, ["hub"]), graph, ["sample_id"], 1)
    seen = Counter()
    for order in by_sample(S.long_form(got, ["sample_id"])).values():
        assert len(set(order)) == 10
        seen.update(order[1:])
    assert len(seen) > 200  # spread over the leaves


def test_samplers_for_every_strategy(spark, edges, ids):
    graph = T.adjacency(ids(sorted(neighbours(GRID))), edges(*GRID))
    for name in ("bfs", "mixed"):
        got = by_sample(S.training_samples(spark, graph, 9, 3, 5, name, 3))
        assert len(got) == 9 and all(3 <= len(v) <= 5 and len(set(v)) == len(v) for v in got.values())
    assert got == by_sample(S.training_samples(spark, graph, 9, 3, 5, "MIXED", 3))
    with pytest.raises(ValueError):
        S.training_samples(spark, graph, 1, 4, 9, "other", 3)
    with pytest.raises(ValueError):
        S.training_samples(spark, graph, 1, 40, 90, "BFS", 3)


def test_size_buckets_leave_out_what_does_not_fit(spark, edges, ids):
    graph = T.adjacency(ids("abcd"), edges("ab", "cd"))
    rows = S.evaluation_samples(spark, graph, 1, "BFS", [3, 50], 2).collect()
    assert {r["node_size"] for r in rows} == {3}
    rows = S.evaluation_samples(spark, graph, 1, "BFS", [50], 2).collect()
    assert Counter(r["node_size"] for r in rows) == {4: 8}


def packed(df):
    out = defaultdict(list)
    for r in df.orderBy("chunk", "place").collect():
        out[r["chunk"]].append((r["u"], r["v"]))
    return out


def test_rests_of_slices_are_packed_together(spark):
    rows = [(f"a{i % 211}", f"b{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "u string, v string")
    chunks = packed(V.partition_edges(df, 40, 60, 5, 50))  # 64 slices
    assert sorted(e for es in chunks.values() for e in es) == sorted(rows)
    ends = {c: {x for e in es for x in e} for c, es in chunks.items()}
    assert all(len(es) <= 40 and len(ends[c]) <= 60 for c, es in chunks.items())
    # Chunks end at either budget; few are open at both, not one for each slice.
    assert sum(len(es) < 40 and len(ends[c]) < 59 for c, es in chunks.items()) <= 64 / 16
    assert chunks == packed(V.partition_edges(df.repartition(7), 40, 60, 5, 50))
    # On a small table chunks are as full as one scan makes them.
    assert len(packed(V.partition_edges(df.limit(400), 40, 1000, 5))) == 10


def test_edge_chunks_respect_both_budgets(spark, edges):
    loose = [(f"a{i}", f"b{i}") for i in range(100)]
    for slice_edges in (8192, 6):
        chunks = packed(V.partition_edges(edges(*loose), 885, 60, 1, slice_edges))
        assert sum(map(len, chunks.values())) == 100
        assert all(len({x for e in c for x in e}) <= 60 for c in chunks.values())
        assert sorted(chunks) == list(range(len(chunks)))
    one = packed(V.partition_edges(edges("ab", "bc", "cd", "de"), 1, 30, 1))
    assert sorted(len(c) for c in one.values()) == [1, 1, 1, 1]
    with pytest.raises(ValueError):
        V.partition_edges(edges("ab"), 0, 30, 1)


def test_chunk_size_rule():
    assert V.default_chunk_size(60) == 885 and V.default_chunk_size(2) == 1
    assert V.epoch_chunk_size(100, 885, 10) == 10
    assert V.epoch_chunk_size(100, 5, 10) == 5
    assert V.epoch_chunk_size(5, 885, 10) == 885
    assert V.epoch_chunk_size(100, 885, 0) == 885


@pytest.mark.parametrize("strategy", ["BFS", "MIXED"])
def test_epoch_plan_covers_every_edge_once(spark, edges, ids, strategy):
    near = neighbours(GRID)
    negatives = edges(("00", "55"), ("01", "54"), ("02", "53"), ("03", "52"))
    plan = plan_epoch(
        ids(sorted(near)), edges(*GRID), 4, 6, 9, strategy, 5, negatives=negatives, negative_ratio=2
    )
    summary = plan.summary.first()
    assert summary["total_edges"] == summary["covered_edges"] == len(GRID)
    assert summary["coverage"] == 1.0 and summary["mean_reuse"] == 1.0
    nodes = by_sample(plan.nodes, "chunk")
    for row in plan.positives.collect():
        assert {row["u"], row["v"]} <= set(nodes[row["chunk"]])
    assert all(len(set(v)) == len(v) and 6 <= len(v) <= 9 for v in nodes.values())
    dealt = [(r["u"], r["v"]) for r in plan.negatives.collect()]
    assert len(dealt) == len(set(dealt)) == 4
    counters = V.epoch_counters(plan.nodes, plan.positives, plan.negatives, 2).first()
    assert counters["positive_pairs"] == len(GRID) and counters["negative_pairs"] == 4
    assert counters["all_pairs"] == sum(len(v) * (len(v) - 1) // 2 for v in nodes.values())


def test_epoch_plan_without_edges_is_plain_sampling(spark, edges, ids):
    plan = plan_epoch(ids("abcdef"), edges("ab").filter("false"), 3, 2, 4, "BFS", 1)
    assert len(by_sample(plan.nodes, "chunk")) == 3
    assert plan.summary.first()["coverage"] == 1.0


def test_negatives_are_dealt_in_slices(spark, edges):
    chunks = spark.createDataFrame([(0, "a", "b"), (1, "b", "c")], "chunk long, u string, v string")
    negatives = edges("ax", "ay", "bx", "by")
    got = V.assign_negatives(chunks, negatives, 2, 1).collect()
    assert Counter(r["chunk"] for r in got) == {0: 2, 1: 2}
    assert len({(r["u"], r["v"]) for r in got}) == 4
    short = V.assign_negatives(chunks, negatives, 3, 1).collect()
    assert Counter(r["chunk"] for r in short) == {0: 3, 1: 1}
    assert V.assign_negatives(chunks, negatives, 0, 1).count() == 0


def test_exclusive_negatives_of_three_splits(spark, ids):
    names = [f"p{i:02d}" for i in range(16)]
    def table(*pairs):
        return spark.createDataFrame(list(pairs), "u string, v string")
    positives = {
        "train": table(("p00", "p01"), ("p00", "p01")),  # a repeat counts
        "valid": table(("p02", "p03"), ("p04", "p05")),
        "test": table(("p06", "p07"), ("p08", "p09"), ("p10", "p11"), ("p12", "p13")),
    }
    old = table(("p00", "p02"), ("p01", "p03"))
    rows = N.supervision_rows(positives, ids(names), None, old, 5, 3).collect()
    made = defaultdict(set)
    for r in rows:
        if r["label"] == 0:
            made[r["split"]].add((r["u"], r["v"]))
    assert {k: len(v) for k, v in made.items()} == {"train": 10, "valid": 10, "test": 20}
    every = [e for v in made.values() for e in v]
    assert len(set(every)) == 40 and all(a < b for a, b in every)
    known = {(f"p{i:02d}", f"p{i + 1:02d}") for i in range(0, 14, 2)} | {("p00", "p02"), ("p01", "p03")}
    assert not known & set(every)
    assert sum(r["label"] for r in rows) == 8


def test_negatives_that_do_not_exist_are_an_error(spark, ids, edges):
    with pytest.raises(ValueError):
        N.draw_pairs(ids("abc"), 4, 1)
    with pytest.raises(ValueError):
        N.draw_pairs(ids("abc"), 2, 1, edges("ab", "ac"))
    assert N.draw_pairs(ids("abc"), 1, 1, edges("ab", "ac")).count() == 1


def labels(spark, pos, neg):
    return spark.range(pos + neg).select(F.col("id").alias("row_id"), (F.col("id") < pos).cast("int").alias("label"))


def shapes(plan, key="batch"):
    out = defaultdict(lambda: [0, 0])
    for r in plan.collect():
        out[r[key]][0 if r["label"] else 1] += 1
    return [tuple(out[k]) for k in sorted(out)]


def test_ratio_batches(spark):
    rows = labels(spark, 10, 7)
    assert shapes(B.ratio_batches(rows, 16, 3.0)) == [(4, 12), (4, 12), (2, 6)]
    assert shapes(B.ratio_batches(rows, 16, 3.0, drop_last=True)) == [(4, 12), (4, 12)]
    plan = B.ratio_batches(rows, 16, 3.0).filter("label = 1")
    assert plan.select("row_id").distinct().count() == 10
    with pytest.raises(ValueError):
        B.ratio_batches(labels(spark, 3, 0), 16)


def test_warmup_batches_stop_with_the_negatives(spark):
    assert shapes(B.warmup_batches(labels(spark, 10, 100), 8, 1.0)) == [(4, 4), (4, 4), (2, 2)]
    assert shapes(B.warmup_batches(labels(spark, 10, 9), 8, 1.0)) == [(4, 4), (4, 4)]
    assert shapes(B.warmup_batches(labels(spark, 10, 5), 8, 1.0)) == [(4, 4)]
    plan = B.warmup_batches(labels(spark, 10, 100), 8, 1.0)
    assert plan.count() == plan.select("row_id").distinct().count()


def test_mining_pools(spark):
    plan = B.mining_pools(labels(spark, 20, 80), 5, 4)
    assert shapes(plan, "pool") == [(4, 16)] * 5
    assert plan.count() == plan.select("row_id").distinct().count() == 100
    assert B.pool_counts(3, 2, 10) == (3, 2)


def test_hardest_rows(spark):
    rows = spark.createDataFrame(
        [(0, i, x) for i, x in enumerate([0.2, 1.5, 0.7, 2.2, 0.1])], "pool int, row_id int, loss double"
    )
    got = [r["row_id"] for r in M.hardest(rows, 0.4).orderBy("place").collect()]
    assert got == [3, 1]
    with pytest.raises(ValueError):
        M.hardest(rows, 0.0)


def test_hardest_rows_under_a_cap(spark):
    def rows(*items):
        return spark.createDataFrame(list(items), "pool int, row_id int, loss double, a int, b int")
    got = M.hardest_capped(rows((0, 0, 3.0, 0, 1), (0, 1, 2.0, 0, 2), (0, 2, 1.0, 0, 3), (0, 3, 0.5, 3, 4)), 3, 2)
    assert [r["row_id"] for r in got.orderBy("place").collect()] == [0, 1, 3]
    # a pair of an id with itself counts twice; the fill takes what was passed over
    got = M.hardest_capped(rows((0, 0, 3.0, 5, 5), (0, 1, 2.0, 5, 6), (0, 2, 1.0, 6, 6)), 3, 2)
    assert [r["row_id"] for r in got.orderBy("place").collect()] == [0, 2, 1]


def test_rounds_leave_the_graph_in_place(spark):
    from graphrecon.operators import traversal as W

    edges = spark.range(300).select(F.concat(F.lit("n"), "id").alias("u"), F.concat(F.lit("n"), F.col("id") * 7 % 300).alias("v"))
    edges = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    nodes = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    graph = W.adjacency(nodes, edges)
    front = nodes.limit(5).select(F.lit(1).alias("k"), F.lit(4).alias("target"), F.array("id").alias("visited"), F.lit(0).alias("p"), "id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pushed = W._pushes(front, graph, ["k"], 1, 1)
        plan = pushed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scans = [line for line in plan.splitlines() if "Scan ExistingRDD" in line and ("nbr" in line or "degree" in line)]
    lines = plan.splitlines()
    assert len(scans) == 2
    for scan in scans:
        above = lines[lines.index(scan) - 1]
        assert "Exchange" not in above and "Sort" not in above


def test_hub_is_split_before_cells_are_dealt_out(spark, monkeypatch):
    hub, count = F.lit("hub"), 20_000
    edges = spark.range(0, count, 1, 8).select(hub.alias("u"), F.concat(F.lit("l"), "id").alias("v"))
    nodes = edges.select(F.col("v").alias("id")).union(edges.select("u").distinct())
    low = {
        "autoBroadcastJoinThreshold": "-1",
        "adaptive.coalescePartitions.enabled": "false",
        "adaptive.advisoryPartitionSizeInBytes": "16k",
        "adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    largest, deal = {}, T.materialize_by

    def dealt(df, column):
        before = spark.conf.get("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        part = df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count"))
        largest[column] = part.first()[0]
        spark.conf.set("spark.sql.adaptive.enabled", before)
        return deal(df, column)

    monkeypatch.setattr(T, "materialize_by", dealt)
    before = {k: spark.conf.get(f"spark.sql.{k}", None) for k in low}
    for k, v in low.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        graph = T.adjacency(nodes, edges)
        cells = graph.cells
        assert cells.count() == 2 * count and cells.where(F.col("nbr") == hub).count() == count
    finally:
        for k, v in before.items():
            spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)
    assert largest["at"] < count  # all of them in one part before


def test_closing_test_never_lists_a_hub(spark):
    # A hub of 200,000 neighbours and a triangle beside it; "n" is the hub's, so its walk is open.
    hub = spark.range(200_000).select(F.concat(F.lit("h"), F.col("id")).alias("v"), F.lit("hub").alias("u"))
    small = spark.createDataFrame([("x", "y"), ("y", "z"), ("x", "z")], "u string, v string")
    edges = hub.select("u", "v").union(small)
    graph = T.adjacency(G.endpoints(edges), edges)
    rows = [(0, 5, ["hub", "h1"]), (1, 5, ["x", "y", "z"]), (2, 5, ["x", "y"]), (3, 5, ["h7", "hub"])]
    state = spark.createDataFrame(rows, "sample_id int, target int, visited array<string>")
    closed = T._closed(state, graph, ["sample_id"])
    assert [r["sample_id"] for r in closed.collect()] == [1]


def test_walk_and_search_laws(spark, edges, ids):
    """From the middle of a cross of unequal arms each neighbour comes first equally often; long samples take few jobs."""
    star = [("m", x) for x in "abcd"] + [("d", "e"), ("e", "m")]
    graph = T.adjacency(ids(list("mabcde")), edges(*star))
    for walk in (T.random_walk, T.depth_first):
        got = by_sample(S.long_form(walk(start(spark, 600, 2, ["m"]), graph, ["sample_id"], 11), ["sample_id"]))
        firsts = Counter(order[1] for order in got.values())
        assert set(firsts) == set("abcde") and all(75 < n < 165 for n in firsts.values())
    path = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(260)]
    line = T.adjacency(ids([f"p{i:03d}" for i in range(261)]), edges(*path))
    tracker = spark.sparkContext.statusTracker()
    for walk in (T.depth_first,):
        spark.sparkContext.setJobGroup("laws", "")
        got = by_sample(S.long_form(walk(start(spark, 3, 60, ["p000"]), line, ["sample_id"], 5), ["sample_id"]))
        jobs = len(tracker.getJobIdsForGroup("laws"))
        spark.sparkContext.setJobGroup("", "")
        assert all(order == sorted(order) and len(order) == 60 for order in got.values())
        assert jobs < 200


def test_hard_examples_of_an_epoch(spark):
    rows = spark.createDataFrame([(0, 0, 3.0, 1, 2), (0, 1, 9.0, 1, 3), (0, 2, 5.0, 1, 4), (1, 3, 1.0, 5, 6)], "pool int, row_id int, loss double, a int, b int")

    def chosen(df, **options):
        found = M.hard_examples(df, 2, 1, **options).orderBy("pool", "place").collect()
        return [(r["pool"], r["row_id"], r["place"]) for r in found]

    assert chosen(rows, epoch=0, warmup_epochs=1) == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 3, 1)]
    assert chosen(rows.drop("a", "b"), epoch=1, warmup_epochs=1) == [(0, 1, 1), (0, 2, 2), (1, 3, 1)]
    assert chosen(rows, epoch=1, warmup_epochs=1) == [(0, 1, 1), (0, 2, 2), (1, 3, 1)]
    with pytest.raises(ValueError):
        M.hard_examples(rows, 2, 1, warmup_epochs=-1)


@pytest.mark.parametrize("name, writes", [("n1_exclusive_negatives", 1), ("n2_three_splits", 0)])
def test_drawn_negatives_are_not_written_again(spark, sf, monkeypatch, name, writes):
    from graphrecon.catalog import QUERIES, planning

    written = []
    monkeypatch.setattr(planning, "materialize", lambda df: written.append(df) or materialize(df))
    QUERIES[name](spark, sf)
    assert len(written) == writes


def test_searches_leave_only_their_last_state_on_disk(spark, edges, ids):
    graph = T.adjacency(ids(sorted(neighbours(GRID))), edges(*GRID))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    got = T.breadth_first(start(spark, 3, 16, ["00"]), graph, ["sample_id"], 1)
    assert all(len(r["visited"]) == 16 for r in got.collect())
    assert len(set(os.listdir(folder)) - before) == 1  # one a round before


def test_levels_are_served_only_until_a_node_completes_the_sample(spark, edges, ids):
    # "b" has six neighbours, so a sample of five nodes is full before "c" and "d" are looked at
    star = [("b", f"x{i}") for i in range(6)] + [("a", "y"), ("c", "z"), ("d", "z")]
    graph = T.adjacency(ids(["a", "b", "c", "d", "y", "z", *[f"x{i}" for i in range(6)]]), edges(*star), walks=False)
    assert graph.cells.columns == ["at", "nbr"]
    level = spark.createDataFrame([(0, 5, p, x) for p, x in enumerate("abcd")], "sample_id int, target int, p int, id string")
    assert [r["id"] for r in T._served(level, graph, ["sample_id"]).orderBy("p").collect()] == ["a", "b"]
    wide = level.withColumn("target", F.lit(7))
    assert [r["id"] for r in T._served(wide, graph, ["sample_id"]).orderBy("p").collect()] == list("abcd")
    got = T.breadth_first(start(spark, 9, 5, list("abcd")), graph, ["sample_id"], 1)
    assert all(r["visited"] == [*"abcd", "y"] for r in got.collect())
    assert T._pushes(level.filter("id = 'b'"), graph, ["sample_id"], 1, 1).count() == 5


def test_fill_of_single_nodes_moves_no_edge(spark, sf, monkeypatch):
    from graphrecon.catalog import QUERIES, planning

    monkeypatch.setattr(planning, "adjacency", lambda *_: pytest.fail("edges are moved"))
    assert QUERIES["n6_fallback_fill"](spark, sf).first()["repeated"] == 0


def test_repeated_and_turned_edges_are_one_cell_each(spark, edges, ids):
    once = T.adjacency(ids("abcd"), edges("ab", "bc", "cc"))
    raw = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b"), ("c", "c"), ("c", "c"), ("a", "b")], "u string, v string")
    many = T.adjacency(ids("abcd"), raw)
    for graph in (once, many):
        assert graph.cells.columns == ["at", "nbr"]  # a neighbour's own place is looked up by the samples that need it
        assert [tuple(r) for r in graph.cells.orderBy("at").collect()] == [(0, "b"), (1, "a"), (2, "c"), (3, "b"), (4, "c")]
        assert [tuple(r) for r in graph.spans.orderBy("id").collect()] == [("a", 0, 1), ("b", 1, 2), ("c", 3, 2), ("d", 0, 0)]


def test_chunks_are_not_written_twice_nor_keys_of_full_ones(spark, sf, monkeypatch):
    from graphrecon.catalog import QUERIES, planning

    monkeypatch.setattr(planning, "materialize", lambda *_: pytest.fail("chunks are written again"))
    written, write = [], V.write_down
    monkeypatch.setattr(V, "write_down", lambda df: written.append(write(df)) or written[-1])
    row = QUERIES["n10_edge_chunks"](spark, sf).first()
    assert row["edges"] == row["distinct_edges"] > 0
    assert all(t.filter("not rest and key is not null").isEmpty() and t.filter("rest and key is null").isEmpty() for t in written)


def test_draws_are_different_pairs_and_all_of_them(spark, ids, edges):
    for pool in (2, 3, 9, 16, 17):
        found = [tuple(r) for r in N._numbered_pairs(spark, N._all_draws(pool), pool, 5).orderBy("rank").select("ia", "ib", "rank").collect()]
        assert {f[:2] for f in found} == set(itertools.combinations(range(pool), 2))
        assert [f[2] for f in found] == list(range(pool * (pool - 1) // 2))
    later = [r["ib"] for s in range(40) for r in N._numbered_pairs(spark, 64, 16, s).filter("rank < 4").collect()]
    assert 9.3 < sum(later) / len(later) < 11.4  # 10 1/3 where all pairs are as likely
    drawn = N.draw_pairs(ids([f"n{i}" for i in range(9)]), 30, 1, edges(*[(f"n{i}", f"n{i + 1}") for i in range(6)]))  # all that are free
    assert drawn.select("u", "v").distinct().count() == 30
    ranks = sorted(r["rank"] for r in drawn.collect())
    cuts = N.rank_cuts(drawn, [0, 7, 30])
    assert [sum(r < c for r in ranks) for c in cuts] == [0, 7, 30]


def test_core_nodes_take_one_shuffle(spark):
    rows = [(0, "b", "c", 1), (0, "a", "b", 0), (1, "z", "z", 0), (0, "a", "d", 2)]
    chunks = spark.createDataFrame(rows, "chunk long, u string, v string, place int")
    core = V.core_nodes(chunks)
    assert {r["chunk"]: r["visited"] for r in core.collect()} == {0: ["a", "b", "c", "d"], 1: ["z"]}
    assert core._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
