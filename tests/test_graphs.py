import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphrecon.operators import compare as C
from graphrecon.operators import graph as G
from graphrecon.operators import pairs as P
from graphrecon.operators import soft as S
from graphrecon.plans import topology as T


def samples(spark, *lists):
    rows = [(len(ids), s, p, i) for s, ids in enumerate(lists) for p, i in enumerate(ids)]
    return spark.createDataFrame(rows, "node_size int, sample_id int, pos int, id string")


def details(spark, ids, true, pred, nodes, pred_nodes=None):
    result = T.evaluate_graph(
        ids(nodes), true, pred, samples(spark, nodes), mmd=False, pred_nodes=pred_nodes
    )
    return result.details.first()


def test_similarity_and_density_of_small_graphs(spark, edges, ids):
    row = details(spark, ids, edges("AB", "BC"), edges("AB", "AC"), "ABC")
    assert row["graph_sim"] == 0.5 and row["relative_density"] == 1.0
    row = details(spark, ids, edges("AB", "BC"), edges("AB"), "ABC", ids("ABC"))
    assert row["relative_density"] == 0.5


def test_similarity_counts_a_loop_once(spark, edges, ids):
    row = details(spark, ids, edges("AB", "AA"), edges("AB"), "AB")
    assert math.isclose(row["graph_sim"], 1 - 1 / 5)


def test_density_without_true_edges(spark, edges, ids):
    none = edges("AB").filter("false")
    assert details(spark, ids, none, edges("AB"), "ABC")["relative_density"] == math.inf
    both = details(spark, ids, none, none, "ABC")
    assert both["relative_density"] == 1.0 and both["graph_sim"] == 1.0


def test_node_policy(spark, ids):
    few, many = ids("AB"), ids("BCD")
    assert G.add_missing_nodes(few, many).count() == 4  # strictly fewer: completed
    assert {r["id"] for r in G.add_missing_nodes(many, few).collect()} == set("BCD")
    assert G.add_missing_nodes(many, few, "union").count() == 4


def test_degree_with_loop_and_isolated_node(edges, ids):
    got = {r["id"]: r["degree"] for r in G.degrees(edges("AB", "AA"), ids("ABC")).collect()}
    assert got == {"A": 3, "B": 1, "C": 0}


def random_graph(n, p, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(n)]
    return names, [e for e in itertools.combinations(names, 2) if rng.random() < p]


def brute_clustering(names, pairs):
    near = {x: set() for x in names}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for x in names:
        d = len(near[x])
        t = sum(1 for a, b in itertools.combinations(near[x], 2) if b in near[a])
        out[x] = (t, 0.0 if d < 2 else 2.0 * t / (d * (d - 1)))
    return out


@pytest.mark.parametrize("p,seed", [(0.1, 1), (0.4, 2), (1.0, 3)])
def test_clustering_and_its_histogram_against_brute_force(spark, edges, ids, p, seed):
    names, pairs = random_graph(30, p, seed)
    local = G.local_clustering(ids(names), edges(*pairs, (names[0], names[0])))
    got = {r["id"]: (r["triangles"], r["clustering"]) for r in local.collect()}
    want = brute_clustering(names, pairs)
    assert got == want
    bars = {r["bin"]: r["cnt"] for r in C.clustering_histogram(local, []).collect()}
    counts, _ = np.histogram([c for _, c in want.values()], bins=100, range=(0.0, 1.0))
    assert bars == {int(b): float(counts[b]) for b in np.flatnonzero(counts)}


def test_clustering_bins_match_numpy_on_every_fraction(spark):
    rows = [(t, d) for d in range(0, 40) for t in range(0, d * (d - 1) // 2 + 1)]
    df = spark.createDataFrame(rows, "t long, d long")
    bins = [r[0] for r in df.select(C.clustering_bin(F.col("t"), F.col("d"))).collect()]
    for (t, d), b in zip(rows, bins):
        c = 0.0 if d < 2 else 2 * t / (d * (d - 1))
        assert np.histogram([c], bins=100, range=(0.0, 1.0))[0][b] == 1, (t, d, b)


def test_hub_holding_a_third_of_all_edges(spark, edges, ids):
    names = [f"n{i:03d}" for i in range(150)]
    pairs = [("hub", x) for x in names] + list(zip(names, names[1:])) + list(zip(names, names[2:]))
    got = {r["id"]: r["triangles"] for r in G.triangle_corners(edges(*pairs)).collect()}
    want = {k: t for k, (t, _) in brute_clustering([*names, "hub"], pairs).items()}
    assert got == want


@pytest.mark.parametrize("colours", [1, 2, 5])
def test_triangles_of_any_number_of_colours(spark, edges, colours):
    rng = np.random.default_rng(4)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 40, (300, 2)).tolist()}
    pairs = [(f"n{a}", f"n{b}") for a, b in pairs]
    got = {r["id"]: r["triangles"] for r in G.triangle_corners(edges(*pairs), colours=colours).collect()}
    loopless = [p for p in pairs if p[0] != p[1]]
    want = {k: t for k, (t, _) in brute_clustering(sorted({x for p in pairs for x in p}), loopless).items() if t}
    assert got == want
    dealt = G.colour_triples(edges(*loopless).selectExpr("xxhash64(u) AS u", "xxhash64(v) AS v"), colours)
    assert dealt.count() == colours * len(loopless)


@pytest.mark.parametrize("most_later", [1, 3, 64])
def test_triangles_by_ordered_neighbours(spark, edges, most_later):
    rng = np.random.default_rng(5)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 60, (400, 2)).tolist() if p[0] != p[1]}
    pairs |= {(0, x) for x in range(1, 60)} | {(100, 101)}
    pairs = [(f"n{a}", f"n{b}") for a, b in pairs]
    got = {r["id"]: r["triangles"] for r in G._ordered_triangles(edges(*pairs), most_later).collect()}
    want = {k: t for k, (t, _) in brute_clustering(sorted({x for p in pairs for x in p}), pairs).items() if t}
    assert got == want


def test_edges_of_a_sparse_graph_are_not_copied_per_colour(spark, edges, monkeypatch):
    monkeypatch.setattr(G, "TRIPLE_EDGES", 1)
    monkeypatch.setattr(G, "colour_triples", lambda *_: pytest.fail("edges copied"))
    got = {r["id"]: r["triangles"] for r in G.triangle_corners(edges("AB", "BC", "AC", "CD")).collect()}
    assert got == {"A": 1, "B": 1, "C": 1}


def test_traces_equal_the_eigenvalues(spark, edges, ids):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "d"), ("e", "e")]
    nodes, es = ids(list("abcdef")), edges(*pairs)
    row = C.laplacian_traces(nodes, es).first()
    both = [x.withColumn("g", F.lit(1)) for x in (nodes, es)]
    values = C.spectra(*both, ["g"]).first()["eigenvalues"]
    assert row["trace"] == pytest.approx(sum(values)) and row["trace_squared"] == pytest.approx(sum(x * x for x in values))
    grouped = C.laplacian_traces(*both, ["g"]).first()
    assert (grouped["trace"], grouped["trace_squared"]) == pytest.approx((row["trace"], row["trace_squared"]))


def test_dense_spectra_are_bounded(spark, edges, ids, monkeypatch):
    monkeypatch.setattr(C, "MOST_NODES", 2)
    one = [x.withColumn("g", F.lit(1)) for x in (ids("abc"), edges("ab"))]
    with pytest.raises(Exception, match="3 nodes"):
        C.spectral_histogram(*one, ["g"]).collect()


def test_pairs_inside_samples_only(spark):
    from graphrecon.operators.vectors import sampled_similarities

    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [0.0, 2.0])], "id int, x array<double>")
    samples = spark.createDataFrame([(2, 0, 0, 1), (2, 0, 1, 2), (2, 1, 0, 4), (2, 1, 1, 3)], "node_size int, sample_id int, pos int, id int")
    got = {(r["sample_id"], r["u"], r["v"]): r["x"] for r in sampled_similarities(samples, vectors, ["x"]).collect()}
    assert got == {(0, 1, 2): pytest.approx(0.5**0.5), (1, 3, 4): 0.0}


def test_spectral_histogram(spark, edges, ids):
    graph = {"path": [("a", "b"), ("b", "c")], "full": [("a", "b"), ("b", "c"), ("a", "c")], "none": []}
    nodes = spark.createDataFrame([(k, x) for k in graph for x in "abc"], "sample_id string, id string")
    rows = [(k, a, b) for k, es in graph.items() for a, b in es]
    es = spark.createDataFrame(rows, "sample_id string, u string, v string")
    got = {
        r["sample_id"]: {h["bin"]: h["cnt"] for h in r["hist"]}
        for r in C.spectral_histogram(nodes, es, ["sample_id"]).collect()
    }
    # eigenvalues 0, 1, 2 / 0, 1.5, 1.5 / 0, 0, 0
    def share(values):
        counts, _ = np.histogram(values, bins=200, range=(-1e-5, 2))
        return {int(b): counts[b] / max(1, counts.sum()) for b in np.flatnonzero(counts)}

    assert got["full"] == pytest.approx(share([0, 1.5, 1.5]))
    assert got["none"] == pytest.approx(share([0, 0, 0]))
    assert got["path"][0] == pytest.approx(1 / 3, abs=0.2)


def brute_mmd(xs, ys):
    width = max(len(h) for h in xs + ys)

    def norm(h):
        h = np.pad(np.asarray(h, float), (0, width - len(h)))
        return h / (h.sum() + 1e-6)

    def disc(a, b):
        if not a or not b:
            return 1e6
        k = [math.exp(-((np.abs(x - y).sum() / 2) ** 2) / 2) for x in a for y in b]
        return sum(k) / len(k)

    xs, ys = [norm(x) for x in xs], [norm(y) for y in ys]
    return disc(xs, xs) + disc(ys, ys) - 2 * disc(xs, ys)


@pytest.mark.parametrize("block_rows", [3, 64])
def test_mmd_against_brute_force_in_any_blocks(spark, block_rows):
    rng = random.Random(5)
    sides = {s: [[rng.randrange(6) for _ in range(rng.randrange(2, 9))] for _ in range(9)] for s in ("true", "pred")}
    rows = [
        (4, s, i, [(b, float(c)) for b, c in enumerate(h) if c])
        for s, hists in sides.items()
        for i, h in enumerate(hists)
    ]
    df = spark.createDataFrame(rows, f"node_size int, side string, sample_id int, hist {C.HISTOGRAM}")
    got = C.mmd(C.kernel_sums(df, ["node_size"], block_rows=block_rows), ["node_size"]).first()["mmd"]
    assert got == pytest.approx(brute_mmd(sides["true"], sides["pred"]))
    only = C.mmd(C.kernel_sums(df.filter("side = 'true'"), ["node_size"]), ["node_size"]).first()["mmd"]
    assert only == pytest.approx(brute_mmd(sides["true"], []), rel=1e-9)


def test_histograms_move_in_blocks(spark):
    rows = spark.range(400).select(
        F.lit(4).alias("node_size"),
        F.lit("true").alias("side"),
        F.col("id").alias("sample_id"),
        F.array(F.struct((F.col("id") % 5).cast("int").alias("bin"), F.lit(2.0).alias("cnt"))).alias("hist"),
    )
    moved = C._block_pairs(rows, ["node_size"], 64).select("hists").collect()
    assert len(moved) == 7 * 7  # 400 * 7 histograms one by one before
    assert sum(len(r["hists"]) for r in moved) == 400 * 7


def test_whole_evaluation_against_brute_force(spark, edges, ids):
    names, true = random_graph(24, 0.3, 7)
    _, pred = random_graph(24, 0.3, 8)
    pred = [e for e in pred if "n03" not in e]  # a node the prediction lacks
    rng = random.Random(2)
    lists = [rng.sample(names, 8) for _ in range(5)] + [rng.sample(names, 12) for _ in range(5)]
    result = T.evaluate_graph(ids(names), edges(*true), edges(*pred), samples(spark, *lists))
    sims, ratios = {}, {}
    hists = {}
    for i, nodes in enumerate(lists):
        inside = lambda es: [e for e in es if e[0] in nodes and e[1] in nodes]
        t, p = inside(true), inside(pred)
        n, diff = len(nodes), len(set(t) ^ set(p))
        sims[i] = 1 - diff / (len(t) + len(p)) if t or p else 1.0
        ratios[i] = len(p) / len(t) if t else (math.inf if p else 1.0)
        for side, es in (("true", t), ("pred", p)):
            degree = {x: 0 for x in nodes}
            for a, b in es:
                degree[a] += 1
                degree[b] += 1
            hists.setdefault(("degree", n, side), []).append(np.bincount(list(degree.values())))
            cc = [c for _, c in brute_clustering(nodes, es).values()]
            hists.setdefault(("clustering", n, side), []).append(np.histogram(cc, bins=100, range=(0, 1))[0])
    got = {r["sample_id"]: r for r in result.details.collect()}
    for i in sims:
        assert got[i]["graph_sim"] == pytest.approx(sims[i])
        assert got[i]["relative_density"] == pytest.approx(ratios[i])
    rows = {r["node_size"]: r for r in result.per_size.collect()}
    for n in (8, 12):
        for metric, column in (("degree", "deg_dist_mmd"), ("clustering", "cc_mmd")):
            want = brute_mmd(hists[(metric, n, "true")], hists[(metric, n, "pred")])
            assert rows[n][column] == pytest.approx(want)
        assert rows[n]["laplacian_eigen_mmd"] is not None
    summary = result.summary.first()
    assert summary["graph_count"] == 10
    assert summary["graph_sim"] == pytest.approx(np.mean(list(sims.values())))
    assert summary["cc_mmd"] == pytest.approx((rows[8]["cc_mmd"] + rows[12]["cc_mmd"]) / 2)
    parts = [T.evaluate_graph(ids(names), edges(*true), edges(*pred), samples(spark, *half)) for half in (lists[:5], lists[5:])]
    merged = T.merge_results(parts).summary.first()
    for name in ("graph_sim", "deg_dist_mmd", "cc_mmd", "laplacian_eigen_mmd"):
        assert merged[name] == pytest.approx(summary[name])
    with pytest.raises(ValueError):
        T.merge_results([parts[0], parts[0]])


def soft_case(spark, p_edges, y_edges, nodes="abc"):
    rows = [
        (0, a, b, float((a, b) in p_edges), float((a, b) in y_edges))
        for a, b in itertools.combinations(nodes, 2)
    ]
    pairs = spark.createDataFrame(rows, "sample_id int, a string, b string, p double, y double")
    sizes = spark.createDataFrame([(0, len(nodes))], "sample_id int, n int")
    return pairs, sizes


def test_soft_terms_of_path_and_other_path(spark):
    pairs, sizes = soft_case(spark, {("a", "b"), ("a", "c")}, {("a", "b"), ("b", "c")})
    row = S.topology_losses(pairs, sizes, ["sample_id"]).first()
    assert row["graph_similarity"] == pytest.approx(0.5, abs=1e-6)
    assert row["relative_density"] == pytest.approx(0.0, abs=1e-9)
    assert row["degree_mmd"] == pytest.approx(0.0, abs=1e-9)
    assert row["clustering_mmd"] == pytest.approx(0.0, abs=1e-9)
    assert row["total_topology"] == pytest.approx(0.25, abs=1e-6)


def test_soft_density_forms(spark):
    row = spark.range(1).select(
        S.density_penalty(F.lit(0.3), F.lit(0.0)).alias("empty"),
        S.density_penalty(F.lit(0.4), F.lit(0.2), "squared_ratio").alias("squared"),
        S.density_penalty(F.lit(0.9), F.lit(0.1)).alias("huber"),
        S.density_penalty(F.lit(0.9), F.lit(0.1), "log_ratio").alias("log"),
    ).first()
    assert row["empty"] == pytest.approx(0.09)
    assert row["squared"] == pytest.approx(1.0, abs=1e-6)
    assert row["huber"] == pytest.approx(math.log(9) - 0.5, abs=1e-6)
    assert row["log"] == pytest.approx(math.log(9) ** 2, abs=1e-5)


def test_soft_clustering_of_a_triangle(spark):
    every = set(itertools.combinations("abc", 2))
    pairs, _ = soft_case(spark, every, {("a", "b")})
    rows = S.soft_clustering(pairs, ["sample_id"]).collect()
    assert all(r["pv"] == pytest.approx(1.0, abs=1e-6) and r["yv"] == 0.0 for r in rows)


def test_subgraph_pairs_labels(spark, edges):
    one = samples(spark, "ABC")
    keys = ["node_size", "sample_id"]
    triangle = edges("AB", "BC", "AC")
    mark = spark.createDataFrame([(3, 0, "A", "B")], "node_size int, sample_id int, u string, v string")
    def rows(*args):
        return sorted(tuple(r)[4:] for r in P.subgraph_pairs(one, *args, keys=keys).collect())
    assert rows(triangle, mark) == [("A", "B", 1, 1, 1), ("A", "C", 1, 0, 0), ("B", "C", 1, 0, 0)]
    neg = mark.withColumn("v", F.lit("C"))
    assert rows(edges("AB"), mark, neg) == [("A", "B", 1, 1, 1), ("A", "C", 0, 0, 1), ("B", "C", 0, 0, 0)]
    assert rows(edges("AB")) == [("A", "B", 1, 1, 1), ("A", "C", 0, 0, 1), ("B", "C", 0, 0, 1)]


def test_vector_graphs_score_pairs_inside_samples_only(spark, sf, monkeypatch):
    from graphrecon.catalog import tables as T

    keys = ["node_size", "sample_id"]
    scored = T.vector_pairs(spark, sf).filter("label = 1").select("u", "v")
    want = {tuple(r) for r in G.induced_edges(T.vector_samples(spark, sf), scored, keys).select("u", "v").collect()}
    monkeypatch.setattr(T, "similarity_blocks", lambda *_: pytest.fail("all pairs scored"))
    _, true, _ = T.vector_graphs(spark, sf)
    rows = [tuple(r) for r in true.collect()]
    assert want and set(rows) == want and len(rows) == len(want)


def test_scores_of_all_pairs_are_counted_in_their_tasks(spark, sf, monkeypatch):
    from graphrecon.catalog import tables as T

    want = sorted(tuple(r) for r in T.vector_pairs(spark, sf).groupBy("label", "prob").count().collect())
    monkeypatch.setattr(T, "similarity_blocks", lambda *_: pytest.fail("pairs leave the tasks one by one"))
    assert sorted(tuple(r) for r in T.vector_scores(spark, sf).collect()) == want


def test_enumeration_by_blocks(spark, ids):
    names = [f"x{i}" for i in range(23)]
    for self_pairs, want in ((False, 253), (True, 276)):
        got = P.enumerate_pairs(ids(names), self_pairs, block_rows=5).collect()
        assert len(got) == len({tuple(r) for r in got}) == want
        assert all(r["u"] <= r["v"] for r in got)


def test_shard_merge(spark):
    def shards(*rows):
        return spark.createDataFrame(list(rows), "pair_index long, pred int")

    good = shards((0, 1), (2, 0), (4, 1), (1, 0), (3, 1))
    got = [r["pred"] for r in P.merge_shards(good, 5).orderBy("pair_index").collect()]
    assert got == [1, 0, 0, 1, 1]
    for bad in (shards((0, 1), (2, 1)), shards((0, 1), (0, 1), (1, 1), (2, 1)), shards((0, 1), (1, 1), (2, 1), (7, 1))):
        with pytest.raises(ValueError):
            P.merge_shards(bad, 3)
