"""Undirected graphs as two tables: ``nodes(id)`` and ``edges(u, v)`` with ``u <= v``, unique.

Functions take ``groups`` columns (say a sample number) to work on many graphs in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrecon.functions.keys import canonical
from graphrecon.operators.prefix import global_index
from graphrecon.session import materialize, materialize_by, task_slots


def edges_from_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected, duplicate-free edges; a pair of equal ids becomes a loop."""
    return canonical(pairs.select(a, b), a, b).distinct()


def reconstruct(predictions: DataFrame, a: str = "a", b: str = "b", pred: str = "pred") -> DataFrame:
    """Edges of the graph predicted by the pairs with a positive decision."""
    return edges_from_pairs(predictions.filter(F.col(pred) > 0), a, b)


def endpoints(edges: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return edges.select(*groups, F.explode(F.array("u", "v")).alias("id")).distinct()


def degrees(
    edges: DataFrame, nodes: DataFrame | None = None, groups: Sequence[str] = ()
) -> DataFrame:
    """Degree per node, a loop counting twice; nodes without edges get 0 when given."""
    keys = [*groups, "id"]
    counted = (
        edges.select(*groups, F.explode(F.array("u", "v")).alias("id"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("degree"))
    )
    if nodes is None:
        return counted
    return (
        nodes.select(*keys)
        .join(counted, keys, "left")
        .select(*keys, F.coalesce("degree", F.lit(0)).alias("degree"))
    )


def density(node_count: Column, edge_count: Column) -> Column:
    """2m / (n (n - 1)), loops included in m; 0 without edges or with fewer than two nodes."""
    n, m = node_count.cast("double"), edge_count.cast("double")
    return F.when((n < 2) | (m == 0), 0.0).otherwise(2.0 * m / F.greatest(n * (n - 1.0), F.lit(1.0)))


def graph_size(nodes: DataFrame, edges: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Node count, edge count and density, one row per graph."""
    tall = nodes.select(*groups, F.lit(1).alias("n"), F.lit(0).alias("m")).unionByName(
        edges.select(*groups, F.lit(0).alias("n"), F.lit(1).alias("m"))
    )
    counts = tall.groupBy(*groups).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("edges"),
    )
    return counts.withColumn("density", density(F.col("nodes"), F.col("edges")))


def add_missing_nodes(
    pred_nodes: DataFrame, true_nodes: DataFrame, policy: str = "reference"
) -> DataFrame:
    """Nodes of the prediction, completed by those of the truth.

    ``reference`` completes only when the truth has strictly more nodes; ``union`` always.
    The two counts are compared inside the plan.
    """
    pred, true = pred_nodes.select("id"), true_nodes.select("id")
    if policy == "union":
        return pred.unionByName(true).distinct()
    if policy != "reference":
        raise ValueError("policy must be reference or union")
    tall = pred.select("id", F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(
        true.select("id", F.lit(0).alias("p"), F.lit(1).alias("t"))
    )
    marks = tall.groupBy("id").agg(F.max("p").alias("p"), F.max("t").alias("t"))
    complete = marks.agg((F.sum("t") > F.sum("p")).alias("complete")).scalar()
    return marks.filter((F.col("p") == 1) | complete).select("id")


def keep_available(nodes: DataFrame, edges: DataFrame, available: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph restricted to the available ids."""
    ids = available.select("id").distinct()
    kept_nodes = nodes.join(ids, "id", "left_semi")
    return kept_nodes, edges_inside(edges, ids)


def edges_inside(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids`` (unique)."""
    kept = edges.join(ids.select(F.col("id").alias("u")), "u", "left_semi").join(
        ids.select(F.col("id").alias("v")), "v", "left_semi"
    )
    return kept.select(*edges.columns)


def induced_edges(
    samples: DataFrame,
    edges: DataFrame,
    keys: Sequence[str] = ("node_size", "sample_id"),
    extra: Sequence[str] = (),
) -> DataFrame:
    """Edges inside each node sample, for all samples at once.

    Edges that touch no sampled node at either end go first, which keeps the join on one end
    small even when a node with very many edges is sampled.
    """
    keys = list(keys)
    members = samples.select(*keys, "id").distinct()
    near = edges_inside(edges.select("u", "v", *extra), members.select("id").distinct())
    low = members.withColumnRenamed("id", "u")
    high = members.withColumnRenamed("id", "v")
    inside = near.join(low, "u").join(high, [*keys, "v"])
    return inside.select(*keys, *extra, "u", "v")


def supervision_graph(pairs: DataFrame, split_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes of the split, and its positive pairs as edges (nodes without edges stay)."""
    ids = split_nodes.select("id").distinct()
    positive = pairs.filter(F.col("label") > 0).select("a", "b")
    return ids, edges_inside(edges_from_pairs(positive), ids)


def explicit_negatives(pairs: DataFrame, split_nodes: DataFrame) -> DataFrame:
    """Unique pairs of the split labelled 0 or below."""
    ids = split_nodes.select("id").distinct()
    return edges_inside(edges_from_pairs(pairs.filter(F.col("label") <= 0)), ids)


def partners(edges: DataFrame) -> DataFrame:
    """Each node beside each of its partners: two rows per pair, one for a pair with itself."""
    return edges.select(
        F.explode(
            F.array(
                F.struct(F.col("u").alias("id"), F.col("v").alias("partner")),
                F.struct(F.col("v").alias("id"), F.col("u").alias("partner")),
            )
        ).alias("e")
    ).select("e.*").distinct()


def split_positive_rate(
    positives: Column, negatives: Column, ratio: int
) -> Column:
    """Share of positives when at most ``ratio`` negatives go with each; NULL if not applicable."""
    used = F.least(negatives, positives * ratio)
    usable = (positives > 0) & F.lit(ratio > 0) & (negatives > 0) & (used > 0)
    return F.when(usable, positives / (positives + used).cast("double"))


def prior_logit(probability: Column, epsilon: float = 1e-8) -> Column:
    kept = F.least(F.greatest(probability, F.lit(epsilon)), F.lit(1.0 - epsilon))
    return F.log(kept / (1.0 - kept))


#: Edges of a colour triple, on average; a task holds a triple's ends as numbers.
TRIPLE_EDGES = 400_000


def _corners(u: np.ndarray, v: np.ndarray, code: np.ndarray, wanted: int) -> np.ndarray:
    """Triangles per node of a graph of numbered nodes without loops and repeats, those of which the corners' codes add up to ``wanted``."""
    n = len(code)
    degree = np.bincount(u, minlength=n) + np.bincount(v, minlength=n)
    turned = (degree[u] > degree[v]) | ((degree[u] == degree[v]) & (u > v))
    # Edges point to the end of more edges, so out-lists are short; two edges out of a node are closed by a third or not.
    known = np.sort(np.where(turned, v, u) * n + np.where(turned, u, v))
    low, high = (known // n).astype(np.int32), (known % n).astype(np.int32)
    later = np.searchsorted(low, low, "right") - np.arange(len(low)) - 1
    total, step, counts = np.cumsum(later), 1 << 20, np.zeros(n, np.int64)
    cuts = np.searchsorted(total, np.arange(step, (int(total[-1]) if len(total) else 0) + step, step), "right")
    for a, b in zip(np.append(0, cuts[:-1]), cuts):
        some = np.arange(a, b)
        one = np.repeat(some, later[some])
        two = np.arange(len(one)) - np.repeat(np.cumsum(later[some]) - later[some] - some - 1, later[some])
        mine = np.flatnonzero(code[low[one]] + code[high[one]] + code[high[two]] == wanted)
        one, x, y = one[mine], high[one[mine]].astype(np.int64), high[two[mine]].astype(np.int64)
        after = (degree[x] > degree[y]) | ((degree[x] == degree[y]) & (x > y))
        want = np.where(after, y, x) * n + np.where(after, x, y)
        hit = known[np.minimum(np.searchsorted(known, want), len(known) - 1)] == want
        counts += np.bincount(np.concatenate([low[one[hit]], x[hit], y[hit]]), minlength=n)
    return counts


def _numbered(edges: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Ends as 64-bit numbers (``u, v``), and the ids behind the numbers (``id, number``).

    Numbers are hashes; the few seeds in a lifetime under which two ids of the table clash are passed over.
    """
    ids = materialize(endpoints(edges))
    seed = 0
    while True:
        number = lambda c: F.xxhash64(F.lit(seed), F.col(c))
        named = ids.select("id", number("id").alias("number"))
        if named.groupBy("number").count().where("count > 1").isEmpty():
            return edges.select(*groups, number("u").alias("u"), number("v").alias("v")), named
        seed += 1


def colour_triples(edges: DataFrame, colours: int, groups: Sequence[str] = ()) -> DataFrame:
    """Edges between numbers, beside the triples of colours that a triangle of theirs can have: ``groups, triple, u, v``.

    A number's colour is its remainder. A triangle lies in the triple of its corners' colours alone, and an
    edge is copied once for each colour of the third corner.
    """
    cu, cv = (F.pmod(c, F.lit(colours)).cast("int") for c in ("u", "v"))
    rows = edges.select(*groups, "u", "v", cu.alias("cu"), cv.alias("cv"))
    rows = rows.withColumn("cw", F.explode(F.sequence(F.lit(0), F.lit(colours - 1))))
    least, most = F.least("cu", "cv", "cw"), F.greatest("cu", "cv", "cw")
    middle = F.col("cu") + F.col("cv") + F.col("cw") - least - most
    return rows.select(*groups, ((least * colours + middle) * colours + most).alias("triple"), "u", "v")


def triangle_corners(edges: DataFrame, groups: Sequence[str] = (), colours: int | None = None) -> DataFrame:
    """Triangles per node (nodes of none are absent).

    A single graph goes by ordered neighbours, see ``_ordered_triangles``. With ``groups`` (many small graphs in one
    table) a graph is one task's, and with ``colours`` each triple of colours is.
    """
    return _triangles(_simple(edges, groups), groups, colours)


def _triangles(simple: DataFrame, groups: Sequence[str], colours: int | None = None) -> DataFrame:
    if not groups and colours is None:
        return _ordered_triangles(simple)
    numbered, named = _numbered(simple, groups)
    totals = _colour_totals(numbered, groups, colours or 1)
    return totals.join(named, "number").select(*groups, "id", "triangles")


#: Later neighbours of a node up to which it sends them on; a shuffled edge brings half as many at most.
MOST_LATER = 64


def _ordered_triangles(simple: DataFrame, most_later: int = MOST_LATER) -> DataFrame:
    """Triangles per node of one graph: nodes stand in order of their degree, and edges point to the later end.

    The first node of a triangle tells the second one which nodes are still to come, and that one knows which of them it
    has: as much is moved as there are edges times later neighbours, few in any graph without a large dense part. What
    lies from the first node with more than ``most_later`` of them on (all its triangles' corners do) goes by colours.
    """
    placed = global_index(degrees(simple), ["degree", "id"], "number").select("id", "number")
    named = materialize(placed)
    u = named.select(F.col("id").alias("u"), F.col("number").alias("nu"))
    v = named.select(F.col("id").alias("v"), F.col("number").alias("nv"))
    turned = simple.join(u, "u").join(v, "v").select(F.least("nu", "nv").alias("low"), F.greatest("nu", "nv").alias("high"))
    later = turned.groupBy("low").agg(F.array_sort(F.collect_set("high")).alias("later"))
    later = materialize_by(later, "low")
    dense = later.filter(F.size("later") > most_later).agg(F.min("low")).first()[0]

    first = later if dense is None else later.filter(F.col("low") < dense)
    rests = first.filter(F.size("later") > 1).select(F.col("low").alias("first"), "later", F.posexplode("later").alias("at", "low"))
    rests = rests.filter(F.col("at") + 1 < F.size("later")).select(
        "first", "low", F.slice("later", F.col("at") + 2, F.size("later")).alias("rest")
    )
    # lists of any length are met in pieces, so that no row is long
    starts = F.explode(F.sequence(F.lit(1), F.size("later"), F.lit(most_later))).alias("start")
    pieces = later.select("low", "later", starts).select("low", F.slice("later", F.col("start"), most_later).alias("later"))
    closed = rests.join(pieces, "low").select("first", "low", F.array_intersect("rest", "later").alias("third"))
    closed = closed.filter(F.size("third") > 0)
    size = F.size("third").cast("long")
    ends = F.array(F.struct(F.col("first").alias("number"), size.alias("n")), F.struct(F.col("low").alias("number"), size.alias("n")))
    thirds = F.transform("third", lambda w: F.struct(w.alias("number"), F.lit(1).cast("long").alias("n")))
    shares = closed.select(F.explode(F.concat(ends, thirds)).alias("e")).select("e.*")
    totals = shares.groupBy("number").agg(F.sum("n").alias("triangles"))
    if dense is not None:
        core = later.filter(F.col("low") >= dense).select(F.col("low").alias("u"), F.explode("later").alias("v"))
        core = materialize(core)
        # 6 / p^2 of all edges meet in a triple of p colours.
        colours = max(1, math.ceil(math.sqrt(6 * core.count() / TRIPLE_EDGES)))
        totals = totals.unionByName(_colour_totals(core, (), colours))
        totals = totals.groupBy("number").agg(F.sum("triangles").alias("triangles"))
    return totals.join(named, "number").select("id", "triangles")


def _colour_totals(numbered: DataFrame, groups: Sequence[str], colours: int) -> DataFrame:
    """Triangles per number (``groups, number, triangles``), by colour partitioning.

    Each triple of colours is one task's graph; the shuffle moves each edge once per colour, whatever the degrees are.
    """
    groups = list(groups)
    dealt = colour_triples(numbered, colours, groups)
    fields = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    schema = ", ".join([*[f"{g} {fields[g]}" for g in groups], "number long, n long"])

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        ends = np.concatenate([rows["u"].to_numpy(), rows["v"].to_numpy()])
        numbers, codes = np.unique(ends, return_inverse=True)
        u, v = codes[: rows.num_rows], codes[rows.num_rows :]
        pairs = np.unique(np.minimum(u, v) * len(numbers) + np.maximum(u, v))
        # The triple's colours as digits: a triangle is its own if its corners have each as often as the triple.
        triple, colour = key[-1].as_py(), numbers % colours
        three = (triple // colours**2, triple // colours % colours, triple % colours)
        code = np.select([colour == c for c in three], [1, 4, 16])
        wanted = sum((1, 4, 16)[three.index(c)] for c in three)
        counts = _corners(pairs // len(numbers), pairs % len(numbers), code, wanted)
        hit = np.flatnonzero(counts)
        same = [pa.array([k.as_py()] * len(hit), rows.schema.field(g).type) for k, g in zip(key, groups)]
        return pa.Table.from_arrays([*same, pa.array(numbers[hit]), pa.array(counts[hit])], names=[*groups, "number", "n"])

    # a fixed width: the work of a triple is more than its rows, so small ones must not be put together
    spread = dealt.repartition(task_slots(numbered.sparkSession), *groups, "triple")
    shares = spread.groupBy(*groups, "triple").applyInArrow(count, schema)
    return shares.groupBy(*groups, "number").agg(F.sum("n").alias("triangles"))


def _simple(edges: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Edges without loops, written once for the passes to come."""
    return materialize(edges.select(*groups, "u", "v").filter(F.col("u") != F.col("v")))


def local_clustering(
    nodes: DataFrame, edges: DataFrame, groups: Sequence[str] = ()
) -> DataFrame:
    """Per node: degree without loops, triangles, and the local clustering coefficient."""
    keys = [*groups, "id"]
    simple = _simple(edges, groups)
    degree = degrees(simple, nodes, groups)
    t, d = F.coalesce(F.col("triangles"), F.lit(0)), F.col("degree")
    return degree.join(_triangles(simple, groups), keys, "left").select(
        *keys,
        "degree",
        t.alias("triangles"),
        F.when(d < 2, 0.0)
        .otherwise(2.0 * t / F.greatest(d * (d - 1), F.lit(1)))
        .alias("clustering"),
    )
