"""N-gram Jaccard join with count-vector R-trees, and the groups of near duplicates that it links.

A text's set is its distinct shingles, hashed to 64 bits. Texts of one set are one node, so exact
copies never meet each other. Two sets of similarity ``t`` share one of their ``n - ceil(t n) + 1`` smallest
hashes each; the nodes that have one such hash are a block, and every link lies inside some block. Inside
a block, shingles are hashed to groups, and a node is the point of its groups' counts: the sum of the smaller
counts bounds two nodes' overlap from above, and the sum of the smaller of two boxes' upper corners bounds
that of all their nodes. Points that pass are verified on the whole sets.

A group of copies is never turned into all its pairs. First each node of a block is compared with the
block's least node only. Then nodes that came near others meet the others of three of their blocks, the largest and two drawn ones, and every group gives the
links of a spanning forest. Blocks whose nodes hang together then are done. What is left, pairs of nodes not yet connected in any block of three nodes or more, goes through the R-trees of the blocks. Blocks
beyond ``TILE`` nodes are dealt out in tiles, without leaving out a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphrecon.session import drop_shuffles, materialize

SIZE, SIMILARITY = 5, (80, 100)  # words of a shingle; least similarity as a fraction
TILE = 4096
#: Members of all sets in a tile, at most, unless a tile is one node.
TILE_MEMBERS = 1 << 21
#: Blocks up to here are turned into the few pairs they have; larger ones get R-trees.
FEW = 16
DRAWN = 2
#: Edges of a part of the components' edge table, at least.
PART_EDGES = 100_000
LEAF = 32
#: Bits of the filter that keeps unconcerned rows out of a shuffle: a megabyte at most.
FILTER_BITS = 1 << 23

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Distinct shingles of a text, hashed, in ascending order."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    values = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    count = len(words) - size + 1
    total = np.zeros(count, np.uint64)
    for j in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + values[j : j + count]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(29)
    return np.unique(total)


def point(found: np.ndarray) -> bytes:
    """Counts of the groups: a power of two of them, four to eight hashes in each on average."""
    groups = 1 << max(4, math.ceil(math.log2(max(1, len(found)) / 8))) if len(found) else 16
    counts = np.bincount((found & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype("<u1" if counts.max(initial=0) < 256 else "<u4").tobytes()


def _counts(data: bytes, n: int) -> np.ndarray:
    groups = 1 << max(4, math.ceil(math.log2(max(1, n) / 8)))
    return np.frombuffer(data, "<u1" if len(data) == groups else "<u4").astype(np.uint32)


def _folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Counts for fewer groups, a power of two of them."""
    return points.reshape(len(points), -1, groups).sum(axis=1, dtype=np.uint32)


def least_overlap(total, similarity=SIMILARITY):
    """The overlap that two sets of ``total`` members together need at least (not rounded up)."""
    return total * similarity[0] / (similarity[0] + similarity[1])


def bound_ok(a: bytes, b: bytes, n: int, m: int, similarity=SIMILARITY) -> bool:
    x, y = _counts(a, n), _counts(b, m)
    groups = min(len(x), len(y))
    x, y = _folded(x[None], groups)[0], _folded(y[None], groups)[0]
    return int(np.minimum(x, y).sum()) >= least_overlap(n + m, similarity) - 1e-9


class RTree:
    """Packed R-tree over count points of one number of groups, sizes along."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # Packed by size, then, inside slabs of some leaves, by the counts that vary most.
        order = np.argsort(sizes, kind="stable")
        if len(order) > LEAF:
            widest = np.argsort(points.var(axis=0))[::-1][:2]
            slab = LEAF * max(1, math.isqrt(len(order) // LEAF))
            order = np.concatenate(
                [s[np.lexsort([points[s, w] for w in widest])] for s in (order[i : i + slab] for i in range(0, len(order), slab))]
            )
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels = []  # from leaves up: upper corners, least and largest size, first and last child
        top, low, high = self.points, self.sizes, self.sizes
        while len(top) > 1 or not self.levels:
            cuts = np.arange(0, len(top), LEAF)
            ends = np.append(cuts[1:], len(top))
            top, low, high = (np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts))
            self.levels.append((top, low, high, cuts, ends))

    def pairs(self, other: RTree, similarity=SIMILARITY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of own and other points that may link, each at least once; both trees may be the same."""
        least, most = similarity
        stack = [(len(self.levels) - 1, 0, len(other.levels) - 1, 0)]
        while stack:
            la, a, lb, b = stack.pop()
            corner, low, high, cuts, ends = self.levels[la]
            corner2, low2, high2, cuts2, ends2 = other.levels[lb]
            if self is other and la == lb and b < a:
                continue
            if least * low2[b] > most * high[a] or least * low[a] > most * high2[b]:
                continue
            if np.minimum(corner[a], corner2[b]).sum() < least_overlap(int(low[a]) + int(low2[b]), similarity) - 1e-9:
                continue
            if la == 0 and lb == 0:
                x, y = slice(cuts[a], ends[a]), slice(cuts2[b], ends2[b])
                bound = np.minimum(self.points[x, None, :], other.points[None, y, :]).sum(axis=2)
                need = least_overlap(self.sizes[x, None].astype(np.int64) + other.sizes[None, y], similarity)
                i, j = np.nonzero(bound >= need - 1e-9)
                if len(i):
                    yield self.order[x][i], other.order[y][j]
            elif la >= lb:
                stack += [(la - 1, c, lb, b) for c in range(cuts[a], ends[a])] if la else []
            else:
                stack += [(la, a, lb - 1, c) for c in range(cuts2[b], ends2[b])]


def block_pairs(
    nodes: np.ndarray,
    parts: np.ndarray,
    tiles: np.ndarray,
    wanted: tuple[int, int],
    sizes: np.ndarray,
    data: list[bytes],
    homes: list[list[int] | None],
    before: list[list[int]],
) -> set[tuple[int, int]]:
    """Pairs of a block's tile that may link: of different parts, from the two wanted tiles.

    Pairs of one home have been verified there, and are left out. A pair that shares a prefix ``before`` the block's
    is left to the first block that it shares, so that it is looked at once.
    """
    lists = [frozenset(b) for b in before]
    width = max([1, *(len(h) for h in homes if h)])
    home = np.array([[*(h or ()), *[-1] * (width - len(h or ()))] for h in homes], np.int64).reshape(len(nodes), width)
    counts = [_counts(d, int(n)) for d, n in zip(data, sizes)]
    level = np.array([len(c) for c in counts])
    found: set[tuple[int, int]] = set()
    # Sizes within the similarity differ by less than a factor of two, so by one level at most
    # where a level doubles; any lower bound on similarity is covered by going through all levels.
    trees: dict[tuple[int, int], tuple[np.ndarray, RTree]] = {}

    def tree(at_level: int, groups: int):
        if (at_level, groups) not in trees:
            rows = np.flatnonzero(level == at_level)
            points = _folded(np.stack([counts[i] for i in rows]), groups)
            trees[at_level, groups] = rows, RTree(points, sizes[rows])
        return trees[at_level, groups]

    levels = sorted(set(level.tolist()))
    for at, small in enumerate(levels):
        for large in levels[at:]:
            rows, left = tree(small, small)
            rows2, right = tree(large, small)
            for i, j in left.pairs(right):
                a, b = rows[i], rows2[j]
                keep = (nodes[a] != nodes[b]) & (parts[a] != parts[b])
                pair = np.sort(np.stack([tiles[a], tiles[b]]), axis=0)
                keep &= (pair[0] == wanted[0]) & (pair[1] == wanted[1])
                a, b = a[keep], b[keep]
                same = (home[a][:, :, None] == home[b][:, None, :]) & (home[a] != -1)[:, :, None]
                met = same.any(axis=(1, 2))
                for i, j in zip(a[~met].tolist(), b[~met].tolist()):
                    if lists[i].isdisjoint(lists[j]):
                        x, y = int(nodes[i]), int(nodes[j])
                        found.add((min(x, y), max(x, y)))
    return found


def forest_links(
    nodes: list[int], parts: list[int], sizes: list[int], data: list[bytes], members: list[bytes], similarity=SIMILARITY
) -> list[tuple[int, int]]:
    """Links that connect the group's nodes as far as all its links do, beyond what ``parts`` connect already."""
    least, most = similarity
    size = np.array(sizes, np.int64)
    counts = [_counts(d, n) for d, n in zip(data, sizes)]
    level = np.array([len(c) for c in counts])
    folded = {
        g: _folded_ragged(counts, level, g) for g in sorted(set(level.tolist()))
    }
    _, label = np.unique(np.array(parts), return_inverse=True)
    sets = [np.frombuffer(m, np.uint64) for m in members]
    found = []
    for i in range(len(nodes)):
        fits = (label != label[i]) & (size * least <= size[i] * most) & (size[i] * least <= size * most)
        near = []
        for g, (rows, points) in folded.items():
            # Nodes of this level meet node i at the coarser of both levels.
            at = min(g, level[i])
            some = rows[fits[rows] & (level[rows] == g)]
            if len(some):
                held, matrix = folded[at]
                mine = matrix[np.searchsorted(held, i)]
                bound = np.minimum(matrix[np.searchsorted(held, some)], mine).sum(axis=1, dtype=np.int64)
                near.append(some[bound >= least_overlap(size[some] + size[i], similarity) - 1e-9])
        near = np.concatenate(near) if near else np.zeros(0, np.int64)
        for part in np.unique(label[near]):
            own = near[label[near] == part]
            together = np.concatenate([sets[j] for j in own])
            place = np.minimum(np.searchsorted(sets[i], together), size[i] - 1)
            starts = np.concatenate([[0], np.cumsum(size[own])[:-1]])
            both = np.add.reduceat((sets[i][place] == together).astype(np.int64), starts)
            linked = own[most * both >= least * (size[own] + size[i] - both)]
            if len(linked):
                found.append((nodes[i], nodes[linked[0]]))
                label[label == part] = label[i]
    return found


def _folded_ragged(counts: list[np.ndarray], level: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of this level and above, and their counts for so many groups."""
    rows = np.flatnonzero(level >= groups)
    return rows, np.stack([_folded(counts[i][None], groups)[0] for i in rows])


def _row_hash(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def set_features(docs: DataFrame, key: str, text: str, size: int = SIZE, similarity=SIMILARITY) -> DataFrame:
    """For each document its ``row`` hash, ``key``, ``node`` (hash of its set, null if empty), ``n``, ``point``
    and ``prefix`` (the hashes that a linked set has one of)."""
    least, most = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            node, count, points, prefix = [], [], [], []
            for at in range(0, batch.num_rows, 500):
                for x in batch.column(2).slice(at, 500).to_pylist():
                    found = shingles(x, size)
                    n = len(found)
                    count.append(n)
                    node.append(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64) if n else None)
                    points.append(point(found) if n else None)
                    prefix.append(found[: n - -(-least * n // most) + 1].view(np.int64) if n else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(node, pa.int64()),
                    pa.array(count, pa.int64()),
                    pa.array(points, pa.binary()),
                    pa.array(prefix, pa.list_(pa.int64())),
                ],
                ["row", "key", "node", "n", "point", "prefix"],
            )

    rows = docs.select(_row_hash(key, text).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, key {kind}, node long, n long, point binary, prefix array<long>")


def _bit_filter(rows: DataFrame, column: str) -> DataFrame:
    """A fixed-size bit filter of a column of hashes: rows of ``word`` and ``bits``; small enough to broadcast."""
    slot = F.pmod(F.col(column), F.lit(FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))")
    return rows.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _may_hold(rows: DataFrame, bits: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``__maybe``: false only for values that the filter wasn't made of."""
    slot = F.pmod(F.col(column), F.lit(FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))")
    made = bits.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
    held = rows.withColumn("__word", F.shiftright(slot, 6)).join(F.broadcast(made), "__word", "left")
    return held.withColumn("__maybe", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__word", "__bits")


def _sets_of(docs: DataFrame, nodes: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``node`` and ``members`` (all its hashes) for rows of ``node`` and ``row``, from the whole texts.

    Only texts that the bit filter lets through are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            node, members = [], []
            for want, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = shingles(x, size).tobytes()
                if np.uint64(xxhash.xxh3_64_intdigest(found)).astype(np.int64) == want:
                    node.append(want)
                    members.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(members, pa.binary())], ["node", "members"])

    texts = _may_hold(docs.select(_row_hash(key, text).alias("row"), F.col(text).alias("text")), _bit_filter(nodes, "row"), "row")
    wanted = texts.where("__maybe").select("row", "text").join(nodes, "row").select("node", "text")
    sets = wanted.mapInArrow(run, "node long, members binary")
    return sets.groupBy("node").agg(F.first("members").alias("members"))  # repeated rows give one set


def _verified(pairs: DataFrame, sets: DataFrame, similarity=SIMILARITY) -> DataFrame:
    """The links among ``pairs`` of ``a`` and ``b``, by the whole sets."""
    least, most = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for i, j, x, y in zip(*[c.to_pylist() for c in batch.columns]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if most * both >= least * (len(x) + len(y) - both):
                    a.append(i)
                    b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    first = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _bounded(pairs: DataFrame, points: DataFrame, similarity=SIMILARITY) -> DataFrame:
    """Pairs whose sizes and count points allow a link."""
    least, most = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bound_ok(x, y, n, m, similarity) for n, m, x, y in zip(*[c.to_pylist() for c in batch.columns[2:]])]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = points.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("point").alias("x"))
    second = points.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("point").alias("y"))
    sized = pairs.join(first, "a").join(second, "b").where((F.col("na") * least <= F.col("nb") * most) & (F.col("nb") * least <= F.col("na") * most))
    return sized.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``part``, the least node connected with it, for all ends of ``links`` of ``a`` and ``b``.

    Large-star and small-star steps in turn, each written, until nothing moves: some log of the longest chain.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        # Same edges, same counts and sums of hashes.
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40)), F.sum(F.xxhash64("v", "u") % (1 << 40))).first()
        if state == seen:
            break
        seen = state
        # A shuffle writes a file for each part that it reads: few edges, few parts.
        edges = edges.coalesce(1 + state[0] // PART_EDGES)
        drop_shuffles(edges.sparkSession)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialize(hung.union(low.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("part")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("part")).distinct()
    )


def _labelled(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of blocks that still hold nodes of different parts, with these."""
    rows = shared.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    mixed = rows.groupBy("prefix").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    return rows.join(mixed.where("low < high"), "prefix")


def _by_group(rows: DataFrame, keys: int, links_of) -> DataFrame:
    """``a`` and ``b`` that ``links_of`` gives for each group of rows that agree in the first ``keys`` columns.

    Rows are sorted by group inside their partitions and taken group by group, so that small groups cost little.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting = None, [[] for _ in names[keys:]]

        def close() -> Iterator[pa.RecordBatch]:
            found = links_of(block, *waiting) if waiting[0][1:] else ()
            for column in waiting:
                column.clear()
            ends = [pa.array([x[e] for x in found], pa.int64()) for e in (0, 1)]
            yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                columns = [c.slice(at, 2000).to_pylist() for c in batch.columns]
                for name, row in zip(zip(*columns[:keys]), zip(*columns[keys:])):
                    if name != block:
                        yield from close()
                        block = name
                    for column, value in zip(waiting, row):
                        column.append(value)
        yield from close()

    dealt = rows.repartition(*names[:keys]).sortWithinPartitions(*names[:keys])
    return dealt.mapInArrow(run, "a long, b long")


def _tiles(size: Column, total: Column) -> Column:
    return F.ceil(F.greatest(size / TILE, total / TILE_MEMBERS)).cast("int")


def _few_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of different parts in small blocks, that their sizes allow."""
    least, most = SIMILARITY
    first = rows.select("prefix", F.col("node").alias("a"), F.col("part").alias("pa"), F.col("n").alias("na"))
    second = rows.select("prefix", F.col("node").alias("b"), F.col("part").alias("pb"), F.col("n").alias("nb"))
    sized = (F.col("na") * least <= F.col("nb") * most) & (F.col("nb") * least <= F.col("na") * most)
    met = first.join(second, "prefix").where(F.col("a") < F.col("b")).where(F.col("pa") != F.col("pb")).where(sized)
    return met.select("a", "b").distinct()


def _tile_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of different parts that the R-trees of their blocks can't rule out, each in one block and tile."""
    mine = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    dealt = (
        rows.withColumn("tiles", _tiles(F.col("size"), F.col("total")))
        .withColumn("tile", mine)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("i", F.least("tile", "with"))
        .withColumn("j", F.greatest("tile", "with"))
        .select("prefix", "i", "j", "tile", "node", "part", "n", "point", "homes", F.filter("prefixes", lambda x: x < F.col("prefix")).alias("before"))
    )

    def pairs(block, tile, node, part, n, data, homes, before):
        found = block_pairs(
            np.array(node), np.array(part), np.array(tile), block[1:], np.array(n, np.int64), data, homes, before
        )
        return sorted(found)

    return _by_group(dealt, 3, pairs)


def _homes(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """Groups of each node with a set, the tiles of its largest block and of drawn ones: ``prefix``, ``tile``, ``node``, ``n``."""
    rows = shared.join(sets.select("node"), "node", "left_semi")
    sizes = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).where("size > 1")
    rows = rows.join(sizes, "prefix")
    drawn = [F.max(F.struct(F.xxhash64("prefix", F.lit(t)), "prefix", "n", "size", "total")) for t in range(1, DRAWN + 1)]
    largest = F.max(F.struct(F.col("size").alias("order"), "prefix", "n", "size", "total"))
    homes = rows.groupBy("node").agg(F.array_distinct(F.array(*[_home(h) for h in (largest, *drawn)])).alias("homes"))
    tiles = _tiles(F.col("size"), F.col("total"))
    return homes.select("node", F.inline("homes")).select(
        "prefix", F.pmod(F.xxhash64("node"), tiles).alias("tile"), "node", "n"
    )


def _forests(homes: DataFrame, sets: DataFrame, points: DataFrame, labels: DataFrame) -> DataFrame:
    """Spanning links of the nodes of each home."""
    known = labels.join(sets, "node").join(points.select("node", "point"), "node")
    full = homes.join(known, "node").select("prefix", "tile", "node", "part", "n", "point", "members")
    return _by_group(full, 2, lambda _, *columns: forest_links(*columns))


def _home(best: Column) -> Column:
    return F.struct(*[best.getField(f).alias(f) for f in ("prefix", "n", "size", "total")])


def linked_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``row`` (hash of key and text), ``key``, ``n``, ``node`` and ``part`` of each document.

    ``part`` names the documents connected by links; null for those without words or text, which are linked
    with nothing. Repeated rows and equal texts are one node. An empty table gives an empty result; other columns
    aren't read. 64-bit hashes stand for shingles and sets.
    """
    features = materialize(set_features(docs, key, text, size))
    # A row for each node; copies are merged inside tasks, before the shuffle.
    nodes = features.where("node is not null").groupBy("node").agg(
        F.first("n").alias("n"), F.first("point").alias("point"), F.min("row").alias("row"), F.first("prefix").alias("prefix")
    )
    rows = nodes.select("node", "n", F.explode("prefix").alias("prefix"))
    drawn = F.min_by("node", F.xxhash64("node", "prefix"))
    blocks = (
        rows.groupBy("prefix")
        .agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.count(F.lit(1)).alias("size"), drawn.alias("drawn"))
        .where("lead < last")
        .select("prefix", "lead", F.when(F.col("size") > FEW, F.col("drawn")).alias("drawn"))
    )
    shared = materialize(rows.join(blocks, "prefix"))
    drop_shuffles(docs.sparkSession)
    named = shared.select("node").distinct()
    points = materialize(nodes.drop("prefix").join(named, "node", "left_semi"))
    drop_shuffles(docs.sparkSession)

    def sets_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        return materialize(_sets_of(docs, points.join(ends, "node", "left_semi").select("node", "row"), key, text, size))

    stars = shared.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    near = materialize(_bounded(stars, points))
    # In larger blocks nodes may be far from the least node and near to others: a drawn one each shows it.
    others = shared.where("node <> drawn").select(F.least("drawn", "node").alias("a"), F.greatest("drawn", "node").alias("b"))
    drop_shuffles(docs.sparkSession)
    sets = sets_of(near.union(_bounded(others.distinct(), points)))
    links = materialize(_verified(near, sets))
    shared = shared.drop("lead", "drawn")
    # Labels that spare the groups links between nodes of one lead.
    leads = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("part"))
    labels = sets.select("node").join(leads, "node", "left").select("node", F.coalesce("part", "node").alias("part"))
    homes = materialize(_homes(shared, sets))
    drop_shuffles(docs.sparkSession)
    links = materialize(links.union(_forests(homes, sets, points, labels)))
    parts = materialize(components(links))
    # In blocks of two, the one pair has been seen.
    left = materialize(_labelled(shared, parts).where("size > 2"))
    few = _few_pairs(left.where(F.col("size") <= FEW).select("prefix", "node", "part", "n"))
    # Nodes of one home are through with each other.
    met = homes.groupBy("node").agg(F.collect_set(F.xxhash64("prefix", "tile")).alias("homes"))
    many = left.where(F.col("size") > FEW).join(points.select("node", "point"), "node").join(met, "node", "left")
    # The blocks of each node, as far as trees see them: a pair is left to the first one it shares.
    many = many.withColumn("prefixes", F.collect_list("prefix").over(Window.partitionBy("node")))
    drop_shuffles(docs.sparkSession)
    more = materialize(_bounded(few, points).union(_tile_pairs(many)).distinct())
    drop_shuffles(docs.sparkSession)
    found = materialize(_verified(more, sets_of(more)))
    if not found.isEmpty():
        parts = materialize(components(links.union(found)))
    return (
        features.select("row", "key", "n", "node")
        .join(parts, "node", "left")
        .select("row", "key", "n", "node", F.coalesce("part", "node").alias("part"))
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id``, the least key reachable by links, for each document.

    A document without words is a component of its own. Null keys count only where a component has no other.
    """
    groups = materialize(linked_groups(docs, key, text, size))
    least = groups.where("part is not null").groupBy("part").agg(F.min("key").alias("least"))
    return groups.join(least, "part", "left").select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("part").isNull(), F.col("key")).otherwise(F.col("least")).alias("component_id"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that of the least key (null last).

    Documents without words all stay. Of rows that are repeated as they are, one stays. Only rows that the
    bit filter can't clear are shuffled with their texts.
    """
    groups = materialize(linked_groups(docs, key, text, size).where("part is not null").select("row", "key", "part"))
    rank = F.struct(F.col("key").isNull().alias("absent"), F.col("key").alias("key"), F.col("row").alias("row"))
    first = groups.groupBy("part").agg(F.min(rank).alias("first")).select("part", F.col("first.row").alias("kept"))
    by_row = groups.groupBy("row", "part").agg(F.count(F.lit(1)).alias("times"))
    marks = by_row.join(first, "part").select("row", (F.col("row") == F.col("kept")).alias("stays"), "times")
    marks = materialize(marks.where("not stays or times > 1").select("row", "stays"))
    rows = docs.select(_row_hash(key, text).alias("row"), F.struct("*").alias("doc"))
    held = _may_hold(rows, _bit_filter(marks, "row"), "row")
    judged = held.where("__maybe").join(marks, "row", "left")
    clear = held.where("not __maybe").select("doc")
    unmarked = judged.where("stays is null").select("doc")
    repeated = judged.where("stays").dropDuplicates(["row"]).select("doc")
    return clear.union(unmarked).union(repeated).select("doc.*")
