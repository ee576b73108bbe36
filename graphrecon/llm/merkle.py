"""Merkle manifest of a table: a digest for each row, roots above them, and a proof for every row.

Rows are leaves, ordered inside groups. Of a group's nodes every two neighbours become their hash (a last
single one its own) until one is left, the group's root; the group roots become the table's root in the
same way. A block of ``BLOCK`` aligned nodes is one row that keeps each of its levels as one hex string:
parents are the hashes of its substrings of two digests, a node's sibling is the substring beside its own.
The top nodes of all blocks are the nodes of the next round, so the rows fall by ``BLOCK`` a round and no
task sees more than a block, however large a group is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrecon.operators.prefix import global_index
from graphrecon.session import materialize

BITS = 8
BLOCK = 1 << BITS
#: Groups up to which their sizes are sent to every task; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000
_DIGEST = 64  # hex digits


def field(name: str | Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; ``-`` for null."""
    value = (F.col(name) if isinstance(name, str) else name).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: str | Column) -> Column:
    """SHA-256 (lowercase hex) of the values, each preceded by its length."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(digest: Column, siblings: Column) -> Column:
    """The root that a digest and its siblings (``left``, ``digest``; empty where a node was alone) lead to."""

    def up(below: Column, s: Column) -> Column:
        before = F.when(s["left"], s["digest"]).otherwise("")
        after = F.when(s["left"], "").otherwise(s["digest"])
        return F.sha2(F.concat(before, below, after), 256)

    return F.aggregate(siblings, digest, up)


def proof_digest(siblings: Column) -> Column:
    """SHA-256 of all siblings' digests, from the leaf up."""
    return F.sha2(F.array_join(F.transform(siblings, lambda s: s["digest"]), ""), 256)


def _at(level: Column, place: Column, digests: int = 1) -> Column:
    """So many digests of a level's string from a place on, fewer at its end."""
    return F.substring(level, (place * _DIGEST + 1).cast("int"), F.lit(digests * _DIGEST))


def _parents(level: Column) -> Column:
    """The level above, as bytes: substrings of bytes are cut without a walk over the characters before."""
    pairs = F.sequence(F.lit(0), ((F.length(level) - 1) / (2 * _DIGEST)).cast("int"))
    return F.array_join(F.transform(pairs, lambda i: F.sha2(_at(level, i * 2, 2), 256)), "").cast("binary")


def _siblings(levels: Column, place: Column) -> Column:
    """A node's sibling on each level of its block but the top."""
    below = F.slice(levels, F.lit(1), F.size(levels) - 1)

    def beside(level: Column, k: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(2), k)).cast("int")
        return F.struct((at % 2 == 1).alias("left"), _at(level, at.bitwiseXOR(F.lit(1))).cast("string").alias("digest"))

    return F.transform(below, beside)


def _climb(nodes: DataFrame, rounds: int) -> DataFrame:
    """``nodes`` (``group``, ``size`` of the group, ``pos``, ``digest``, ``held``) with ``siblings`` and ``top``."""
    block, many = F.floor(F.col("pos") / BLOCK), F.col("size") > BLOCK
    rows = nodes.groupBy("group", "size", block.alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "held"))).alias("nodes")
    )
    first = F.array_join(F.transform("nodes", lambda n: n["digest"]), "").cast("binary")
    height = F.when(many, BITS).otherwise(F.length(F.bin(F.size("nodes") - 1)) * (F.size("nodes") > 1).cast("int"))
    steps = F.slice(F.sequence(F.lit(0), F.lit(BITS)), F.lit(1), height)
    levels = F.aggregate(steps, F.array(first), lambda found, _: F.concat(found, F.array(_parents(F.element_at(found, -1)))))
    rows = rows.withColumn("levels", levels)
    if rounds > 1:
        rows = materialize(rows)
        nothing = F.lit(None).cast("long")
        tops = rows.select(
            "group",
            F.ceil(F.col("size") / BLOCK).alias("size"),
            F.col("block").alias("pos"),
            F.element_at("levels", -1).cast("string").alias("digest"),
            nothing.alias("held"),
        )
        above = materialize(_climb(tops, rounds - 1).select("group", F.col("pos").alias("block"), F.col("siblings").alias("more"), "top"))
        rows = rows.join(above, ["group", "block"])
        more, top = F.col("more"), F.col("top")
    else:
        more, top = None, F.element_at("levels", -1).cast("string")
    each = rows.select("group", "size", F.explode("nodes").alias("n"), "levels", top.alias("top"), *([more] if rounds > 1 else []))
    own = _siblings(F.col("levels"), F.col("n.pos") % BLOCK)
    return each.select(
        "group", "size", "n.pos", "n.digest", "n.held", F.concat(own, "more").alias("siblings") if rounds > 1 else own.alias("siblings"), "top"
    )


def _rounds(size: int | None) -> int:
    found = 1
    while (size or 0) > BLOCK:
        size, found = -(-size // BLOCK), found + 1
    return found


def merkle_tree(rows: DataFrame, group: str, order: Sequence[str], digest: str, held: Sequence[str] = ()) -> DataFrame:
    """``group`` (as text), ``digest``, the ``held`` columns, ``siblings``, ``subroot`` and ``root`` of each row.

    ``siblings``: from the leaf to the root, one for each level (``left`` tells its side; ``digest`` is empty
    where a node was alone). Rows of a group ascend by ``order``, nulls first, ties by digest; groups ascend
    bytewise, a null one, which is a group of its own, first. Equal rows are leaves each. An empty table
    gives an empty result. Digests, not rows, are sorted: two shuffles of the digests and the held columns.
    """
    marked = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    slim = rows.select(marked.alias("group"), F.struct(*order).alias("order"), F.col(digest).alias("digest"), F.struct(*held, digest).alias("held"))
    placed = materialize(global_index(slim, ["group", "order", "digest"], "idx"))
    groups = materialize(placed.groupBy("group").agg(F.min("idx").alias("start"), F.count(F.lit(1)).alias("size")))
    count, most = groups.agg(F.count(F.lit(1)), F.max("size")).first()
    known = F.broadcast(groups) if count <= BROADCAST_GROUPS else groups
    nodes = placed.join(known, "group").select("group", "size", (F.col("idx") - F.col("start")).alias("pos"), "digest", "held")
    climbed = materialize(_climb(nodes, _rounds(most)))
    subroots = climbed.where("pos = 0").select(F.col("group").alias("name"), "top")
    ranked = global_index(subroots, ["name"], "pos").select(
        F.lit("").alias("group"), F.lit(count).cast("long").alias("size"), "pos", F.col("top").alias("digest"), F.col("name").alias("held")
    )
    roots = _climb(ranked, _rounds(count)).select(F.col("held").alias("group"), F.col("siblings").alias("more"), F.col("top").alias("root"))
    roots = F.broadcast(materialize(roots)) if count <= BROADCAST_GROUPS else materialize(roots)
    return climbed.join(roots, "group").select(
        F.when(F.col("group") != "", F.expr("substring(group, 2)")).alias("group"),
        "held.*",
        F.concat("siblings", "more").alias("siblings"),
        F.col("top").alias("subroot"),
        "root",
    )


def document_manifest(docs: DataFrame, changed: Column) -> DataFrame:
    """Leaf, roots and siblings of each row of ``docs``; ``altered`` is the leaf with one more in ``n_chars`` where ``changed``.

    A null stands in a leaf as ``-`` and a null ``n_chars`` stays null; other columns than the five of the
    leaf aren't read. Any text length goes: a text is hashed where it is read and not moved.
    """
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    altered = leaf("doc_id", "source", "lang", F.col("n_chars") + 1, "text")
    leaves = docs.select("doc_id", "lang", leaf(*names).alias("leaf"), F.when(changed & F.col("n_chars").isNotNull(), altered).alias("altered"))
    return merkle_tree(leaves, "lang", ["doc_id"], "leaf", ["doc_id", "altered"])
