"""Pairs meet vectors: lookups, scores of listed pairs, scores of all pairs by blocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrecon.functions.vectors import dot, norm, unit, vector_error
from graphrecon.operators.pairs import pair_blocks

#: Vectors of a block where few pairs leave a task, and where all do; rows that are multiplied at once.
BLOCK_ROWS, ALL_PAIRS_BLOCK_ROWS, STRIPE_ROWS = 4096, 512, 256


def lookup_vectors(
    pairs: DataFrame, vectors: DataFrame, a: str = "a", b: str = "b", missing: str = "raise"
) -> DataFrame:
    """Add the vectors of both ends as ``vec_a, vec_b``; ``vectors(id, vec)``, one row per id.

    No pair is lost: an id without a vector raises, naming the first ten such ids, or, with
    ``missing="keep"``, leaves NULL. An id in very many pairs is spread by the engine's splitting
    of skewed joins, whatever the number of such ids.
    """
    if missing not in ("raise", "keep"):
        raise ValueError("missing is 'raise' or 'keep'")
    if missing == "raise":
        require_vectors(pairs, vectors, a, b)
    left = vectors.select(F.col("id").alias(a), F.col("vec").alias("vec_a"))
    right = vectors.select(F.col("id").alias(b), F.col("vec").alias("vec_b"))
    return pairs.join(left, a, "left").join(right, b, "left")


def vector_state(vec_a: Column, vec_b: Column) -> Column:
    """``both``, ``first``, ``second`` or ``none``: which ends of a pair have a vector."""
    return (
        F.when(vec_a.isNotNull() & vec_b.isNotNull(), "both")
        .when(vec_a.isNotNull(), "first")
        .when(vec_b.isNotNull(), "second")
        .otherwise("none")
    )


def missing_ids(pairs: DataFrame, vectors: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Ids used by a pair but without a vector."""
    used = pairs.select(F.explode(F.array(a, b)).alias("id")).distinct()
    return used.join(vectors.select("id"), "id", "left_anti")


def require_vectors(pairs: DataFrame, vectors: DataFrame, a: str = "a", b: str = "b") -> None:
    """Raise when an id has no vector, naming the first ten."""
    shown = [r["id"] for r in missing_ids(pairs, vectors, a, b).orderBy("id").limit(10).collect()]
    if shown:
        raise ValueError("ids without a vector: " + ", ".join(map(str, shown)))


def score_pairs(
    pairs: DataFrame,
    vectors: DataFrame,
    logit: Column,
    a: str = "a",
    b: str = "b",
    missing: str = "raise",
) -> DataFrame:
    """Score listed pairs by an expression over ``vec_a`` and ``vec_b``.

    With ``missing="keep"`` pairs without both vectors stay, with a NULL score, and ``state`` says why.
    """
    met = lookup_vectors(pairs, vectors, a, b, missing)
    if missing == "raise":
        return met.select(*pairs.columns, logit.alias("logit"))
    state = vector_state(F.col("vec_a"), F.col("vec_b"))
    scored = F.when(state == "both", logit).alias("logit")
    return met.select(*pairs.columns, scored, state.alias("state"))


def sampled_similarities(
    samples: DataFrame, vectors: DataFrame, features: Sequence[str], keys: Sequence[str] = ("node_size", "sample_id")
) -> DataFrame:
    """Cosine of every pair ``u < v`` inside each sample: ``keys, u, v`` and one column per feature.

    Vectors join the members of samples only, and meet inside a sample, which is bounded by its node size;
    pairs outside all samples are never formed. A vector of length zero has cosine 0 with all.
    """
    keys, features = list(keys), list(features)
    units = vectors.select("id", *[F.when(norm(F.col(f)) > 0, unit(F.col(f))).alias(f) for f in features])
    members = samples.select(*keys, "id").distinct().join(units, "id")
    first = members.select(*keys, F.col("id").alias("u"), *[F.col(f).alias(f"{f}__u") for f in features])
    second = members.select(*keys, F.col("id").alias("v"), *[F.col(f).alias(f"{f}__v") for f in features])
    met = first.join(second, keys).filter(F.col("u") < F.col("v"))
    cosines = [F.coalesce(dot(F.col(f"{f}__u"), F.col(f"{f}__v")), F.lit(0.0)).alias(f) for f in features]
    return met.select(*keys, "u", "v", *cosines)


def similarity_blocks(
    vectors: DataFrame,
    features: Sequence[str],
    keep_from: Mapping[str, float] | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Cosine of every unordered pair ``u < v``, one output column per feature column.

    ``vectors`` holds ``id`` and the feature arrays. A task multiplies one pair of blocks. With
    ``keep_from`` only pairs reaching one of the given cosines leave the task, so building a
    graph never ships the pairs that are not edges.

    A vector moves once per block, so blocks are as large as what a task hands on at once allows: all pairs of a cell, or the few that
    reach a cosine. A cell is multiplied by stripes of rows either way.
    """
    features = list(features)
    if block_rows is None:
        block_rows = BLOCK_ROWS if keep_from else ALL_PAIRS_BLOCK_ROWS
    cells = pair_blocks(vectors.select("id", *features), "id", block_rows)
    id_type = vectors.schema["id"].dataType.simpleString()
    schema = ", ".join([f"u {id_type}", f"v {id_type}", *[f"{f} double" for f in features]])

    def unit_rows(column: pd.Series) -> np.ndarray:
        rows = np.stack(column.to_numpy()).astype(np.float64)
        length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        return rows / np.where(length > 0, length, 1.0)

    def multiply(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        left = rows[rows["__block"] == i]
        right = rows[rows["__block"] == j]
        if left.empty or right.empty:
            return pd.DataFrame({"u": [], "v": [], **{f: [] for f in features}})
        ids_a, ids_b = left["id"].to_numpy(), right["id"].to_numpy()
        sides = {f: (unit_rows(left[f]), unit_rows(right[f])) for f in features}
        at_a, at_b, found = [], [], {f: [] for f in features}
        for start in range(0, len(left), STRIPE_ROWS):
            some = slice(start, start + STRIPE_ROWS)
            keep = ids_a[some, None] < ids_b[None, :] if i == j else np.ones((len(ids_a[some]), len(right)), dtype=bool)
            cosines = {f: x[some] @ y.T for f, (x, y) in sides.items()}
            if keep_from:
                reach = np.zeros_like(keep)
                for name, bound in keep_from.items():
                    reach |= cosines[name] >= bound
                keep &= reach
            rows, columns = np.nonzero(keep)
            at_a.append(rows + start)
            at_b.append(columns)
            for f in features:
                found[f].append(cosines[f][rows, columns])
        first, second = ids_a[np.concatenate(at_a)], ids_b[np.concatenate(at_b)]
        turned = first > second
        return pd.DataFrame(
            {
                "u": np.where(turned, second, first),
                "v": np.where(turned, first, second),
                **{f: np.concatenate(found[f]) for f in features},
            }
        )

    return cells.groupBy("__i", "__j").applyInPandas(multiply, schema)


def similarity_counts(
    vectors: DataFrame, truth: str, score: str, cut: float, digits: int = 6, block_rows: int = 2048
) -> DataFrame:
    """All unordered pairs, counted: ``truth, score, pairs``, to be rounded to ``digits`` by the caller.

    A task multiplies one pair of blocks and counts its pairs by the rounded cosine of ``score`` and by whether that of ``truth``
    reaches ``cut``, so no pair leaves it alone. ``truth`` is then 1 or 0. A cosine on the edge of a rounding, or no number, is
    handed on as it is, so that one place rounds.
    """
    cells = pair_blocks(vectors.select("id", truth, score), "id", block_rows)
    unit_size, near = 10**digits, 1e-3
    width = 2 * unit_size + 3  # cosines of -1 to 1, and one step beyond for errors of the last bit

    def unit_rows(column: pd.Series) -> np.ndarray:
        rows = np.stack(column.to_numpy()).astype(np.float64)
        length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        return rows / np.where(length > 0, length, 1.0)

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        left, right = rows[rows["__block"] == i], rows[rows["__block"] == j]
        if left.empty or right.empty:
            return pd.DataFrame({truth: [], score: [], "pairs": []})
        y, s = (unit_rows(left[f]) @ unit_rows(right[f]).T for f in (truth, score))
        if i == j:
            keep = left["id"].to_numpy()[:, None] < right["id"].to_numpy()[None, :]
            y, s = y[keep], s[keep]
        y, s = y.ravel(), s.ravel()
        steps = s * unit_size + 0.5
        plain = (np.abs(steps - np.rint(steps)) > near) & (np.abs(y - cut + 0.5 / unit_size) > near / unit_size)
        plain &= np.abs(s) <= 1 + 0.5 / unit_size
        hit = y[plain] >= cut - 0.5 / unit_size  # the half step below the cut rounds up to it
        at = (np.floor(steps[plain]).astype(np.int64) + unit_size + 1) * 2 + hit
        counts = np.bincount(at, minlength=2 * width)
        some = np.flatnonzero(counts)
        return pd.DataFrame(
            {
                truth: np.concatenate([(some % 2).astype(np.float64), y[~plain]]),
                score: np.concatenate([(some // 2 - unit_size - 1) / unit_size, s[~plain]]),
                "pairs": np.concatenate([counts[some], np.ones((~plain).sum(), np.int64)]),
            }
        )

    return cells.groupBy("__i", "__j").applyInPandas(count, f"{truth} double, {score} double, pairs long")


def audit(
    required: DataFrame, matrices: DataFrame, dim: int, max_length: int
) -> DataFrame:
    """Required ids with ``state`` ok, missing or invalid, and the reason; ``matrices(id, rows)``."""
    checked = matrices.select(
        "id", F.lit(1).alias("__here"), vector_error(F.col("rows"), dim, max_length).alias("reason")
    )
    return (
        required.select("id")
        .distinct()
        .join(checked, "id", "left")
        .select(
            "id",
            F.when(F.col("__here").isNull(), "missing")
            .when(F.col("reason").isNotNull(), "invalid")
            .otherwise("ok")
            .alias("state"),
            "reason",
        )
    )


def to_rebuild(
    audited: DataFrame, metadata: Mapping[str, object], expected: Mapping[str, object]
) -> DataFrame:
    """Ids whose vectors have to be made again: all of them when the metadata differ."""
    same = bool(metadata) and all(metadata.get(k) == v for k, v in expected.items())
    return (audited.filter(F.col("state") != "ok") if same else audited).select("id")


def preview(rows: DataFrame, key: str, first: int = 10) -> DataFrame:
    """The first few keys in order, for a message."""
    return rows.select(key).distinct().orderBy(key).limit(first)
