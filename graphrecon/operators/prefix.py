"""Global order without a single-task sort: positions and running totals over a whole table.

Every operator that needs a rank, a cut after n rows, or a running count builds on this.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphrecon.functions.keys import KEY_BITS
from graphrecon.session import materialize, task_slots

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _offsets(per_part: DataFrame, part: str, totals: Sequence[str]) -> DataFrame:
    """Exclusive running totals over the parts. One row per part: safe to broadcast."""
    before = Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        part, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}__before") for c in totals]
    )


def in_order(
    df: DataFrame,
    order_by: Sequence[Column | str],
    write: Callable[[DataFrame], DataFrame] = materialize,
    unique: bool = False,
) -> DataFrame:
    """Range-partitioned, sorted and written once, so that both later passes see the same parts.

    With ``unique`` equal rows become one where they meet; they do, as ranges don't part them.
    """
    spread = df.repartitionByRange(*order_by)
    spread = (spread.distinct() if unique else spread).sortWithinPartitions(*order_by)
    return write(spread.withColumn("__row", F.monotonically_increasing_id())).withColumn(
        "__part", F.shiftright("__row", _ROW_BITS)
    )


def global_index(
    df: DataFrame,
    order_by: Sequence[Column | str],
    name: str = "idx",
    write: Callable[[DataFrame], DataFrame] = materialize,
    unique: bool = False,
) -> DataFrame:
    """Add the 0-based position of each row in the total order of ``order_by``, with ``unique`` of each different row.

    The columns have to identify a row (end them with an id): then no range can be hot.
    """
    return number_rows(in_order(df, order_by, write, unique).drop("__part"), name)


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """0-based position of each row by ``__row`` (``monotonically_increasing_id``), which it replaces.

    The table is read twice and has to come in the same parts.
    """
    rows = df.withColumn("__part", F.shiftright("__row", _ROW_BITS)).withColumn(
        "__at", F.col("__row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    )
    sizes = rows.groupBy("__part").agg((F.max("__at") + 1).alias("__n"))
    offsets = _offsets(sizes, "__part", ["__n"])
    return (
        rows.join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__n__before") + F.col("__at"))
        .drop("__part", "__row", "__at", "__n__before")
    )


def running_totals(
    df: DataFrame, order_by: Sequence[Column | str], values: Sequence[str]
) -> DataFrame:
    """Add ``<value>_upto``: the total of ``value`` over all rows up to and including this one."""
    rows = in_order(df, order_by)
    sums = rows.groupBy("__part").agg(*[F.sum(v).alias(v) for v in values])
    offsets = _offsets(sums, "__part", values)
    upto = (
        Window.partitionBy("__part")
        .orderBy("__row")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.join(F.broadcast(offsets), "__part")
        .select(
            "*",
            *[(F.col(f"{v}__before") + F.sum(v).over(upto)).alias(f"{v}_upto") for v in values],
        )
        .drop("__part", "__row", *[f"{v}__before" for v in values])
    )


def random_rank(
    df: DataFrame,
    key: str,
    ties: Sequence[str],
    name: str = "rank",
    groups: Sequence[str] = (),
) -> DataFrame:
    """0-based position by a uniform 60-bit ``key`` (ties by ``ties``), inside each group.

    The key's top bits cut the table into even slices, so neither sampling nor a written copy
    is needed and a group of any size is spread over all slices.
    """
    slots = max(2, 2 * task_slots(df.sparkSession))
    bits = min(16, (slots - 1).bit_length())
    groups = list(groups)
    rows = df.withColumn("__slice", F.shiftright(F.col(key), KEY_BITS - bits))
    sizes = rows.groupBy(*groups, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = (
        Window.partitionBy(*(groups or [F.lit(0)]))
        .orderBy("__slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *groups, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy(*groups, "__slice").orderBy(key, *ties)
    return (
        rows.withColumn("__in", F.row_number().over(inside) - 1)
        .join(offsets, [*groups, "__slice"])
        .withColumn(name, F.col("__before") + F.col("__in"))
        .drop("__slice", "__in", "__before")
    )
