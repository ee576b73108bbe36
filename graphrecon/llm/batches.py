"""New columns from whole texts, a few texts at a time, with all other columns passed on untouched."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructType

#: Texts that are Python objects at a time.
LOT = 250
#: Bytes of rows that are sent to Python at a time.
BATCH_BYTES = 4 << 20
_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_ARROW = {
    "long": pa.int64(),
    "double": pa.float64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<string>": pa.list_(pa.string()),
    "array<struct<a:int,b:int>>": _SPANS,
}


@contextmanager
def light_batches(spark: SparkSession, most: int = BATCH_BYTES):
    """What is run inside sends at most so many bytes (and one row) at once to Python; the default is many texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def add_columns(
    df: DataFrame, inputs: Sequence[str], added: dict[str, str], compute: Callable, drop: Sequence[str] = ()
) -> DataFrame:
    """``df`` with the ``added`` columns (name: type), computed from the ``inputs`` columns' values.

    ``compute`` gets a list for each input, ``LOT`` rows long at most, and returns a list for each added
    column. A column of an added name is replaced; ``drop`` names columns that end here.
    """
    gone = {*drop, *added}
    passed = [i for i, c in enumerate(df.columns) if c not in gone]
    where = [df.columns.index(c) for c in inputs]
    names, kinds = list(added), [_ARROW[k] for k in added.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, LOT):
                some = batch.slice(at, LOT)
                found = compute(*[some.column(i).to_pylist() for i in where])
                new = [pa.array(values, kind) for values, kind in zip(found, kinds)]
                columns = [some.column(i) for i in passed]
                yield pa.RecordBatch.from_arrays([*columns, *new], [*(some.schema.names[i] for i in passed), *names])

    schema = StructType([df.schema[i] for i in passed])
    for name, kind in added.items():
        schema = schema.add(name, DataType.fromDDL(kind))
    return df.mapInArrow(run, schema)
