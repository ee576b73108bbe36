"""Session helpers: where intermediate results are cut off from their lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, taking it from the session's configuration.

    A cluster names the folder in ``spark.checkpoint.dir``. Only a local master, where
    every task sees the same disk, gets a folder of its own when none is named.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
        return named
    if not one_machine(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def one_machine(spark: SparkSession) -> bool:
    """Whether all tasks run in the driver's own process, so with its disk and cores."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, write it to the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_by(df: DataFrame, column: str) -> DataFrame:
    """``materialize``, with the rows dealt out and sorted by ``column``, and known to be so.

    A later join on the column moves the other side only. Adaptive planning doesn't tell how it
    dealt rows out, so it is off while this is planned.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    with planned_once(spark):
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(width, column).sortWithinPartitions(column).checkpoint(eager=True)


@contextmanager
def planned_once(spark: SparkSession) -> Iterator[None]:
    """Plans made here run as one job, without adaptive planning, which takes a job for each shuffle."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_down(df: DataFrame) -> DataFrame:
    """``materialize`` into compressed files, for tables that are large or soon out of use: see ``forget``.

    The rows come back in the parts that the files give, not as they were dealt out.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files of ``write_down`` beneath these tables, which nothing reads any more, and those of old shuffles."""
    for table in tables:
        spark = table.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("table-"):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
    drop_shuffles(tables[0].sparkSession)


def drop_shuffles(spark: SparkSession) -> None:
    """Let the files of shuffles behind written tables go now.

    Spark removes them when the driver's JVM collects the plans that are no longer in use, which on a large heap
    may take until the disks are full.
    """
    gc.collect()  # tables that are no longer named here are still held there until then
    spark.sparkContext._jvm.System.gc()


def task_slots(spark: SparkSession) -> int:
    """Number of tasks to spread work over: the session's shuffle width.

    On a local master, whose cores are fixed, no more than two tasks per core.
    """
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    context = spark.sparkContext
    if one_machine(spark):
        return min(width, 2 * context.defaultParallelism)
    return width
