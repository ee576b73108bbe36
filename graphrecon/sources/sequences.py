"""Sequence files: FASTA records and CSV tables, merged by source priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphrecon.functions.parsing import (
    ID_COLUMN_NAMES,
    SEQUENCE_COLUMN_NAMES,
    clean_sequence,
    header_id,
    resolve_column,
    strip_blanks,
)
from graphrecon.sources.runlogs import paths_by_header

# File suffixes by format.
CSV_SUFFIXES = (".csv",)
FASTA_SUFFIXES = (".fasta", ".fa", ".faa", ".fna", ".fas")
EXPLICIT, TABLE, RECORDS = 0, 1, 2  # source priorities: named file, CSV files, FASTA files


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per record with its ``path`` and place in the file, however the file is split.

    Text before the first header of a file is no record: of a file's first stretch only one that
    begins with a header counts.
    """
    lines = spark.read.option("lineSep", "\n>").text(path)
    placed = lines.select("value", F.col("_metadata.file_path").alias("path"), _block_start().alias("at"))
    firsts = placed.groupBy("path").agg(F.min("at").alias("first"))
    headed = (F.col("at") != F.col("first")) | F.col("value").rlike(r"\A\s*>")
    return parse_fasta(placed.join(firsts, "path").filter(headed).select("value", "path", "at"))


def _block_start() -> Column:
    # order of records: start of the file block, then row number in it
    return F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )


def parse_fasta(records: DataFrame) -> DataFrame:
    """``id, seq`` from records ``value`` (header line, then body lines); other columns stay.

    The first record of a file may still have its ``>``.
    """
    rest = [c for c in records.columns if c != "value"]
    text = F.regexp_replace(F.col("value"), r"\A\s*>", "")
    head = strip_blanks(F.regexp_extract(text, r"\A([^\n]*)", 1))
    body = F.regexp_replace(text, r"\A[^\n]*\n?", "")
    return records.select(
        header_id(head).alias("id"), clean_sequence(body).alias("seq"), *rest
    ).filter(F.col("id") != "")


def table_sequences(
    table: DataFrame, id_column: str | None = None, sequence_column: str | None = None
) -> DataFrame | None:
    """``id, seq`` of a table with whatever spelling of its columns; None when one is missing."""
    ids = resolve_column(table.columns, id_column, ID_COLUMN_NAMES, "id")
    seqs = resolve_column(table.columns, sequence_column, SEQUENCE_COLUMN_NAMES, "sequence")
    if ids is None or seqs is None:
        return None
    return table.select(
        strip_blanks(F.col(f"`{ids}`").cast("string")).alias("id"),
        clean_sequence(F.coalesce(F.col(f"`{seqs}`"), F.lit(""))).alias("seq"),
    )


def read_sequence_csv(
    spark: SparkSession, path: str, id_column: str | None = None, sequence_column: str | None = None
) -> DataFrame | None:
    return table_sequences(spark.read.csv(path, header=True), id_column, sequence_column)


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def discover(required: DataFrame, candidates: DataFrame) -> DataFrame:
    """First sequence per required id: ``id, seq, path``.

    ``candidates``: id, seq, priority, path, at. Order: priority, depth of the path, path,
    place in the file. Empty sequences never win. The first is kept by an aggregate, so an id
    repeated very often costs no sort.
    """
    usable = candidates.filter(F.col("seq") != "")
    first = usable.groupBy("id").agg(
        F.min_by(
            F.struct("seq", "path"),
            F.struct("priority", path_depth(F.col("path")).alias("depth"), "path", "at"),
        ).alias("first")
    )
    return required.select("id").distinct().join(first, "id").select("id", "first.*")


def missing_sequences(required: DataFrame, found: DataFrame) -> DataFrame:
    return required.select("id").distinct().join(found.select("id"), "id", "left_anti")


def require_sequences(required: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` itself, or an error naming the first ten missing ids."""
    gap = missing_sequences(required, found)
    shown = [r["id"] for r in gap.orderBy("id").limit(10).collect()]
    if shown:
        raise ValueError(f"no sequence for: {', '.join(shown)} (missing={gap.count()})")
    return found


def _listed(spark: SparkSession, roots: Sequence[str], suffixes: Sequence[str]) -> list[str]:
    """Files with one of the suffixes below the roots; only names are read."""
    pattern = "*{" + ",".join(suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return [r["path"] for r in files.load(list(roots)).select("path").distinct().collect()]


def _csv_candidates(
    spark: SparkSession, paths: Sequence[str], id_column: str | None, sequence_column: str | None
) -> list[DataFrame]:
    """One table for each distinct header of the files; files without the two columns give none."""
    found = []
    for _, group in paths_by_header(spark, paths):
        whole = spark.read.csv(group, header=True).withColumns(
            {"__path": F.col("_metadata.file_path"), "__at": _block_start()}
        )
        ids = resolve_column(whole.columns, id_column, ID_COLUMN_NAMES, "id")
        seqs = resolve_column(whole.columns, sequence_column, SEQUENCE_COLUMN_NAMES, "sequence")
        if ids is not None and seqs is not None:
            found.append(
                whole.select(
                    strip_blanks(F.col(f"`{ids}`").cast("string")).alias("id"),
                    clean_sequence(F.coalesce(F.col(f"`{seqs}`"), F.lit(""))).alias("seq"),
                    F.col("__path").alias("path"),
                    F.col("__at").alias("at"),
                )
            )
    return found


def find_sequences(
    spark: SparkSession,
    required: DataFrame,
    roots: Sequence[str],
    explicit: str | None = None,
    id_column: str | None = None,
    sequence_column: str | None = None,
) -> DataFrame:
    """``id, seq, path`` of each required id, or an error naming the first missing ones.

    The explicit file comes first (an unknown extension is an error), then all CSV files below the
    roots, then all FASTA files, each by depth and path. One scan per distinct CSV header, and one of all
    FASTA files.
    """
    tables: list[tuple[int, DataFrame]] = []
    if explicit is not None:
        if explicit.lower().endswith(CSV_SUFFIXES):
            tables += [(EXPLICIT, t) for t in _csv_candidates(spark, [explicit], id_column, sequence_column)]
        elif explicit.lower().endswith(FASTA_SUFFIXES):
            tables.append((EXPLICIT, read_fasta(spark, explicit)))
        else:
            raise ValueError(f"unsupported sequence file extension: {explicit}")
    if roots:
        tables += [
            (TABLE, t)
            for t in _csv_candidates(spark, _listed(spark, roots, CSV_SUFFIXES), id_column, sequence_column)
        ]
        records = _listed(spark, roots, FASTA_SUFFIXES)
        if records:
            tables.append((RECORDS, read_fasta(spark, records)))
    if not tables:
        return require_sequences(required, required.select("id", F.lit("").alias("seq"), F.lit("").alias("path")).limit(0))
    columns = ["id", "seq", "priority", "path", "at"]
    whole = union_candidates([t.withColumn("priority", F.lit(p)).select(*columns) for p, t in tables])
    return require_sequences(required, discover(required, whole))


def union_candidates(tables: Sequence[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole
