"""Pair files: tab-separated text without a header, in the readings their users need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphrecon.functions.parsing import label_value, strip_blanks

MODES = ("lenient", "supervision", "negatives", "ratio")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines as ``value``; a missing path is an error."""
    return spark.read.text(path)


def _field(parts: Column, at: int) -> Column:
    return F.get(parts, F.lit(at))


def parse_pairs(lines: DataFrame, mode: str = "lenient") -> DataFrame:
    """``a, b, label`` from lines ``value``.

    lenient: two fields do, a missing label is 1, a bad one drops the line.
    supervision: three filled fields, bad labels dropped.
    negatives: as supervision, labels of 0 and below only.
    ratio: fields as they are (not stripped), bad labels raise, canonical pairs ``u, v``;
    positives keep their repeats, a label of 0 makes a negative, others are ignored.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    raw = F.split(strip_blanks(F.col("value")), "\t")
    if mode == "ratio":
        return _ratio_rows(lines.select(raw.alias("f")))
    parts = lines.select(F.transform(raw, strip_blanks).alias("f"))
    third = _field(F.col("f"), 2)
    named = parts.filter(F.size("f") >= 2).select(
        _field(F.col("f"), 0).alias("a"), _field(F.col("f"), 1).alias("b"), third.alias("t")
    ).filter((F.col("a") != "") & (F.col("b") != ""))
    if mode == "lenient":
        blank = F.col("t").isNull() | (F.col("t") == "")
        label = F.when(blank, F.lit(1)).otherwise(label_value(F.col("t")))
        return named.select("a", "b", label.alias("label")).filter(F.col("label").isNotNull())
    rows = named.filter(F.col("t") != "").select("a", "b", label_value(F.col("t")).alias("label"))
    if mode == "negatives":
        return rows.filter(F.col("label") <= 0)
    return rows.filter(F.col("label").isNotNull())


def _ratio_rows(parts: DataFrame) -> DataFrame:
    a, b = _field(F.col("f"), 0), _field(F.col("f"), 1)
    text = _field(F.col("f"), 2)
    value = label_value(text)
    checked = F.when(value.isNotNull(), value).otherwise(
        F.raise_error(F.concat(F.lit("bad label: "), text)).cast("int")
    )
    return (
        parts.filter(F.size("f") >= 3)
        .select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), checked.alias("label"))
        .filter(F.col("label") >= 0)
    )


def ratio_positives(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("label") > 0).select("u", "v")


def ratio_negatives_known(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("label") == 0).select("u", "v").distinct()


def parse_known_positives(lines: DataFrame) -> DataFrame:
    """Unique canonical pairs from the first two words of each line."""
    words = F.split(strip_blanks(F.col("value")), r"\s+")
    pair = lines.select(words.alias("w")).filter(F.size("w") >= 2)
    a, b = _field(F.col("w"), 0), _field(F.col("w"), 1)
    return pair.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def required_ids(*line_tables: DataFrame) -> DataFrame:
    """Distinct ids of all lines with two filled fields."""
    whole = _union(line_tables)
    parts = F.transform(F.split(strip_blanks(F.col("value")), "\t"), strip_blanks)
    both = whole.select(_field(parts, 0).alias("a"), _field(parts, 1).alias("b")).filter(
        (F.col("a") != "") & (F.col("b") != "")
    )
    return both.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def observed_nodes(*line_tables: DataFrame) -> DataFrame:
    """Distinct non-empty ids of the first two fields, even when the other field is empty."""
    parts = F.split(strip_blanks(F.col("value")), "\t")
    both = _union(line_tables).select(parts.alias("f")).filter(F.size("f") >= 2)
    ids = both.select(F.explode(F.slice("f", 1, 2)).alias("id"))
    return ids.filter(F.col("id") != "").distinct()


def _union(tables: tuple[DataFrame, ...]) -> DataFrame:
    whole = tables[0].select("value")
    for table in tables[1:]:
        whole = whole.unionByName(table.select("value"))
    return whole


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    """The table itself, or an error when it is empty."""
    if rows.isEmpty():
        raise ValueError(f"no {what} found")
    return rows


def read_pairs(spark: SparkSession, path: str | list[str], mode: str = "lenient") -> DataFrame:
    return require_rows(parse_pairs(read_lines(spark, path), mode), "valid pairs")


def split_nodes(node_split: DataFrame, name: str) -> DataFrame:
    """Ids of one named split; an unknown split is an error."""
    ids = node_split.filter(F.col("split") == name).select("id").distinct()
    return require_rows(ids, f"split {name!r}")
