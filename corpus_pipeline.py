"""A corpus from documents to token files, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and all rows that the stage before kept, and returns a DataFrame;
``run`` writes it as Parquet in the shared folder and reads it again for the next. All but the last
return the columns of ``documents``. The first is a trained classifier, which SQL can't express, so there
is no ORACLE_SQL: the tests hold every stage against a brute-force version.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphrecon.llm.batches import light_batches
from graphrecon.llm.decontaminate import decontaminate
from graphrecon.llm.mixing import mixed_documents
from graphrecon.llm.ngram_join import keep_one
from graphrecon.llm.ordinal import accepted, grade_texts, label_grades, train
from graphrecon.llm.wavelet import read_shards, shard_folder, write_shards
from graphrecon.session import ensure_checkpoint_dir

ORACLE_SQL = None
END_ID = 2


def packed(docs: DataFrame) -> DataFrame:
    """``text``, and all other columns, of any name, as ``doc``: so tasks get each text once."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("text", F.struct(*others).alias("doc"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose best grade is likelier than not, by a model of the rated ones among them."""
    ratings = label_grades(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    graded = grade_texts(packed(docs), train(docs, ratings), keep=("text", "doc"))
    return unpacked(graded.where(accepted(F.col("p_best"))), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id."""
    return keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a twentieth of their words or more in benchmark passages; their texts stay as they are."""
    return unpacked(decontaminate(packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its place, tokens and checksum, from the shards written."""
    folder = shard_folder(spark, "corpus")
    write_shards(docs, folder, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return read_shards(folder, spark)


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        with light_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{at}")
        docs = spark.read.parquet(f"{folder}/{at}")
    return docs
