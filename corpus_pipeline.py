"""Training-data pipeline over ``documents``: every stage is written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, line_dedup, packing, simhash
from tidemark.llm.common import NO_ID, text_hash, within
from tidemark.session import materialize, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# SQL cannot express language identification, SimHash and tokenisation; the tests hold the stages against brute force.
ORACLE_SQL = None


def _key() -> list[Column]:
    """Key of a row: doc_id, if any, and the hash of the text."""
    return [F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), text_hash().alias("_h")]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject."""
    model = language.fit(docs.filter(~language.held_out()))
    return language.identify(docs, model, COLUMNS).filter("NOT rejected").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; ``n_chars`` follows the text."""
    return line_dedup.dedup_lines(docs, keep=["lang", "source"]).select(
        "doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars")
    )


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of near-duplicate texts; rows without doc_id are rows of their own."""
    heads = simhash.kept_rows(docs).toDF("_id", "_h")
    keyed = docs.select(*COLUMNS, *_key())
    return keyed.join(heads, ["_id", "_h"], "left_semi").dropDuplicates(["_id", "_h"]).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, neither word by word nor with other numbers or names."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = materialize(decontaminate.contaminated(docs, benchmark, rows=True).select(F.col("id").alias("_id"), F.col("h").alias("_h")).distinct())
    keyed = docs.select(*COLUMNS, *_key())
    return keyed.join(within(leaks), ["_id", "_h"], "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
