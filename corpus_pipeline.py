"""Documents to packed training sequences: a chain of stages over the operators of ``runwarden.llm``.

Each stage takes all documents its predecessor kept and returns the columns of documents; the last returns the
pieces of the packed sequences. Stages may be written and read again between each other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runwarden.llm import oddsketch, packing, repeats, secrets, toxicity
from runwarden.llm.tables import carried, restored, stage

VOCABULARY = "word_bpe_49k.json"


def _with_text(found: DataFrame, docs: DataFrame, text) -> DataFrame:
    """The columns of ``docs`` with another text; n_chars, where there is one, follows it."""
    out = restored(found.withColumn("text", text), docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones, doesn't call toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return restored(toxicity.grade(carried(docs), model).where("not toxic"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles), that of the smallest id.

    Of several rows of that id one stays, the least by text. Rows without id can't be told apart and all stay.
    """
    kept = oddsketch.near_duplicates(docs).where("kept").select(F.col("id").alias("doc_id")).distinct()
    ranked = carried(docs).join(kept, "doc_id", "left_semi")
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    return restored(ranked.where("_rank = 1").drop("_rank").union(carried(docs).where("doc_id is null")), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 35 words that occur more than once; other texts stay as they are."""
    found = repeats.remove_repeats(carried(docs))
    return _with_text(found, docs, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked, those in encoded layers too."""
    found = secrets.scan(carried(docs))
    return _with_text(found, docs, F.col("clean_text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 2,048 tokens."""
    return packing.sequences(packing.pieces(docs, public_tokenizers.path(VOCABULARY)))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeats", cut_repeats),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: A tokenizer's ids can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each handed over as a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
