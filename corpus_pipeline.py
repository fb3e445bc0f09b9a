"""Corpus preparation: five operators in sequence over `documents`.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each
stage's result as Parquet and rereads it as the next one's docs. All but the last return the columns
of `documents`; n_chars follows the text where a stage changes it. Columns beside those are kept, whatever their names,
and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import decontam, jaccard_join, langid, packing, pii
from lexweave.session import bound_batches, materialize, ship_package, table


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    bound_batches(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the identifier rejects go; it learns from the labelled rows of its input.

    Null texts and texts without a letter are rejected, equal rows are judged alike, and without any
    labelled row every document stays."""
    _ready(spark)
    return langid.keep_known(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents stays: the one with the least doc_id.

    Null and wordless texts are like no other and all stay; of equal rows one stays."""
    _ready(spark)
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go.

    Null texts hold none, and an empty benchmark takes nothing."""
    _ready(spark)
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are generalised; no document goes.

    Null texts stay null and keep their n_chars."""
    _ready(spark)
    return pii.sanitise(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, placed in sequences: a null text is an empty one, of one piece with the end token."""
    _ready(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", sanitisation),
    ("bestfit_packing", packed),
]

#: Trained models, similarity classes and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
