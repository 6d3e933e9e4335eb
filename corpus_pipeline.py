"""From raw documents to a training mix: five stages, each reading all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of `documents`; the last returns what the
mix takes of every document. Stages are joined by Parquet in the folder of `spark.checkpoint.dir`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasemill.llm import decontaminate, langid, linededup, mixing, superminhash
from phasemill.llm.texts import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# no SQL twin: language identification learns a model, and MinHash confirms what its bands propose
ORACLE_SQL: str | None = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts far from every language; nothing else."""
    model = langid.fit(docs)
    return langid.identify(docs, model).filter("NOT rejected").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 10 characters or more stay in the smallest document that holds them; `n_chars` follows the text."""
    return linededup.dedup_lines(docs, min_chars=10).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 5-word shingle similarity 0.8 or more stays: the smallest doc_id."""
    return superminhash.near_duplicates(docs, shingle=5, percent=80).filter("kept").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which 5 % of the words or more lie in 13-word windows of benchmark items."""
    judged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), width=13, percent=5)
    return judged.filter("NOT contaminated").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("contamination", drop_contaminated),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
