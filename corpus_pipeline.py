"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm import decontaminate, exact_dedup, language, mixing, shingles
from tablesmith.llm.common import Scratch, held_out, table

#: A document whose language is less certain than this is rejected, as is one without a letter.
MIN_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows. Null and empty texts have no letter and go; rows without a known language only are not learned from; repeated rows stay."""
    model = language.train(docs, ~held_out(F.col("doc_id"), 4, 2))
    return language.keep_known(docs, model, MIN_LANGUAGE_SCORE)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of least id; a null id stays where its text has no other. Rows that repeat an id and text leave one."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that five-word shingles link at a similarity of 0.8, that of least id, null last; texts without words are one group."""
    return shingles.drop_near_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any verified window of the benchmark, however long they are. Null and empty texts stay; rows are told apart by id and text."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document with what the mix takes of it; a null source is one of its own, a text without words has size 0."""
    return mixing.mix(docs)


STAGES = [("language", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("decontaminate", benchmark_stage), ("mixing", mixing_stage)]

#: The language stage is a trained model and the near-duplicate stage takes components of a graph of similar texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``. An empty table gives an empty result, and further columns, whatever their names, go through all stages but the last."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
