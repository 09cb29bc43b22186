"""From documents to token ids: toxic texts, near duplicates, repeated runs and benchmark passages go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, neardup, repeats, severity
from tidemark.llm.queries import table, vocabulary
from tidemark.llm.workspace import Workspace

#: Documents whose chance of any toxicity is at least this go.
TOXIC_P = severity.TOXIC_P
#: Runs of so many words that occur earlier are cut.
REPEAT_WORDS = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts graded toxic go; null and empty ones have no words and stay.  Fitted on the labels of the whole documents table."""
    model = severity.fit_on_labels(table(spark, sf_dir, "documents"), severity.label_grades(table(spark, sf_dir, "labels")))
    return severity.grade_documents(docs, model).filter(F.col("toxic_p") < TOXIC_P).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 on five-word shingles the smallest doc_id stays; rows without doc_id or words stay."""
    gone = neardup.near_duplicates(spark, docs, size=5, percent=80).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of REPEAT_WORDS words that occur earlier are cut; n_chars follows; texts that lose nothing stay as they are."""
    out = repeats.drop_repeats(spark, docs, REPEAT_WORDS, join_with=None)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the whole texts, and whether they decode to the same bytes."""
    out = bpe.encode_decode(docs, vocabulary("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("exact"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeated_runs", cut_repeats), ("decontamination", drop_leaks), ("bpe", encode)]

#: Stages that fit a model or hash bands are beyond SQL; tests compare the operators with brute force, not the whole pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, former = space.table(stage(spark, docs, sf_dir), name), held
        if former is not None:
            space.drop(former)  # its reader has been written
        held = docs
    return docs
