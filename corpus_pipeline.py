"""Corpus pipeline: five operators of ``promoscope.llm`` applied to ``documents`` in turn.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which ``run`` writes as Parquet and rereads as the
next stage's ``docs``. Every stage but the last returns the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promoscope.llm import decontam, langid, line_dedup, ngram_join, spm
from promoscope.llm.common import Scratch, crc_remainder, table
from promoscope.llm.queries import PIECE_MODEL


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents whose language is rejected (no letters, or low calibrated confidence) go."""
    model = langid.fit(docs, where=crc_remainder("doc_id", 5) != 0)
    return langid.predict(docs, model).filter("accepted").select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: lines that occurred before, or nearly so, leave the texts; documents left without a line go."""
    got = line_dedup.dedup_lines(docs).filter((F.col("n_lines") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return got.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each class of texts that share four fifths of their five-word shingles stays."""
    return ngram_join.one_of_each_class(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a passage of the benchmark go."""
    return decontam.annotate(docs, table(spark, sf_dir, "benchmark")).filter(F.size("matches") == 0).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: sampled pieces of every text, and whether they decode to it."""
    return spm.encode(docs, spm.Vocabulary.load(PIECE_MODEL), verify="lossless")


STAGES = [("language_id", language_id), ("line_dedup", repeated_lines), ("near_duplicates", near_duplicates),
          ("decontamination", benchmark_passages), ("sentencepiece", pieces)]

ORACLE_SQL = None       # models and edit distances have no SQL form; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
