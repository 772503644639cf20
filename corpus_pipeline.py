"""Preparation of a training corpus: stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns what it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busline.llm import banding, pieces, postings, votes, winnow
from busline.llm.common import stored
from busline.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the weighted votes of all rules keep."""
    return votes.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are deleted; a document that consisted of nothing else goes."""
    cut = winnow.dedup_lines(docs)
    kept = cut.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    length = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", length).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return banding.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of a benchmark item go."""
    return postings.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they decode to."""
    vocabulary = pieces.Vocabulary.load(tokenizer_path())
    coded = pieces.encode(docs.select("doc_id", "text", "lang", "source"), vocabulary).drop("text")
    return pieces.decode(coded, vocabulary).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [("quality rules", keep_quality), ("line dedup", drop_repeated_lines), ("near duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("tokenisation", tokenise)]
#: The weighted votes and the piece model have no SQL form; tests check the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages, in order, to ``documents``. What a stage keeps is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stored(docs, f"stage{n}")
    return docs
