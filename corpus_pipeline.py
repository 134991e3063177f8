"""A corpus pipeline: language ID, quality, near-duplicates, packing.

For every stage: null texts count as empty ones; ids and other columns may be null, repeated and of any
type, and pass through untouched; extra columns may have any names; repeated rows are rows of their own
(copies, for the stage that drops those); an empty table gives an empty result. A model that finds
nothing to learn from rejects nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import op3_quality, op5_packing, op7_langid, op8_simhash
from cadenza.llm.queries import QUALITY_THRESHOLD
from cadenza.llm.store import materialized


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose predicted language is not ``und``: null, empty and letterless texts go; where no language is known, all with letters stay."""
    model = op7_langid.train_language_model(docs)
    if model.net is None:
        return docs.where(F.col("text").rlike(op7_langid.LETTER))
    return op7_langid.with_language(docs, model, docs.columns).where("lang_pred <> 'und'").select("kept.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is at least the threshold; all rows where there are no labels of both kinds. A null text is scored as an empty one."""
    model = op3_quality.train_quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model.net is None:
        return docs
    return op3_quality.with_quality(docs, model, docs.columns).where(f"score >= {QUALITY_THRESHOLD}").select("kept.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group (rows without an id come last; ties go by the text's hash): five-word shingles, similarity of 0.8 or more. All texts without words are one group."""
    return op8_simhash.without_near_duplicates(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences. An empty text is its end id; a null source is a queue of its own."""
    return op5_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [("language_id", identify_languages), ("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("packing", pack_sequences)]

#: No stage is expressible in SQL; tests/llm/test_pipeline.py holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
