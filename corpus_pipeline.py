"""A corpus pipeline of text operators; each stage reads what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retroscope.llm import classifier
from retroscope.llm._common import store, table
from retroscope.llm.decontamination import contaminated
from retroscope.llm.minhash_dedup import near_duplicates
from retroscope.llm.packing import pack
from retroscope.llm.suffix_dedup import cut_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of the shortest passage that suffix_dedup removes: fifty words of three letters and a blank.
PASSAGE = 200


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half go."""
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.accepted(docs, model).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; rows without words are duplicates of nothing."""
    dropped = near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated strings of PASSAGE bytes, all copies of them; a text of which nothing is left goes.

    Characters that a cut breaks are left out; where something was cut, n_chars is counted anew.
    """
    cut = cut_repeats(docs, PASSAGE, keep="text", carry=("lang", "source", "n_chars"))
    left = cut.where("n_removed = 0 or n_removed < n_bytes")
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality_classifier), ("near_duplicates", near_duplicate), ("suffix_dedup", suffix_dedup), ("decontamination", decontamination), ("packing", packing)]

#: No stage can be written in SQL as it works. Tests hold operators against small inputs; run() and the stages have no test.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
