"""Documents to packed training sequences: STAGES in order, each written and read again by the next one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from statloom.llm import jaccard, lines, mixing, nbsvm, packing
from statloom.llm.common import stored
from statloom.session import hand_over, remove_folder, working


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts."""
    return nbsvm.accepted(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat across documents, but in the largest of them."""
    return lines.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of texts linked by a Jaccard similarity of 0.8 or more in five-word shingles."""
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences along the curve, with their token ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]

# The classifier and the duals of the mixture have no SQL form; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; what a stage has left behind is deleted once the next one is stored."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    with working(spark) as outer:
        for name, stage in STAGES[:-1]:
            before = list(outer)
            with working(spark) as made:
                docs = stored(stage(spark, docs, sf_dir), name)
                outer.append(made.pop())  # the stage's own result, the last folder
            for path in before:
                outer.remove(path)
                remove_folder(spark, path)
        last = STAGES[-1][1](spark, docs, sf_dir)
        hand_over(outer)  # read by whoever uses the result
    return last
