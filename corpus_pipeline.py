"""A corpus pipeline: quality rules, quality classifier, near-duplicates, repeated passages, packing.

Edge cases, as the stages' operators define them: a null or blank text fails
the base rules; very long texts are judged, cut and packed whole; rows with the
same id each stand for themselves, and near copies among them stay unless a
smaller id has one; rows without an id are judged by their texts, are never
dropped as copies, and lose no passages; equal texts leave the one of the
smallest id; empty tables give empty results; columns beyond those of
documents pass through the filters, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrand.llm import near_copies, packing, quality_rules, substring, weak_quality
from quillstrand.llm.queries import tokenizer
from quillstrand.session import materialize, read_table


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.quality_rules(docs, read_table(spark, sf_dir, "labels")).where("kept").select(docs.columns)


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these documents, keeps."""
    return weak_quality.quality_classifier(docs, read_table(spark, sf_dir, "labels")).where("kept").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates: SimHash of five-word shingles, and bands for what four bits do not reach, judged by Jaccard similarity of 0.8 or more."""
    return near_copies.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document of a smaller id has."""
    out = substring.remove_repeats(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into sequences."""
    return packing.packed(docs, packing.Packing(tokenizer("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", by_rules),
    ("quality_classifier", by_classifier),
    ("near_duplicates", one_of_each),
    ("substring_dedup", without_repeats),
    ("packing", into_sequences),
]

#: Hidden models, tokenizers and keyed fingerprints are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
