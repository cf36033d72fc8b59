"""The corpus pipeline: five stages over ``documents``, each one of the llm operators.

Every stage takes (spark, docs, sf_dir) and works on all rows the one before
it kept.  All but the last return the columns of ``documents``; the last
returns the packing: (doc_id, piece, n_words, bin_id, bin_offset).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fitframe.llm.decontaminate import drop_contaminated
from fitframe.llm.packing import pack
from fitframe.llm.quality import keep_good
from fitframe.llm.shared import read, staged
from fitframe.llm.simhash import drop_near_duplicates
from fitframe.llm.suffix import drop_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: three-word shingles, two bits."""
    return drop_near_duplicates(docs, shingle=3, max_bits=2)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes, which a passage of over 50 words has, are cut out of the texts."""
    return drop_repeats(docs, length=200)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into bins of 2,048 words."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the stages' joins by fingerprint and suffix; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
