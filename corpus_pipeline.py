"""The corpus pipeline: five stages, each over all that the one before kept, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvana.llm import common, neardup, packing, rules, suffixes, toxicity
from corvana.llm.bpe import vocabulary_path


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary_path(), 4096, 2)


STAGES = [
    ("toxicity", toxicity.drop_toxic),
    ("quality_rules", rules.keep_good),
    ("minhash_neardup", neardup.keep_one),
    ("suffix_dedup", suffixes.strip_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return docs


#: No stage but the rules can be said in SQL; tests hold the pipeline against its parts.
ORACLE_SQL = None
