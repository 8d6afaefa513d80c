"""Corpus preparation: each stage applies one operator to all that the stage before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mnemo.llm import stages
from mnemo.llm.common import shared_root

STAGES = [
    ("toxicity", stages.toxicity),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination),
    ("personal_data", stages.personal_data),
    ("best_fit_packing", stages.best_fit_packing),
]

#: Classifiers, hashing and tokenizers cannot be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order to ``documents``; each is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
