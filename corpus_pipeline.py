"""Corpus pipeline: language ID, near-dedup, repeated passages, benchmark
decontamination, mixing. ``run`` applies the stages to ``documents``; each stage
writes Parquet to the shared folder and the next one reads it again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seqlab.llm.decontaminate import stage_decontaminate
from seqlab.llm.langid import stage_language
from seqlab.llm.mixing import stage_mix
from seqlab.llm.neardup import stage_near_duplicates
from seqlab.llm.passages import stage_passages
from seqlab.session import scratch_path

STAGES = [
    ("language_id", stage_language),
    ("near_duplicates", stage_near_duplicates),
    ("repeated_passages", stage_passages),
    ("decontaminate", stage_decontaminate),
    ("mix_sources", stage_mix),
]

# Stages decide by compressed sizes, sketches and byte hashes, which SQL cannot
# express; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
