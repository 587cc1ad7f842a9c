"""The corpus pipeline: quality, near duplicates, decontamination, personal data, packing.

Each stage works on what its predecessor kept and is written before the next one
reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloq.llm.common import table, written
from colloq.llm.decontaminate import decontamination_stage
from colloq.llm.near_dup import near_dedup_stage
from colloq.llm.packing import packing_stage
from colloq.llm.pii import pii_stage
from colloq.llm.quality import quality_stage

STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", pii_stage),
    ("packing", packing_stage),
]
#: SQL cannot express the classifier; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
