"""From raw documents to packed training sequences: STAGES, run one after the other over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.shared import save
from strandline.llm.stages import STAGES
from strandline.session import table

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: SQL cannot express BagMinHash, suffix sorting or the tokenizer; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir))
    return docs
