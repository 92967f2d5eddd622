"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are
written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txframe.llm.common import staged
from txframe.llm.decontaminate import decontamination_stage
from txframe.llm.jaccard import jaccard_stage
from txframe.llm.mixing import mixing_stage
from txframe.llm.quality import quality_stage
from txframe.llm.sharding import sharding_stage

STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: The first, second, fourth and fifth stages learn, hash or draw; tests/llm checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
