"""Corpus pipeline: quality rules, near duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next stage's documents.  All stages but the last return the columns of ``documents``; the last adds ``shard`` and
``slot``.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagelake.llm import decontaminate, jaccard, mixing, quality, sharding  # noqa: E402
from pagelake.session import materialize, prepare_session  # noqa: E402


def _stage(function):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare_session(spark)
        return function(spark, docs, sf_dir)
    return run_stage


STAGES = [
    ("quality_rules", _stage(quality.keep_good)),
    ("ngram_jaccard_join", _stage(jaccard.one_of_each)),
    ("benchmark_decontamination", _stage(decontaminate.clean)),
    ("mixing_sources", _stage(mixing.mixed)),
    ("sharding", _stage(sharding.sharded)),
]

# The draws of the last two stages, and the groups of the second, are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again."""
    prepare_session(spark)
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
