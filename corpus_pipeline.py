"""The corpus pipeline: language, quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import fresh_path, scratch, table
from tessera.llm.language_id import keep_identified
from tessera.llm.near_duplicates import keep_one_of_each
from tessera.llm.packing import pack_stage
from tessera.llm.quality_rules import keep_good
from tessera.llm.substring_dedup import cut_repeats

STAGES = [
    ("language_id", keep_identified),
    ("quality_rules", keep_good),
    ("minhash_near_dedup", keep_one_of_each),
    ("substring_dedup", cut_repeats),
    ("packing", pack_stage),
]

#: Expectation-maximisation and Viterbi are not for SQL; a test holds the stages against plain Python.
ORACLE_SQL = None


def run_stages(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Runs all stages over ``documents``; where each one's result lies, by name.

    Results lie side by side in one folder of the shared folder; what a stage
    stores on its way is removed when its result is written.
    """
    folder = fresh_path(spark, "pipeline")
    docs, paths = table(spark, sf_dir, "documents"), {}
    for i, (name, stage) in enumerate(STAGES, 1):
        paths[name] = f"{folder}/{i}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(paths[name])
        docs = spark.read.parquet(paths[name])
    return paths


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; ``run_stages`` also says where the cleaned texts are."""
    return spark.read.parquet(run_stages(spark, sf_dir)[STAGES[-1][0]])
