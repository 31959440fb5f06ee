"""The corpus pipeline: five stages over documents, each reading what its predecessor wrote."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ventrica.llm.common import materialize
from ventrica.llm.decontaminate import drop_leaks
from ventrica.llm.language import keep_known_languages
from ventrica.llm.near_dup import keep_one_of_each
from ventrica.llm.packing import pack_stage
from ventrica.llm.quality import keep_good

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Rows and bytes that a Python worker is sent at a time: ten thousand whole texts, Spark's own choice, have no small bound. Results don't depend on them.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def in_small_batches(stage: Stage) -> Stage:
    """``stage`` in a session that keeps to BATCHES. They stay set, as a stage's rows are worked out after it returns; what a session sets itself holds."""

    @wraps(stage)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, value in BATCHES.items():
            if spark.conf.get(name, None) is None:
                spark.conf.set(name, value)
        return stage(spark, docs, sf_dir)

    return staged


STAGES = [
    ("language_id", in_small_batches(keep_known_languages)),
    ("quality_filter", in_small_batches(keep_good)),
    ("near_dedup", in_small_batches(keep_one_of_each)),
    ("decontamination", in_small_batches(drop_leaks)),
    ("packing", in_small_batches(pack_stage)),
]

#: Trained models and packing search are beyond SQL; the operators behind the stages are tested one by one, the whole only by what each stage may keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that pass the stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        spark.sparkContext._jvm.System.gc()  # what a stage broadcast and the classes made for its plans go only when the driver collects garbage
    return docs
