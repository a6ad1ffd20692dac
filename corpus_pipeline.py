"""The corpus pipeline: toxicity, near-duplicates, repeated passages, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as
Parquet in the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from laddersmith.llm import bpe, decontaminate, near_dup, suffix_dedup, toxicity
from laddersmith.llm.common import read
from laddersmith.session import drop, made, materialize

#: What the stage before wrote for itself; its result has been written when the next one begins, so it is of no more use then.
_LEFT: set[str] = set()


def _sweeping(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _LEFT, docs)
        before = made(spark)
        out = stage(spark, docs, sf_dir)
        _LEFT.clear()
        _LEFT.update(made(spark) - before)
        return out

    return run


STAGES = [
    ("toxicity", _sweeping(toxicity.stage)),
    ("minhash_near_dedup", _sweeping(near_dup.stage)),
    ("suffix_array_dedup", _sweeping(suffix_dedup.stage)),
    ("benchmark_decontamination", _sweeping(decontaminate.stage)),
    ("byte_level_bpe", _sweeping(bpe.stage)),
]

#: The stages learn a classifier, sample hashes and encode tokens: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
