"""Stages that turn raw documents into sharded training data; each reads what its predecessor wrote.

All stages but the last return rows with the columns of `documents`, extra ones included; the last
returns the place of every row in the shards. An empty table passes through all stages as one.
"""

from __future__ import annotations

from seriesloom.functions.staging import staged
from seriesloom.llm import decontam, mixing, quality, sharding, simhash


def quality_filter(spark, docs, sf_dir):
    """Documents that the classifier, learned from all labels, doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near duplicates: that of the smallest id."""
    return simhash.keep_one(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents without passages of the benchmark."""
    return decontam.without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark, docs, sf_dir):
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat_rows(docs)


def shard(spark, docs, sf_dir):
    """The shard and slot of every mixed row."""
    return sharding.shards(docs)


STAGES = [("quality_filter", quality_filter), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]
#: SQL can't express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
