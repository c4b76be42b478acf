"""A corpus pipeline of five stages; each works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontaminate, hilbert, jaccard, mixing, toxicity
from tidewright.llm.common import discard, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that no category rejects. Without labels, and for null or empty texts, nothing is rejected; repeated rows fare alike; an empty table stays empty; columns come back as they were, whatever their names."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group of near duplicates, that of the smallest doc_id and one row of it. Rows without words or with a null doc_id all stay; an empty table stays empty; columns as they were."""
    return jaccard.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without a passage of a test item. Null and empty texts hold none; an empty benchmark drops nothing; repeated rows fare alike; an empty table stays empty; columns as they were."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix takes them, none more than twice. Sources are told apart with null as one of them; documents without words go with their source's cut; repeated rows are mixed as rows; an empty table stays empty; columns as they were."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with their shard and slot. Null dimensions have a place of their own on the curve, ties go by doc_id; every row, repeated ones too, is in one shard; an empty table stays empty; other columns as they were."""
    return hilbert.hilbert_shards(docs, 40, ["n_chars"], ["source", "lang"], ["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Models, components and dual iterations have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each is written, and what it was made of is deleted then, so no more than two stand side by side."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
