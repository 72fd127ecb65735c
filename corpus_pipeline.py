"""A corpus from raw documents to token files, in stages that each read what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import decontaminate, mixing, near_dedup, token_store, tokens, toxicity
from panelwright.llm.common import read_table, stored


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. It learns from labelled rows of these documents that are not held out."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles: the one with the least id."""
    return near_dedup.drop_near_duplicates(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as many times as the mix takes it."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written token store holds of each document: doc_id, start, n_tokens, ids_crc32."""
    return token_store.token_store(docs, tokens.vocabulary_path())


STAGES = [("toxicity", clean), ("near-dedup", distinct), ("decontamination", unseen), ("mixing", mixed), ("token-output", packed)]

#: Models, components and tokenizers are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Null texts pass as empty ones: no stage but the mix, which takes words, drops them. Null ids pass, and
    repeated rows pass unless the first of their texts is another row's near duplicate. An empty table gives an empty result."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
