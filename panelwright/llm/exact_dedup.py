"""Exact deduplication by skew-safe combining.

Rows are combined three times, each time by digest and by the whole normalised text: inside the task that reads
them, in digest groups salted by that task, and across the salts. A text held by a third of all rows thus reaches
the last stage as one row for each salt. Texts never meet in one list; a row learns its winner by a join on the digest,
and on the whole text for digests that more than one text has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read_table, stored, text_or_empty

SALTS = 8


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal if they are identical after lower-casing A-Z only; null is the empty text, so null and empty rows
    form one group. The largest id of a group stays. Null ids lose to any id; a group of null ids only keeps them all
    (keep_id null). Repeated rows of the winning id are all marked kept, and all count in group_size. An empty table
    gives an empty result. Other columns are not read.
    """
    text = ascii_lower(text_or_empty(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("content")).withColumn("digest", F.sha2(F.encode("content", "UTF-8"), 256))
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("digest", "content", "salt").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    texts = salted.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    # from here on without the texts: one row a digest, and how many texts have it
    groups = stored(texts.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count("*").alias("texts")), "exact-groups")
    out = rows.select("doc_id", "digest").join(groups.where("texts = 1"), "digest")
    if not groups.where("texts > 1").isEmpty():
        shared = texts.join(groups.where("texts > 1").select("digest"), "digest", "left_semi").withColumnRenamed("n", "group_size")
        out = out.select("doc_id", "digest", "keep_id", "group_size").unionByName(rows.join(shared, ["digest", "content"]).select("doc_id", "digest", "keep_id", "group_size"))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with all their columns."""
    kept = exact_duplicates(docs, id_col, text_col, salts).where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(F.col("__kept_id")), "left_semi")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_duplicates() of documents; nulls, repeats and empty tables as there."""
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS c FROM documents),
g AS (SELECT doc_id, c, max(doc_id) OVER (PARTITION BY c) AS keep_id, count(*) OVER (PARTITION BY c) AS group_size FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(c) AS text_sha256 FROM g
"""
