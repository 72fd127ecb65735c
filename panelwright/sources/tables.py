"""Readers and writers: CSV, Parquet, configuration files, manifests."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that count as missing in CSV files beside the empty one (fixed values).
MISSING = ["#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def strings(spark: SparkSession, path: str, columns: list[str] | None = None, missing: bool = True) -> DataFrame:
    """A CSV file with a header, all columns text, empty where missing. Fields may hold line breaks and doubled quotes."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = reader.csv(path)
    blank = lambda c: F.when(F.col(f"`{c}`").isin(MISSING), "").otherwise(F.coalesce(F.col(f"`{c}`"), F.lit(""))) if missing else F.coalesce(F.col(f"`{c}`"), F.lit(""))
    return df.select(*[blank(c).alias(c) for c in df.columns])


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A Parquet table; columns and filter reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def exists(spark: SparkSession, path: str) -> bool:
    """By Spark's own file system, so any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def parquet_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, f"{path}/_SUCCESS") else None


def typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet folder read by a given schema; an empty frame of it if there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the folder that spark.checkpoint.dir names, which a cluster must set, and read again: lineage ends there. In a
    single process a temporary folder will do."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="panelwright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write(df: DataFrame, path: str, overwrite: bool = False, partition_by: list[str] | None = None) -> None:
    """Refuses to replace a table unless told to."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces the partitions that df has rows of and leaves the others."""
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("escape", '"').csv(path)


def consolidated(spark: SparkSession, path: str, schema: T.StructType, out: str, order: list[str] | None = None) -> dict:
    """Many files as one table; an empty folder gives an empty table with the schema's columns."""
    df = typed(spark, path, schema)
    (df.orderBy(*order) if order else df).write.mode("overwrite").parquet(out)
    return {"file_count": len(df.inputFiles()), "row_count": spark.read.parquet(out).count()}


def config(path: str) -> dict:
    """A JSON or YAML file whose top level is a mapping."""
    body = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        found = json.loads(body)
    else:
        import yaml

        found = yaml.safe_load(body)
    if not isinstance(found, dict):
        raise TypeError(f"{path} is no mapping")
    return found


def rooted(path: str, root: str | None = None) -> str:
    """Absolute paths and URLs as they are; others below root."""
    return path if os.path.isabs(path) or "://" in path else str(Path(root or os.getcwd()) / path)


def write_json(path: str, value: object) -> None:
    """Written beside the file and then moved over it, so readers see the old or the new one whole. Sets become sorted lists."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    half = target.with_name(target.name + ".part")
    half.write_text(json.dumps(value, indent=2, ensure_ascii=False, default=lambda x: sorted(x) if isinstance(x, (set, frozenset)) else str(x)), encoding="utf-8")
    os.replace(half, target)


def manifest(spark: SparkSession, path: str) -> dict:
    """Size, rows, columns and a digest of a table's files."""
    if not exists(spark, path):
        return {"path": path, "available": False, "reason": "not found"}
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(fs_path).getLength()
    df = spark.read.parquet(path)
    facts = {"path": path, "size_bytes": int(size), "rows": df.count(), "columns": df.columns}
    return facts | {"available": True, "fingerprint_sha256": hashlib.sha256(json.dumps(facts, sort_keys=True).encode()).hexdigest()}
