"""Runs in monthly shards and batches that can be taken up again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions import protocol, text
from panelwright.sources import tables

from . import extract, resolve

MODES = ("dry_run", "mock", "real")


@dataclass(frozen=True)
class RunConfig:
    start: str = "2015-09-01"
    end: str = "2023-12-31"
    seed: int = 7
    batch_size: int = 128
    mode: str = "mock"
    only_mapped: bool = True
    only_with_ticker: bool = True
    max_shards: int | None = None
    rows_per_shard: int | None = None
    batches_per_shard: int | None = None
    mock_targets: tuple[str, ...] = extract.MOCK_TARGETS
    mock_events: tuple[str, ...] = extract.MOCK_EVENTS
    failing: list[str] = field(default_factory=list)
    event_types: tuple[str, ...] = extract.EVENT_TYPES
    batches_per_commit: int = 64
    resolver: resolve.ResolverConfig = field(default_factory=resolve.ResolverConfig)


def planned(news: DataFrame, config: RunConfig) -> DataFrame:
    """The run's rows with shard_id, row_number (from 0 by date and id within the shard), batch_id and row_seed. Rows are numbered within
    their day, and the days before are added from counts, one for each day of the period; so no task sorts a month."""
    rows = news.where(F.col("published_date").between(config.start, config.end))
    if config.only_mapped:
        rows = rows.where(protocol.true("is_mapped"))
    if config.only_with_ticker:
        rows = rows.where(text.strip(text.or_empty("source_ticker")) != "")
    before = Window.partitionBy("__month").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(F.col("published_date").alias("__day")).agg(F.count("*").alias("__n")).withColumn("__month", text.month("__day"))
    days = days.select("__day", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("published_date").orderBy("news_id")) - 1
    rows = rows.withColumn("__own", own).join(F.broadcast(days), F.col("published_date") == F.col("__day"))  # dates between start and end
    rows = rows.withColumn("shard_id", text.month("published_date")).withColumn("row_number", (F.col("__own") + F.col("__before")).cast("long")).drop("__own", "__day", "__before")
    out = rows.withColumn("batch_id", F.floor(F.col("row_number") / config.batch_size).cast("long")).withColumn("row_seed", F.lit(config.seed).cast("long") + F.col("row_number"))
    if config.rows_per_shard is not None:
        out = out.where(F.col("row_number") < config.rows_per_shard)
    if config.batches_per_shard is not None:
        out = out.where(F.col("batch_id") < config.batches_per_shard)
    if config.max_shards is not None:
        first = protocol.months(news.sparkSession, config.start, config.end).orderBy("shard_id").limit(config.max_shards).select("shard_id")
        out = out.join(F.broadcast(first), "shard_id", "left_semi")
    return out


def plan_counts(news: DataFrame, config: RunConfig) -> DataFrame:
    """Rows and batches of every month of the period, empty months too."""
    months = protocol.months(news.sparkSession, config.start, config.end).select("shard_id")
    n = planned(news, config).groupBy("shard_id").agg(F.count("*").alias("rows"), F.count_distinct("batch_id").alias("batches"))
    return months.join(n, "shard_id", "left").select("shard_id", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("batches", F.lit(0)).alias("batches"))


def remaining(rows: DataFrame, finished: DataFrame | None) -> DataFrame:
    """The rows whose batch is not finished."""
    return rows if finished is None else rows.join(finished.select("shard_id", "batch_id").distinct(), ["shard_id", "batch_id"], "left_anti")


def checkpoint(rows: DataFrame, results: DataFrame, months: DataFrame) -> DataFrame:
    """For each month: rows and batches planned and done, the last batch done, successes, failures, edges, the times of the first and last answer, and a
    status that follows from the counts alone. results are rows of extraction()."""
    want = rows.groupBy("shard_id").agg(F.count("*").alias("rows"), F.count_distinct("batch_id").alias("batches"))
    good = F.col("status") == "success"
    have = results.groupBy("shard_id").agg(
        F.count("*").alias("processed"), F.count_if(good).alias("success"), F.count_if(F.col("status") == "failed").alias("failure"), F.count_distinct("batch_id").alias("batches_done"),
        F.coalesce(F.sum(F.when(good, F.col("resolved_target_count"))), F.lit(0)).alias("resolved_edge_count"), F.max("batch_id").alias("last_batch"), F.min("processed_at_utc").alias("started_at"), F.max("processed_at_utc").alias("finished_at"),
    )
    out = months.select("shard_id").join(want, "shard_id", "left").join(have, "shard_id", "left").na.fill(0, ["rows", "batches", "processed", "success", "failure", "batches_done", "resolved_edge_count"])
    return out.withColumn("state", F.when(F.col("rows") == F.col("processed"), "completed").when(F.col("processed") > 0, "partial").otherwise("pending"))


def totals(checkpoint: DataFrame) -> DataFrame:
    return checkpoint.agg(F.count("*").alias("shards"), F.count_if(F.col("state") == "completed").alias("completed_shards"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("rows", "processed", "success", "failure")], F.coalesce(F.sum("resolved_edge_count"), F.lit(0)).cast("long").alias("edges"))


TABLES = {"raw": extract.RAW, "extractions": extract.PARSED, "failures": extract.FAILURES, "edges": resolve.EDGES}


def run(spark: SparkSession, news: DataFrame, aliases: DataFrame, folder: str, config: RunConfig | None = None, client: extract.Client | None = None, gate: Callable[[], bool] | None = None) -> dict:
    """Extracts what is not yet in folder and returns totals. Every batches_per_commit batches of a month are a job that commits its answers to
    folder/results, so a run that dies loses at most those it was at, and the next run goes on behind the last commit; one after the end
    does nothing. raw, extractions, failures and edges are written anew only for the months that they lack answers of. A real run asks the client first whether it is
    ready, and does not begin otherwise. A dry run only counts."""
    config = config or RunConfig()
    if config.mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if gate is not None and not gate():
        raise RuntimeError("the gate is closed")
    if config.mode == "dry_run":
        return plan_counts(news, config).agg(F.count("*").alias("shards"), F.sum("rows").alias("rows"), F.sum("batches").alias("batches")).first().asDict()
    schema = extract.checked_schema(extract.answer_schema(config.event_types))
    if config.mode == "real":
        if client is None:
            raise ValueError("a real run needs a client")
        if not (facts := client.preflight(schema))["ready"]:
            raise RuntimeError(f"the client is not ready: {facts['error']}")
    results = f"{folder}/results"

    def answered(rows: DataFrame) -> DataFrame:
        rows = extract.with_prompt(rows, config.event_types)
        return extract.with_mock_answers(rows, config.mock_targets, config.mock_events, config.failing) if config.mode == "mock" else extract.with_answers(rows, client, schema)

    def extracted(rows: DataFrame) -> DataFrame:
        return extract.extraction(answered(rows), aliases, extract.ExtractConfig(config.mode, True, config.resolver)).drop("prompt", "row_number")

    plan = planned(news, config)
    todo = remaining(plan, tables.parquet_or_none(spark, results))
    unit = F.floor(F.col("batch_id") / config.batches_per_commit).cast("long")
    units = sorted(map(tuple, todo.groupBy("shard_id", unit.alias("unit")).count().select("shard_id", "unit").collect()))  # one row a commit
    for shard_id, k in units:
        extracted(todo.where((F.col("shard_id") == shard_id) & (unit == k))).write.mode("append").partitionBy("shard_id").parquet(results)
    stored = tables.typed(spark, results, extracted(plan).schema)
    raw = tables.typed(spark, f"{folder}/raw", T.StructType.fromDDL(extract.RAW)).groupBy("shard_id").agg(F.count("*").alias("written"))
    behind = stored.groupBy("shard_id").agg(F.count("*").alias("n")).join(raw, "shard_id", "left").where("written is null or written <> n").select("shard_id").collect()  # months
    changed = stored.where(F.col("shard_id").isin([r["shard_id"] for r in behind]))
    parts = extract.split(changed)
    # raw comes last, as it tells which months are done
    for name, frame in (("edges", resolve.edges(parts.parsed)), ("failures", parts.failures), ("extractions", parts.parsed), ("raw", parts.raw)):
        tables.overwrite_partitions(frame, f"{folder}/{name}", ["shard_id"])
    state = checkpoint(plan, stored, protocol.months(spark, config.start, config.end))
    state.coalesce(1).write.mode("overwrite").parquet(f"{folder}/checkpoint")
    return totals(spark.read.parquet(f"{folder}/checkpoint")).first().asDict()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the run's TABLES, in its columns; empty if no row was written."""
    return extract.shaped(tables.typed(spark, f"{folder}/{name}", T.StructType.fromDDL(TABLES[name])), TABLES[name])
