"""Whole jobs over paths, also from the command line: python -m panelwright.plans.jobs JOB --help."""

from __future__ import annotations

import argparse
import os
import shutil
import subprocess
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions import protocol
from panelwright.operators import aliases, extract, normalize, panel, sampling, shards
from panelwright.session import local_session
from panelwright.sources import tables

from . import reports


def build_aliases(spark: SparkSession, universe_csv: str, out: str, suffixes: list[str] | None = None, force: bool = False) -> dict:
    """Writes the alias table of a universe CSV; leaves one that is there alone unless forced."""
    if tables.exists(spark, out) and not force:
        return {"skipped": True} | aliases.alias_metadata(spark.read.parquet(out)).first().asDict()
    tables.write(aliases.alias_table(tables.strings(spark, universe_csv), suffixes), out, overwrite=True)
    return {"skipped": False} | aliases.alias_metadata(spark.read.parquet(out)).first().asDict()


def map_news(spark: SparkSession, news: str, universe_csv: str, alias_path: str, out: str, config: aliases.MappingConfig | None = None, overwrite: bool = False) -> dict:
    mapped = aliases.map_news(spark.read.parquet(news), tables.strings(spark, universe_csv), spark.read.parquet(alias_path), config)
    tables.write(mapped, out, overwrite)
    return {"rows_read": spark.read.parquet(news).count()} | aliases.mapping_stats(spark.read.parquet(out)).first().asDict()


def ingest(spark: SparkSession, sources: list[tuple[str, str, int]], out: str, window: protocol.Window | None = None, rows_per_file: int | None = None, overwrite: bool = False) -> dict:
    """Writes the news of raw CSV files, given as (path, name, priority), under common names, one row of each key. Each path is one file: fields
    may hold line breaks, so a file is one task's, which numbers its rows in order. Columns the engine has no name for are left out."""
    window = window or protocol.Window()
    parts = []
    for path, name, priority in sources:
        numbered = tables.strings(spark, path, missing=False).withColumn("__row", F.monotonically_increasing_id())
        if len(numbered.inputFiles()) != 1:
            raise ValueError(f"{path} must be one file")
        numbered = numbered.where(F.col("__row") < rows_per_file) if rows_per_file is not None else numbered
        absent = {c: F.lit(None).cast("string") for c in normalize.RAW_COLUMNS if c not in numbered.columns}
        parts.append(normalize.standardized(numbered.withColumns(absent), name, priority, window, "__row"))
    tables.write(normalize.news(parts), out, overwrite)
    kept = {r["source_file"]: r["n"] for r in spark.read.parquet(out).groupBy("source_file").agg(F.count("*").alias("n")).collect()}
    read = {name: p.count() for (_, name, _), p in zip(sources, parts, strict=True)}
    return {"rows_in_period": sum(read.values()), "rows_written": sum(kept.values()), "duplicates_removed": sum(read.values()) - sum(kept.values()), "by_file": {n: {"in_period": read[n], "written": kept.get(n, 0)} for n in read}}


def _made(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path, made first if it is missing."""
    if not tables.exists(spark, path):
        tables.write(make(), path)
    return spark.read.parquet(path)


def build_sample_index(spark: SparkSession, prices: str, index: str, features: str, labels: str, news: str | None, out: str, window: protocol.Window | None = None, tickers: str | None = None, splits: str | None = None, cutoff: str | None = None, overwrite: bool = False) -> dict:
    """Writes the walk-forward samples; features and labels are made of prices where they are missing. A missing news table counts as none."""
    window = window or protocol.Window()
    daily, market = (lambda: spark.read.parquet(prices)), (lambda: spark.read.parquet(index))
    f = _made(spark, features, lambda: panel.features(daily(), market()))
    y = _made(spark, labels, lambda: panel.forward_returns(daily()))
    n = spark.read.parquet(news) if news and tables.exists(spark, news) else None
    parts = protocol.splits_frame(spark, protocol.walk_forward(window), protocol.names(splits))
    samples = panel.sample_index(f, y, n, parts, window, cutoff, protocol.names(tickers))
    # ranges, not hashes, of the sort key: a split and part may span many files, each sorted
    order = ["split", "partition", "as_of_date", "ticker"]
    tables.write(samples.repartitionByRange(*order).sortWithinPartitions(*order), out, overwrite)
    counts = panel.split_counts(spark.read.parquet(out)).collect()
    return {"rows": sum(r["n"] for r in counts), "splits": {f"{r['split']}/{r['partition']}": r["n"] for r in counts}}


def feasibility(spark: SparkSession, news: str, folder: str, mode: str = "mock", seed: int = 7, sample_size: int = 100, official: tuple[str, str] = ("2016-01-01", "2016-12-31"), warmup: tuple[str, str] = ("2015-09-01", "2015-12-31"), client: extract.Client | None = None, upstream: str | None = None) -> dict:
    """Draws the official sample, extracts it, and writes sample, results and report."""
    if mode not in ("mock", "formal"):
        raise ValueError("mode must be mock or formal")
    rows = spark.read.parquet(news)
    tables.write(sampling.bottom_k(sampling.eligible(rows, *official), sample_size, seed), f"{folder}/sample", overwrite=True)
    sample = spark.read.parquet(f"{folder}/sample")
    seeded = extract.with_prompt(sampling.head_with_seeds(sample, sample_size, seed))
    schema = extract.checked_schema(extract.answer_schema())
    answered = extract.with_answers(seeded, client, schema) if client else extract.with_mock_answers(seeded)
    decoded = extract.with_decoded(answered, repair=False).selectExpr("news_id", "published_date", "decoded.source as source", "coalesce(decoded.targets, array()) as targets", "coalesce(client_error, decoded.error_type) as error_type")
    results = decoded.selectExpr("*", "source is not null as is_valid_source", "size(targets) > 0 as has_valid_targets", "size(targets) as valid_target_count")
    tables.write(results, f"{folder}/results", overwrite=True)
    results = spark.read.parquet(f"{folder}/results")
    counts = sampling.candidate_counts(rows, warmup, official).first().asDict()
    metrics = sampling.feasibility(results, counts["official_candidates"]).first().asDict()
    metrics["parse_ratio"] = round(results.where("error_type is null").count() / max(1, metrics["processed_rows"]), 6)
    lineage = sampling.lineage(sample, spark.read.parquet(upstream)).first().asDict() if upstream else {}
    months = {r["month"]: r["n"] for r in sampling.monthly_histogram(rows, *official).collect()}
    report = reports.feasibility_report(mode, seed, counts, months, metrics, lineage, [tables.manifest(spark, p) for p in (news, upstream) if p], complete=mode == "formal" and metrics["processed_rows"] > 0)
    _report(folder, "feasibility", report)
    return report


def full_extract(spark: SparkSession, news: str, alias_path: str, folder: str, config: shards.RunConfig | None = None, client: extract.Client | None = None, report: str | None = None) -> dict:
    """A run in shards; with a feasibility report, only if its gate is open."""
    config = config or shards.RunConfig()
    gate = (lambda: bool(tables.config(report).get("stage_gate", {}).get("can_enter"))) if report else None
    totals = shards.run(spark, spark.read.parquet(news), spark.read.parquet(alias_path), folder, config, client, gate)
    if config.mode != "dry_run":
        state = [r.asDict() for r in spark.read.parquet(f"{folder}/checkpoint").orderBy("shard_id").collect()]
        _report(folder, "summary", reports.run_summary(config.mode, totals, state, [tables.manifest(spark, f"{folder}/{x}") for x in ("raw", "extractions", "failures", "edges")]))
    return totals


def small(config: shards.RunConfig) -> shards.RunConfig:
    """One shard, one batch, eight rows."""
    return replace(config, max_shards=1, batches_per_shard=1, rows_per_shard=8)


def recompute_gate(path: str, out: str | None = None) -> dict:
    report = reports.with_gate(tables.config(path))
    tables.write_json(out or path, report)
    return report


def rewrite_report(spark: SparkSession, path: str, sample: str, upstream: str, out: str | None = None) -> dict:
    """A feasibility report with gate and lineage computed anew from the tables, written with its Markdown over the old one or to `out`."""
    lineage = sampling.lineage(spark.read.parquet(sample), spark.read.parquet(upstream)).first().asDict()
    report = reports.with_gate(tables.config(path)) | {"lineage": lineage, "created": reports.now()}
    target = Path(out or path)
    tables.write_json(str(target), report)
    target.with_suffix(".md").write_text(reports.markdown("feasibility", report), encoding="utf-8")
    return report


def preflight(client: extract.HttpClient | None) -> dict:
    """What the driver can tell of its surroundings: accelerators, and the server."""
    gpu = shutil.which("nvidia-smi")
    names = subprocess.run([gpu, "--query-gpu=name", "--format=csv,noheader"], capture_output=True, text=True, timeout=30, check=False).stdout.split("\n") if gpu else []
    return {"gpus": [n for n in names if n.strip()], "server": client.preflight() if client else None}


def _report(folder: str, name: str, report: dict) -> None:
    """Beside the tables if the folder is local; elsewhere the caller keeps what it gets back."""
    local = folder.removeprefix("file://")
    if "://" not in local:
        tables.write_json(f"{local}/{name}.json", report)
        Path(f"{local}/{name}.md").write_text(reports.markdown(name, report), encoding="utf-8")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="panelwright")
    jobs = p.add_subparsers(dest="job", required=True)
    a = jobs.add_parser("aliases")
    a.add_argument("universe_csv")
    a.add_argument("out")
    a.add_argument("--force", action="store_true")
    m = jobs.add_parser("map-news")
    for x in ("news", "universe_csv", "alias_path", "out"):
        m.add_argument(x)
    m.add_argument("--overwrite", action="store_true")
    s = jobs.add_parser("sample-index")
    for x in ("prices", "index", "features", "labels", "out"):
        s.add_argument(x)
    for x in ("--news", "--tickers", "--splits", "--cutoff"):
        s.add_argument(x)
    s.add_argument("--overwrite", action="store_true")
    f = jobs.add_parser("feasibility")
    f.add_argument("news")
    f.add_argument("folder")
    f.add_argument("--mode", default="mock")
    f.add_argument("--seed", type=int, default=-1)
    f.add_argument("--upstream")
    e = jobs.add_parser("extract")
    for x in ("news", "alias_path", "folder"):
        e.add_argument(x)
    e.add_argument("--mode", default="mock", choices=shards.MODES)
    e.add_argument("--seed", type=int, default=-1)
    e.add_argument("--small", action="store_true")
    e.add_argument("--max-shards", type=int)
    e.add_argument("--max-batches-per-shard", type=int)
    e.add_argument("--report")
    g = jobs.add_parser("gate")
    g.add_argument("path")
    g.add_argument("--out")
    n = jobs.add_parser("ingest")
    n.add_argument("out")
    n.add_argument("--source", nargs=3, action="append", required=True, metavar=("PATH", "NAME", "PRIORITY"))
    n.add_argument("--rows-per-file", type=int)
    n.add_argument("--overwrite", action="store_true")
    r = jobs.add_parser("rewrite-report")
    for x in ("path", "sample", "upstream"):
        r.add_argument(x)
    r.add_argument("--out")
    o = vars(p.parse_args(args))
    job = o.pop("job")
    if job == "gate":
        print(recompute_gate(**o)["stage_gate"])
        return
    spark = local_session(os.environ.get("CPUS", "*"))
    seed = o.pop("seed", -1)
    if job == "extract":
        base = shards.RunConfig(mode=o.pop("mode"), max_shards=o.pop("max_shards"), batches_per_shard=o.pop("max_batches_per_shard"))
        base = base if seed < 0 else replace(base, seed=seed)
        print(full_extract(spark, config=small(base) if o.pop("small") else base, **o))
    elif job == "ingest":
        print(ingest(spark, [(path, name, int(priority)) for path, name, priority in o.pop("source")], **o))
    elif job == "rewrite-report":
        print(rewrite_report(spark, **o)["stage_gate"])
    elif job == "feasibility":
        print(feasibility(spark, **o, **({} if seed < 0 else {"seed": seed})))
    else:
        print({"aliases": build_aliases, "map-news": map_news, "sample-index": build_sample_index}[job](spark, **o))


if __name__ == "__main__":
    main()
