"""Samples of eligible news, feasibility metrics, the gate, and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import protocol, text

#: Least values for the gate (fixed values).
GATE = {"source_mapping_ratio": 0.80, "valid_target_ratio": 0.25, "monthly_avg_out_degree": 1.0}


def eligible(news: DataFrame, start: str, end: str) -> DataFrame:
    return news.where(protocol.true("is_mapped") & F.col("published_date").between(start, end))


def candidate_counts(news: DataFrame, warmup: tuple[str, str], official: tuple[str, str]) -> DataFrame:
    ok = protocol.true("is_mapped")
    n = lambda p: F.count_if(ok & F.col("published_date").between(*p))
    return news.agg(n(warmup).alias("warmup_candidates"), n(official).alias("official_candidates"))


def monthly_histogram(news: DataFrame, start: str, end: str) -> DataFrame:
    return eligible(news, start, end).groupBy(text.month("published_date").alias("month")).agg(F.count("*").alias("n"))


def bottom_k(news: DataFrame, k: int, seed: int, id_col: str = "news_id") -> DataFrame:
    """The k rows whose seeded id hashes least: a uniform sample that does not depend on the order or partitioning of rows. Tasks keep k
    rows each. k may be at or over the number of rows."""
    return news.withColumn("__h", text.digest(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))).orderBy("__h", id_col).limit(k).drop("__h").orderBy("published_date", id_col)


def head_with_seeds(sample: DataFrame, k: int, seed: int, offset: int = 0, id_col: str = "news_id") -> DataFrame:
    """The first k rows by date and id, each with a seed of its own."""
    head = sample.orderBy("published_date", id_col).limit(k)
    return head.withColumn("row_seed", (F.row_number().over(Window.orderBy("published_date", id_col)) - 1 + seed + offset).cast("long"))


def feasibility(results: DataFrame, official_candidates: int | DataFrame, months: int = 12) -> DataFrame:
    """One row of metrics of extraction results (news_id, published_date, source, targets, is_valid_source, has_valid_targets,
    valid_target_count). Zeros and 'insufficient' if there are none."""
    one = results.agg(
        F.count("*").alias("processed_rows"),
        F.coalesce(F.avg(F.col("is_valid_source").cast("int")), F.lit(0.0)).alias("source_mapping_ratio"),
        F.coalesce(F.avg(F.col("has_valid_targets").cast("int")), F.lit(0.0)).alias("valid_target_ratio"),
        F.coalesce(F.avg("valid_target_count"), F.lit(0.0)).alias("avg_valid_target_count"),
        F.count_distinct(F.when(F.col("has_valid_targets") & F.col("is_valid_source"), F.col("source"))).alias("active_source_nodes"),
        F.when(F.coalesce(F.bool_or(F.col("has_valid_targets")), F.lit(False)), "sufficient").otherwise("insufficient").alias("coverage_conclusion"),
    )
    out_degree = results.where("is_valid_source").select(text.month("published_date").alias("m"), "source", F.explode("targets").alias("t")).groupBy("m", "source").agg(F.count_distinct("t").alias("d")).agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("monthly_avg_out_degree"))
    candidates = official_candidates if isinstance(official_candidates, DataFrame) else results.sparkSession.range(1).select(F.lit(official_candidates).alias("official_candidates"))
    density = candidates.select((F.col("official_candidates") / months).alias("news_density"))
    # three tables of one row each
    row = one.join(out_degree).join(density)
    ratios = ["source_mapping_ratio", "valid_target_ratio", "avg_valid_target_count", "monthly_avg_out_degree", "news_density"]
    return row.select("processed_rows", *[F.round(c, 6).alias(c) for c in ratios], "active_source_nodes", "coverage_conclusion")


def gate(metrics: DataFrame) -> DataFrame:
    """Adds can_enter: all thresholds reached and coverage sufficient; a missing metric closes the gate."""
    ok = F.lower(text.strip(text.or_empty("coverage_conclusion"))) == "sufficient"
    for c, least in GATE.items():
        ok = ok & F.coalesce(F.col(c).try_cast("double") >= least, F.lit(False))
    return metrics.withColumn("can_enter", ok)


def lineage(sample: DataFrame, upstream: DataFrame) -> DataFrame:
    """How far the sample's rows are found upstream: ratios of equal ids, dates and titles, and the number of source files."""
    up = upstream.select(F.col("news_id").alias("u_id"), F.col("published_date").alias("u_date"), F.col("title").alias("u_title"), "source_file").dropDuplicates(["u_id"])
    rows = sample.select("news_id", "published_date", "title").join(up, F.col("news_id") == F.col("u_id"), "left")
    ratio = lambda ok: F.coalesce(F.round(F.avg(F.coalesce(ok, F.lit(False)).cast("int")), 6), F.lit(0.0))
    hit = F.col("u_id").isNotNull()
    return rows.agg(F.count("*").alias("sample_rows"), ratio(hit).alias("match_ratio"), ratio(hit & F.col("published_date").eqNullSafe(F.col("u_date"))).alias("date_match_ratio"), ratio(hit & F.col("title").eqNullSafe(F.col("u_title"))).alias("title_match_ratio"), F.count_distinct("source_file").alias("source_files"))


def coverage(news: DataFrame, by: str = "source_file") -> DataFrame:
    """Rows, mapped rows and shares of codes and bodies by source."""
    share = lambda c: F.round(F.avg((text.strip(text.or_empty(c)) != "").cast("int")), 6)
    return news.groupBy(by).agg(F.count("*").alias("n"), F.count_if(protocol.true("is_mapped")).alias("mapped"), F.round(F.avg(protocol.true("is_mapped").cast("int")), 6).alias("mapped_ratio"), share("ticker_raw").alias("ticker_ratio"), share("body").alias("body_ratio"))


def yearly(news: DataFrame) -> DataFrame:
    """Rows and mapped rows of each year and source."""
    return news.groupBy(F.substring("published_date", 1, 4).alias("year"), "source_file").agg(F.count("*").alias("n"), F.count_if(protocol.true("is_mapped")).alias("mapped"))


def gap_fill(news: DataFrame, base: str, filler: str) -> DataFrame:
    """For each year, the rows of source `base`, those of `filler`, and how many of the latter are later than all of base: the gap they fill.
    Without any row of base all of filler fills it. Rows without a date are in no year."""
    ends = news.where(F.col("source_file") == base).agg(F.max("published_date").alias("ends"))
    rows = news.where(F.col("source_file").isin(base, filler) & F.col("published_date").isNotNull()).join(F.broadcast(ends))  # one row
    mine, other = F.col("source_file") == base, F.col("source_file") == filler
    late = other & F.coalesce(F.col("published_date") > F.col("ends"), F.lit(True))
    return rows.groupBy(F.substring("published_date", 1, 4).alias("year")).agg(F.count_if(mine).alias("base_rows"), F.count_if(other).alias("filler_rows"), F.count_if(late).alias("filled"))


def news_share(samples: DataFrame) -> DataFrame:
    """How many samples of each split have news, and how much."""
    return samples.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg(F.col("has_mapped_news").cast("int")), 6).alias("news_ratio"), F.sum("mapped_news_count_1d").alias("news"), F.max("mapped_news_count_1d").alias("most"))


def count_distribution(samples: DataFrame) -> DataFrame:
    """Samples by their number of news."""
    return samples.groupBy("mapped_news_count_1d").agg(F.count("*").alias("n"))
