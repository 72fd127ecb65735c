"""Extracted target names resolved to companies, and event edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import text

from .joins import dimension


@dataclass(frozen=True)
class ResolverConfig:
    alias_min_length: int = 4
    allow_ticker: bool = True
    drop_self_loops: bool = True


def ticker_dimension(aliases: DataFrame) -> DataFrame:
    """One row for each upper-case ticker, its primary one first."""
    rows = aliases.withColumn("k", text.key("ticker")).where("k <> ''")
    best = rows.groupBy("k").agg(F.min(F.struct((~F.col("is_primary").cast("boolean")).alias("o"), "alias_type", "alias", "ticker", "price_ticker", "company_name")).alias("b"))
    return best.select("k", "b.ticker", "b.price_ticker", "b.company_name")


def alias_dimension(aliases: DataFrame, min_length: int) -> DataFrame:
    """For each normalised alias that is no ticker and long enough: how many companies have it, and the one if there is one."""
    rows = aliases.where((F.col("alias_type") != "ticker") & (F.char_length("alias_normalized") >= min_length))
    one = rows.groupBy("alias_normalized", "ticker").agg(F.max("price_ticker").alias("price_ticker"), F.max("company_name").alias("company_name"))
    return one.groupBy("alias_normalized").agg(F.count("*").alias("companies"), F.min(F.struct("ticker", "price_ticker", "company_name")).alias("c"))


def resolved(targets: DataFrame, aliases: DataFrame, config: ResolverConfig | None = None, column: str = "target") -> DataFrame:
    """Adds to each row of targets: input_target, normalized_target, status (resolved, ambiguous, unresolved, empty), is_resolved,
    resolved_ticker, resolved_price_ticker, resolved_company_name and match_type. A known ticker goes before an alias."""
    config = config or ResolverConfig()
    raw = text.strip(text.or_empty(column))
    rows = targets.withColumn("input_target", raw).withColumn("__norm", text.normalized_alias("input_target")).withColumn("__k", F.when(F.lit(config.allow_ticker) & (F.col("input_target") != ""), F.upper("input_target")))
    by_ticker = ticker_dimension(aliases).select(F.col("k").alias("__tk"), F.struct("ticker", "price_ticker", "company_name").alias("__t"))
    by_alias = alias_dimension(aliases, config.alias_min_length).select(F.col("alias_normalized").alias("__an"), "companies", F.col("c").alias("__a"))
    out = rows.join(dimension(by_ticker), F.col("__k") == F.col("__tk"), "left").join(dimension(by_alias), F.col("__norm") == F.col("__an"), "left")
    n = F.coalesce("companies", F.lit(0))
    empty, ticker = (F.col("input_target") == "") | ((F.col("__norm") == "") & F.col("__t").isNull()), F.col("__t").isNotNull()
    match = F.when(empty, "").when(ticker, "exact_ticker").when(n == 1, "exact_alias").when(n > 1, "ambiguous_alias").otherwise("no_match")
    status = F.when(empty, "empty").when(ticker | (n == 1), "resolved").when(n > 1, "ambiguous").otherwise("unresolved")
    found = F.when(ticker, F.col("__t")).when(n == 1, F.col("__a"))
    own = F.when(status == "resolved", found)
    out = out.withColumns({"normalized_target": F.when(empty, "").otherwise(F.col("__norm")), "status": status, "is_resolved": status == "resolved", "match_type": match, **{f"resolved_{c}": text.or_empty(own[c]) for c in ("ticker", "price_ticker", "company_name")}})
    return out.drop("__norm", "__k", "__tk", "__t", "__an", "companies", "__a")


#: What target_resolution_json tells of each target.
RESOLUTION = ("input_target", "normalized_target", "status", "is_resolved", "resolved_ticker", "resolved_price_ticker", "resolved_company_name", "match_type")


def resolved_lists(parsed: DataFrame, aliases: DataFrame, config: ResolverConfig | None = None) -> DataFrame:
    """Adds to parsed (with extracted_targets and source_ticker) the ordered lists resolved_target_tickers and unresolved_targets,
    self_loop_targets_dropped and target_resolution_json. Each row has its own targets, however often its id is there; null and empty lists give empty ones.

    Targets travel with their row, so the lists are put together by one aggregate and not by a join back."""
    config = config or ResolverConfig()
    names = parsed.columns
    rows = parsed.select(F.monotonically_increasing_id().alias("__row_id"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    each = rows.select("__row_id", "__row", F.posexplode_outer("__row.extracted_targets").alias("__pos", "target"))
    found = resolved(each, aliases, config).groupBy("__row_id").agg(F.first("__row").alias("__row"), F.array_sort(F.collect_list(F.when(F.col("__pos").isNotNull(), F.struct("__pos", *RESOLUTION)))).alias("__r"))
    tickers = F.array_distinct(F.transform(F.filter("__r", lambda x: x["status"] == "resolved"), lambda x: x["resolved_ticker"]))
    source = text.or_empty("__row.source_ticker")
    kept = F.filter(tickers, lambda t: t != source) if config.drop_self_loops else tickers
    missed = F.array_distinct(F.transform(F.filter("__r", lambda x: x["status"].isin("unresolved", "ambiguous")), lambda x: x["input_target"]))
    told = F.to_json(F.transform("__r", lambda x: F.struct(*[x[c].alias(c) for c in RESOLUTION])))
    return found.select("__row.*", kept.alias("resolved_target_tickers"), missed.alias("unresolved_targets"), (F.size(tickers) - F.size(kept)).cast("long").alias("self_loop_targets_dropped"), told.alias("target_resolution_json"))


#: Columns of event edges, in order (fixed values).
EDGES = "news_id string, published_date string, cutoff_date string, is_warmup boolean, in_evaluation_window boolean, source_ticker string, target_ticker string, event_type string, shard_id string, batch_id long, run_mode string"


def edges(parsed: DataFrame) -> DataFrame:
    """A directed edge from each row's company to each of its resolved targets, with the columns of EDGES; null and blank targets are none."""
    out = parsed.withColumn("target_ticker", F.explode("resolved_target_tickers")).where("target_ticker is not null and target_ticker <> ''").withColumn("event_type", F.col("extracted_event_type"))
    return out.select(*[F.col(name).cast(kind).alias(name) for name, kind in (c.split(" ") for c in EDGES.split(", "))])
