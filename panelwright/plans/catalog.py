"""The registered queries of the panel engine, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions import protocol, text
from panelwright.operators import aliases, evaluate, extract, graphs, guards, normalize, panel, resolve, sampling, shards

from .oracle import MOCKED, SQL
from .testdata import SPLITS, WINDOW, Tables

LEGACY = {"OLD1": "P1", " ": "P2"}
RUN = shards.RunConfig(start="1995-01-01", end="2001-12-31", seed=7, batch_size=16, mock_targets=("Supplier#000000001", "s2", "Supplier#000000003", "nobody"), failing=["n17", "n33", "n400"])


def _mapped(t: Tables) -> DataFrame:
    return aliases.finished(aliases.mapped_by_code(t.news(), t.universe(), LEGACY), t.universe(), "v1")


def _alias_table(t: Tables) -> DataFrame:
    return aliases.alias_table(t.universe())


def _listed(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as texts, for comparison."""
    return df.withColumns({c: F.array_join(c, "|") for c in columns})


def _extraction(t: Tables) -> DataFrame:
    day = F.col("published_date")
    rows = shards.planned(_mapped(t), RUN).withColumns({"is_warmup": protocol.is_warmup(day, WINDOW), "in_evaluation_window": protocol.in_evaluation(day, WINDOW)})
    return extract.extraction(extract.with_mock_answers(rows, RUN.mock_targets, RUN.mock_events, RUN.failing), _alias_table(t))


def _documents_as_news(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    return t.raw("documents").select(
        F.when(i % 3 == 0, F.concat(F.lit("http://x/"), (i % 50).cast("string"))).otherwise(F.when(i % 7 == 0, " ").otherwise("")).alias("url"),
        F.concat(F.lit("2016-01-0"), (i % 3 + 1).cast("string")).alias("published_date"), F.col("source").alias("ticker_raw"), F.substring("text", 1, 80).alias("title"),
        F.when(i % 4 == 0, " ").otherwise(F.col("text")).alias("body"), F.col("lang").alias("source_file"), F.when(F.col("lang") == "en", 2).otherwise(1).alias("source_priority"), i.alias("source_row_number"),
    )


def _scores(t: Tables) -> DataFrame:
    f, y = panel.features(t.prices(), t.index()), panel.forward_returns(t.prices())
    return f.where("feature_complete").join(y, ["as_of_date", "ticker"]).select(F.col("as_of_date").alias("date"), "ticker", F.col("ret_5").alias("score"), F.col(panel.LABEL).alias("label"))


def _daily_prices(t: Tables) -> DataFrame:
    p = normalize.prices(t.prices(), None, t.index(), WINDOW)
    return p.select("date", "ticker", "instrument_type", *[F.round(c, 8).alias(c) for c in ("open", "high", "low", "close", "volume")], "is_warmup", "in_evaluation_window")


def _rounded_features(t: Tables) -> DataFrame:
    return panel.features(t.prices(), t.index()).select("as_of_date", "ticker", *[F.round(c, 6).alias(c) for c in panel.REQUIRED], "feature_complete")


def _samples(t: Tables) -> DataFrame:
    return panel.sample_index(panel.features(t.prices(), t.index()), panel.forward_returns(t.prices()), _news_of_brands(t), t.splits(), WINDOW)


def _news_of_brands(t: Tables) -> DataFrame:
    """Orders as news of the brands that the price panel has."""
    n = F.col("o_orderkey")
    return t.raw("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_date"), F.concat(F.lit("Brand#"), (n % 25 + 1).cast("string")).alias("source_ticker"), (n % 4 != 0).alias("is_mapped"))


def _sample_index(t: Tables) -> DataFrame:
    s = _samples(t)
    return s.withColumn("label", F.round("label", 6)).select("split", "partition", "as_of_date", "ticker", "cutoff_date", "label_name", "label", "label_start_date", "label_end_date", "mapped_news_count_1d", "has_mapped_news")


def _leakage(t: Tables) -> DataFrame:
    rows = t.raw("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("as_of_date"), F.date_format(F.expr("date_add(o_orderdate, cast(o_orderkey % 3 as int) - 1)"), "yyyy-MM-dd").alias("label_start_date"), F.when(F.col("o_orderkey") % 50 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("label_end_date"))
    return guards.counts(rows, guards.label_rules("2000-12-31"))


def _targets(t: Tables) -> DataFrame:
    i = F.col("c_custkey")
    n = i.cast("string")
    kind = i % 8
    value = F.when(kind == 0, F.concat(F.lit(" s"), (i % 140).cast("string"))).when(kind == 1, F.concat(F.lit("Supplier#"), F.lpad((i % 120).cast("string"), 9, "0"))).when(kind == 2, F.concat(F.lit("SUPPLIER "), F.lpad((i % 120).cast("string"), 9, "0"), F.lit(" corp"))).when(kind == 3, "red widget").when(kind == 4, F.concat(F.lit("nobody "), n)).when(kind == 5, " ").when(kind == 6, "--")
    return t.raw("customer").select("c_custkey", value.alias("target"))


def _contains(t: Tables) -> DataFrame:
    a = t.raw("benchmark").select(F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("ticker"), F.col("text").alias("alias"), text.normalized_alias("text").alias("alias_normalized"), F.lit("company_name").alias("alias_type"), F.lit(True).alias("is_primary"))
    news = t.raw("documents").select("doc_id", F.col("text").alias("title"), F.lit("").alias("body"), F.when(F.col("doc_id") % 10 == 0, "P1").alias("source_ticker"), F.when(F.col("doc_id") % 10 == 0, "ticker_raw").alias("mapping_method"))
    return aliases.mapped_by_text(news, a, aliases.MappingConfig()).select("doc_id", "source_ticker", "mapping_method")


def _limited_scan(t: Tables) -> DataFrame:
    """News mapped as map_news does, but of each file only the first 40 rows without a code have their text looked at."""
    config = aliases.MappingConfig(legacy=LEGACY, scan_limit=40, scan_by=["source_file"])
    return aliases.map_news(t.news(), t.universe(), _alias_table(t), config).select("news_id", "source_ticker", "mapping_method")


def _map_news(t: Tables) -> DataFrame:
    out = aliases.map_news(t.news(), t.universe(), _alias_table(t), aliases.MappingConfig(legacy=LEGACY))
    return out.select("news_id", "source_ticker", "mapping_method", "source_price_ticker", "source_company_name", "mapping_confidence", "is_mapped")


def _feasibility(t: Tables, targets: tuple[str, ...]) -> DataFrame:
    m = _mapped(t)
    sample = sampling.bottom_k(sampling.eligible(m, "1996-01-01", "1996-12-31"), 100, 7)
    rows = extract.with_mock_answers(sampling.head_with_seeds(sample, 100, 7), targets, RUN.mock_events)
    d = extract.with_decoded(rows, repair=False).select("news_id", "published_date", F.col("decoded.source").alias("source"), F.col("decoded.targets").alias("targets"))
    n = F.size("targets")
    counted = sampling.candidate_counts(m, ("1995-01-01", "1995-12-31"), ("1996-01-01", "1996-12-31"))
    return sampling.feasibility(d.withColumns({"is_valid_source": F.col("source").isNotNull(), "has_valid_targets": n > 0, "valid_target_count": n}), counted)


def _feasibilities(t: Tables) -> DataFrame:
    """Of mock answers that pass the gate, and of some that do not."""
    good, bad = (_feasibility(t, targets) for targets in MOCKED)
    return good.unionByName(bad)


def _raw_news(t: Tables) -> DataFrame:
    """Orders as rows of a raw news file, some with junk for a date."""
    n = F.col("o_orderkey")
    made = {
        "Date": F.when(n % 13 == 0, "junk").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 10:00:00 UTC"))),
        "Article_title": F.concat(F.lit("T "), F.col("o_orderpriority")),
        "Article": F.when(n % 5 == 0, " ").otherwise("body"),
        "Lsa_summary": F.when(n % 7 == 0, "sum"),
    }
    return t.raw("orders").select(n.alias("line"), *[made.get(c, F.lit(None)).cast("string").alias(c) for c in normalize.RAW_COLUMNS])


def _standardized(t: Tables) -> DataFrame:
    out = normalize.standardized(_raw_news(t), "a.csv", 2, WINDOW, "line")
    return out.select("source_row_number", "published_date", "title", "has_content", "is_warmup", "in_evaluation_window", "source_file", "source_priority", "version")


def _listed_members(t: Tables) -> DataFrame:
    i = F.col("p_partkey")
    added = F.when(i % 9 == 0, F.lit(None)).when(i % 7 == 0, "no date").otherwise(F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (i * 17 % 4000).cast("int")), "yyyy-MM-dd"))
    return normalize.listed_by(t.raw("part").select(i.alias("member"), added.alias("date_added")), "1998-06-30").select("member")


def _order_days(t: Tables) -> DataFrame:
    return t.raw("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.lit("1994-01-01").alias("from_day"))


def _without_summaries(news: DataFrame) -> DataFrame:
    return news.withColumns({c: F.lit(None).cast("string") for c in text.SUMMARIES})


def _messages(t: Tables) -> DataFrame:
    parts = F.split(F.element_at("prompt", 2)["content"], "\nEvent types: [^\n]*\n\n", 2)
    return extract.with_prompt(_without_summaries(_mapped(t))).select("news_id", F.array_join("prompt.role", "|").alias("roles"), F.element_at(parts, 1).alias("begins"), F.element_at(parts, 2).alias("ends"))


def _empty_answers(t: Tables) -> DataFrame:
    rows = extract.with_prompt(_without_summaries(shards.planned(_mapped(t), RUN)))
    answered = extract.with_answers(rows, extract.EmptyClient(), extract.answer_schema())
    return extract.extraction(answered, _alias_table(t)).select("news_id", "status", "extracted_source", "has_valid_targets", "request_mode", "raw_content_sha256")


def _ordered_names(t: Tables) -> DataFrame:
    i = F.col("o_custkey")
    b, a = (F.concat(F.lit(x), (i % n).cast("string")) for x, n in (("b", 3), ("a", 2)))
    values = F.array(F.concat(F.lit(" "), b), F.when(i % 2 == 1, a), F.lit(" "), b, F.concat(F.when(i % 2 == 1, a).otherwise(b), F.lit(" ")))
    return t.raw("orders").select(i).distinct().select("o_custkey", F.array_join(text.distinct_texts(values), "|").alias("names"))


def _lineage(t: Tables) -> DataFrame:
    up = t.news()
    sample = sampling.bottom_k(up, 200, 7).withColumn("title", F.when(F.substring("news_id", -1, 1) == "3", "other").otherwise(F.col("title"))).withColumn("news_id", F.when(F.substring("news_id", -2, 2) == "17", F.concat("news_id", F.lit("x"))).otherwise(F.col("news_id")))
    return sampling.lineage(sample, up)


def _self_loops(t: Tables) -> DataFrame:
    rows = shards.planned(_mapped(t), RUN).select("news_id", "source_ticker", F.when(F.col("row_number") % 2 == 0, F.array(F.lower("source_ticker"), F.lit("Supplier#000000001"), F.lit("P5"))).otherwise(F.array(F.lit("p5"))).alias("extracted_targets"))
    return _listed(resolve.resolved_lists(rows, _alias_table(t)), "resolved_target_tickers").select("news_id", "resolved_target_tickers", F.col("self_loop_targets_dropped").alias("self_loops_dropped"))


def _checkpoint(t: Tables) -> DataFrame:
    rows = shards.planned(_mapped(t), RUN)
    results = _extraction(t).where("shard_id <> '1996-03' and not (shard_id = '1996-01' and batch_id > 1)")
    return shards.checkpoint(rows, results, protocol.months(t.spark, RUN.start, RUN.end)).drop("started_at", "finished_at")


def _resume(t: Tables) -> DataFrame:
    rows = shards.planned(_mapped(t), RUN)
    return shards.remaining(rows, rows.where("batch_id % 2 = 0").select("shard_id", "batch_id")).select("news_id", "shard_id", "batch_id")


def _event_edges(t: Tables) -> DataFrame:
    i = F.col("event_id")
    return t.raw("events").select(F.date_format("ts", "yyyy-MM-dd").alias("published_date"), F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string")).alias("source_ticker"), F.concat(F.lit("U"), ((F.col("user_id") * 7 + i) % 40).cast("string")).alias("target_ticker"))


def _event_days(t: Tables) -> DataFrame:
    return t.raw("events").select(F.date_format("ts", "yyyy-MM-dd").alias("date")).distinct().where("substring(date, 9, 2) not in ('06', '07', '13', '14')")


def _returns(t: Tables) -> DataFrame:
    return panel.features(t.prices(), t.index()).select("as_of_date", "ticker", "ret_1")


def _json(t: Tables) -> DataFrame:
    """Answers of many forms, made of event numbers."""
    n = F.col("event_id").cast("string")
    body = F.concat(F.lit('{"source": " '), F.col("event_type"), F.lit('", "targets": ["A'), n, F.lit('", "", "B", "A'), n, F.lit('"], "event_type": ""}'))
    kind = F.col("event_id") % 6
    answer = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here it is: "), body, F.lit(" as asked."))).when(kind == 3, "no object").when(kind == 4, '{"source": "x", "extra": 1}').otherwise("[1]")
    d = extract.with_decoded(t.raw("events").select("event_id", answer.alias("raw_content")))
    return d.select("event_id", F.col("decoded.source").alias("source"), F.array_join("decoded.targets", "|").alias("targets"), F.col("decoded.event_type").alias("event_type"), F.col("decoded.error_type").alias("error_type"))


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    "alias_table": _alias_table,
    "alias_metadata": lambda t: aliases.alias_metadata(_alias_table(t)),
    "text_normalize": lambda t: t.raw("documents").select("doc_id", text.normalized_alias("text").alias("normalized"), text.digest("text").alias("digest")),
    "suffix_strip": lambda t: t.universe().select("ticker", text.without_suffixes("company_name", aliases.SUFFIXES).alias("bare"), text.without_punctuation("company_name").alias("plain")),
    "source_map_tiers": lambda t: _mapped(t).select("news_id", "source_ticker", "mapping_method", "mapping_confidence", "source_company_name", "is_mapped"),
    "source_map_alias_contains": _contains,
    "map_news": _map_news,
    "mapping_stats": lambda t: aliases.mapping_stats(_mapped(t)),
    "resolve_targets": lambda t: resolve.resolved(_targets(t), _alias_table(t)).select("c_custkey", "input_target", "normalized_target", "status", "is_resolved", "resolved_ticker", "resolved_company_name", "match_type"),
    "dedupe_documents": lambda t: normalize.collapsed(_documents_as_news(t)).select("news_id", F.col("source_row_number").alias("doc_id")),
    "dedupe_pages_url_key": lambda t: normalize.first_of(t.raw("pages").select("page_id", F.regexp_extract("url", "^[^?]*", 0).alias("key"), F.char_length("html").alias("n")), ["key"], [F.col("n").desc(), F.col("page_id")]).select("page_id", "key"),
    "protocol_flags": lambda t: t.raw("orders").select("o_orderkey", protocol.is_warmup("o_orderdate", WINDOW).alias("is_warmup"), protocol.in_evaluation("o_orderdate", WINDOW).alias("in_evaluation_window"), protocol.in_protocol("o_orderdate", WINDOW).alias("in_protocol")),
    "month_calendar": lambda t: protocol.months(t.spark, "1995-11-15", "1996-03-20"),
    "daily_prices": _daily_prices,
    "universe_daily": lambda t: normalize.universe_daily(t.prices(), t.prices().select("ticker"), WINDOW).select("date", "ticker", "has_price_data", "is_warmup", "in_evaluation_window"),
    "market_return": lambda t: panel.market_returns(t.index()).select("date", F.round("feat_mkt_ret_1d", 6).alias("feat_mkt_ret_1d")),
    "feature_panel": _rounded_features,
    "forward_returns": lambda t: panel.forward_returns(t.prices()).withColumn(panel.LABEL, F.round(panel.LABEL, 6)),
    "news_counts_daily": lambda t: panel.news_counts(_news_of_brands(t)),
    "sample_index": _sample_index,
    "split_counts": lambda t: panel.split_counts(_samples(t)),
    "leakage_violations": _leakage,
    "sample_bottom_k": lambda t: sampling.bottom_k(sampling.eligible(_mapped(t), "1996-01-01", "1996-12-31"), 100, 7).select("news_id", "published_date"),
    "monthly_histogram": lambda t: sampling.monthly_histogram(_mapped(t), "1995-01-01", "1996-12-31"),
    "warmup_official_counts": lambda t: sampling.candidate_counts(_mapped(t), ("1995-01-01", "1995-12-31"), ("1996-01-01", "1996-12-31")),
    "feasibility_metrics": _feasibilities,
    "stage_gate": lambda t: sampling.gate(_feasibilities(t)).select("source_mapping_ratio", "valid_target_ratio", "can_enter"),
    "lineage_check": _lineage,
    "coverage_ratios": lambda t: sampling.coverage(_mapped(t)),
    "yearly_counts": lambda t: sampling.yearly(_mapped(t)),
    "news_share": lambda t: sampling.news_share(_samples(t)),
    "news_count_distribution": lambda t: sampling.count_distribution(_samples(t)),
    "prompt_text": lambda t: t.news().withColumns({c: F.when(F.col("news_id").endswith("5"), c) for c in text.SUMMARIES}).select("news_id", text.article().alias("article")),
    "json_decode": _json,
    "shard_batches": lambda t: shards.planned(_mapped(t), RUN).select("news_id", "shard_id", "row_number", "batch_id", "row_seed"),
    "shard_plan": lambda t: shards.plan_counts(_mapped(t), RUN),
    "mock_extract": lambda t: _listed(_extraction(t), "extracted_targets", "resolved_target_tickers", "unresolved_targets").select("news_id", "status", "extracted_source", "extracted_targets", F.col("extracted_event_type").alias("event_type"), "resolved_target_tickers", "unresolved_targets", "seed", "request_mode", "raw_content_sha256", "response_repaired", "resolved_target_count", "has_resolved_targets", "self_loop_targets_dropped"),
    "mock_failures": lambda t: extract.split(_extraction(t)).failures,
    "edges": lambda t: resolve.edges(extract.split(_extraction(t)).parsed),
    "self_loop_drop": _self_loops,
    "checkpoint_shards": _checkpoint,
    "checkpoint_totals": lambda t: shards.totals(_checkpoint(t)),
    "resume_anti_join": _resume,
    "semantic_graph_topk": lambda t: graphs.semantic(_event_edges(t), _event_days(t), span=10, k=5),
    "semantic_graph_decayed": lambda t: graphs.semantic(_event_edges(t), _event_days(t), span=10, k=3, decay=0.1),
    "static_graph": lambda t: graphs.static_semantic(t.raw("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_date"), (F.col("o_custkey") % 30).cast("string").alias("source_ticker"), F.col("o_orderpriority").alias("target_ticker")), t.splits()),
    "graph_stats": lambda t: graphs.stats(graphs.semantic(_event_edges(t), _event_days(t), span=10, k=5)),
    "price_graph_topk": lambda t: graphs.price(_returns(t)),
    "snapshot_asof": lambda t: graphs.as_of(t.prices().select(F.col("date").alias("as_of_date")).distinct(), graphs.snapshots(t.prices())),
    "rank_ic": lambda t: evaluate.information(_scores(t)),
    "rank_ic_summary": lambda t: evaluate.information_summary(evaluate.information(_scores(t)).withColumn("year", F.substring("date", 1, 4)), ["year"]),
    "topk_portfolio": lambda t: evaluate.portfolio(_scores(t), 5),
    "news_standardized": _standardized,
    "universe_listed": _listed_members,
    "guard_bounds": lambda t: guards.counts(_order_days(t), [guards.not_after("day", "1998-01-01", allow_equal=False), guards.not_before("day", "1993-06-01"), guards.relation("day", "from_day", ">=")]),
    "cutoff_filter": lambda t: guards.up_to(_order_days(t), "day", "1996-06-30").select("o_orderkey", (F.col("day") < "1996-06-30").alias("before_the_day")),
    "guard_features": lambda t: guards.counts(panel.features(t.prices(), t.index()), guards.feature_rules("1999-12-31")),
    "guard_samples": lambda t: guards.counts(_samples(t), guards.sample_rules("2000-06-30", "1997-01-01")),
    "feature_window_ends": lambda t: panel.features(t.prices(), t.index()).select("as_of_date", "ticker", "feature_window_end_date"),
    "sample_seeds": lambda t: sampling.head_with_seeds(sampling.eligible(_mapped(t), "1996-01-01", "1996-12-31"), 50, 7, 1000).select("news_id", "row_seed"),
    "prompt_messages": _messages,
    "empty_answers": _empty_answers,
    "ordered_names": _ordered_names,
    "rank_ic_decay": lambda t: evaluate.decay(_scores(t).drop("label"), t.prices()),
    "gap_fill": lambda t: sampling.gap_fill(t.news(), "F", "O"),
    "news_gaps": lambda t: normalize.gaps_of(normalize.standardized(_raw_news(t), "a.csv", 2, WINDOW, "line")),
    "alias_scan_limit": _limited_scan,
    "portfolio_performance": lambda t: evaluate.performance(evaluate.portfolio(_scores(t), 5)),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["QUERIES", "SPLITS", "oracle_sql", "queries"]
