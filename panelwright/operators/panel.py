"""Features and forward labels of a daily price panel, and walk-forward samples made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import protocol, text

from . import guards

#: A row is complete if all of these are there.
REQUIRED = ["ret_1", "ret_5", "ret_20", "vol_5", "vol_20", "volume_zscore", "hl_spread", "oc_return", "feat_mkt_ret_1d"]
LABEL = "label_ret_1d"


def _log_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.ln(a / b))


def _by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


def market_returns(index: DataFrame) -> DataFrame:
    """date and feat_mkt_ret_1d of an index (date, close). Its rows are one a trading day."""
    w = Window.orderBy("date")
    return index.select("date", _log_ratio(F.col("close"), F.lag("close").over(w)).alias("feat_mkt_ret_1d"))


def features(daily: DataFrame, index: DataFrame) -> DataFrame:
    """Features of (date, ticker, open, high, low, close, volume), each from rows up to its date.

    Returns are logarithms of close ratios over 1, 5 and 20 rows; volatilities are sample deviations of the last 5 and 20 one-row returns
    and need all of them; the volume's z-score needs 20 volumes that are not all alike. All windows of a ticker share one sort.
    """
    w = _by_ticker()
    last = lambda n: w.rowsBetween(1 - n, 0)
    rows = daily.withColumns({f"ret_{n}": _log_ratio(F.col("close"), F.lag("close", n).over(w)) for n in (1, 5, 20)})
    full = lambda c, n, value: F.when(F.count(c).over(last(n)) == n, value)
    deviation = F.stddev_samp("volume").over(last(20))
    rows = rows.withColumns(
        {
            "vol_5": full("ret_1", 5, F.stddev_samp("ret_1").over(last(5))),
            "vol_20": full("ret_1", 20, F.stddev_samp("ret_1").over(last(20))),
            "volume_zscore": full("volume", 20, F.when(deviation > 0, (F.col("volume") - F.avg("volume").over(last(20))) / F.nullif(deviation, F.lit(0.0)))),
            "hl_spread": F.when(F.col("close") > 0, (F.col("high") - F.col("low")) / F.nullif(F.col("close"), F.lit(0.0))),
            "oc_return": _log_ratio(F.col("close"), F.col("open")),
        }
    )
    out = rows.join(F.broadcast(market_returns(index)), "date", "left")  # a row a trading day
    complete = F.lit(True)
    for c in REQUIRED:
        complete = complete & F.col(c).isNotNull()
    return out.select(F.col("date").alias("as_of_date"), "ticker", *REQUIRED, F.col("date").alias("feature_window_end_date"), complete.alias("feature_complete"))


def forward_returns(daily: DataFrame) -> DataFrame:
    """The return to the ticker's next row; a ticker's last row has none."""
    w = _by_ticker()
    rows = daily.select(F.col("date").alias("as_of_date"), "ticker", _log_ratio(F.lead("close").over(w), F.col("close")).alias(LABEL), F.lead("date").over(w).alias("label_start_date"))
    return rows.where(f"label_start_date is not null and {LABEL} is not null").withColumn("label_end_date", F.col("label_start_date"))


def news_counts(news: DataFrame) -> DataFrame:
    """Mapped news of each company and day."""
    rows = news.where(protocol.true("is_mapped")).select(F.col("published_date").alias("as_of_date"), text.key("source_ticker").alias("ticker")).where("ticker <> ''")
    return rows.groupBy("as_of_date", "ticker").agg(F.count("*").alias("mapped_news_count_1d")).withColumn("has_mapped_news", F.lit(True))


def sample_index(features: DataFrame, labels: DataFrame, news: DataFrame | None, splits: DataFrame, window: protocol.Window, cutoff: str | None = None, tickers: set[str] | None = None, checked: bool = True) -> DataFrame:
    """Complete features with labels and news counts, once for each part of a split that the date lies in.

    Features and labels after the cutoff are left out; both inputs and the result are guarded. splits has a few rows (split,
    partition, split_start, split_end), which are sent to every task; the two joins share the partitioning by date and ticker.
    """
    limit = protocol.cutoff_of(cutoff, window)
    f, y = features.where(F.col("as_of_date") <= limit), labels.where((F.col("as_of_date") <= limit) & (F.col("label_end_date") <= limit))
    if checked:
        f, y = guards.guarded(f, guards.feature_rules(limit), "features", "ticker"), guards.guarded(y, guards.label_rules(limit), "labels", "ticker")
    if tickers:
        f = f.where(F.col("ticker").isin(sorted(tickers)))
    rows = f.where(protocol.true("feature_complete")).select("as_of_date", "ticker", "feature_window_end_date").join(y, ["as_of_date", "ticker"])
    if news is None:
        rows = rows.withColumn("mapped_news_count_1d", F.lit(0).cast("long"))
    else:
        rows = rows.join(news_counts(news).drop("has_mapped_news"), ["as_of_date", "ticker"], "left")
    rows = rows.withColumn("mapped_news_count_1d", F.coalesce("mapped_news_count_1d", F.lit(0)))
    parts = F.broadcast(splits)
    out = rows.join(parts, F.col("as_of_date").between(F.col("split_start"), F.col("split_end")))
    out = out.select("split", "partition", "as_of_date", "ticker", F.col("as_of_date").alias("cutoff_date"), "feature_window_end_date", F.lit(LABEL).alias("label_name"), F.col(LABEL).alias("label"), "label_start_date", "label_end_date", "mapped_news_count_1d", (F.col("mapped_news_count_1d") > 0).alias("has_mapped_news"))
    return guards.guarded(out, guards.sample_rules(limit, window.evaluation_start), "samples", "split") if checked else out


def split_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("split", "partition").agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("tickers"), F.min("as_of_date").alias("first_date"), F.max("as_of_date").alias("last_date"))
