"""News, prices and calendars in one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import protocol, text

#: Columns of the raw news files and their names here (fixed values).
RAW_COLUMNS = {
    "Date": "published_at",
    "Article_title": "title",
    "Stock_symbol": "ticker_raw",
    "Url": "url",
    "Publisher": "publisher_raw",
    "Author": "author_raw",
    "Article": "body",
    "Lsa_summary": "summary_lsa",
    "Luhn_summary": "summary_luhn",
    "Textrank_summary": "summary_textrank",
    "Lexrank_summary": "summary_lexrank",
}
TITLE_CHARS = 50


def standardized(raw: DataFrame, source_file: str, source_priority: int, window: protocol.Window, row_number: str, version: str = "v1") -> DataFrame:
    """A raw file's rows under common names, with times in UTC, provenance and period flags. row_number names the column of
    raw that numbers its rows: it decides between equals, so it must not depend on how a file is read. Rows before the warm-up, or without a date, are left out."""
    named = raw.select(*[F.col(a).alias(b) for a, b in RAW_COLUMNS.items()], F.col(row_number).cast("long").alias("source_row_number"))
    at = protocol.timestamp_utc("published_at")
    out = named.withColumn("published_at", at).withColumn("published_date", protocol.iso_date("published_at")).where(F.col("published_date") >= window.warmup_start)
    bodies = ["body", *text.SUMMARIES]
    content = None
    for c in bodies:
        some = text.strip(text.or_empty(c)) != ""
        content = some if content is None else content | some
    return (
        out.withColumn("has_content", content)
        .withColumn("is_warmup", protocol.is_warmup("published_date", window))
        .withColumn("in_evaluation_window", protocol.in_evaluation("published_date", window))
        .withColumns({"source_file": F.lit(source_file), "source_priority": F.lit(source_priority), "version": F.lit(version)})
    )


def news_key() -> Column:
    """What makes two news rows the same: the url, or without one the date, code and beginning of the title."""
    url = text.strip(text.or_empty("url"))
    return F.when(url != "", F.concat(F.lit("u:"), url)).otherwise(F.concat_ws("|", F.lit("k:"), text.or_empty("published_date"), text.or_empty("ticker_raw"), F.substring(text.or_empty("title"), 1, TITLE_CHARS)))


def collapsed(news: DataFrame) -> DataFrame:
    """One row of each key, with news_id: rows with a body first, then the higher source priority, then the earlier file and row.

    The winner is the least tuple of an aggregate, so tasks combine their rows before they send them and a key held by very many
    rows costs no task more than one row from each other task.
    """
    has_body = text.strip(text.or_empty("body")) != ""
    order = F.struct((~has_body).alias("no_body"), (-F.col("source_priority")).alias("priority"), F.col("source_file"), F.col("source_row_number"))
    row = F.struct(*[F.col(c) for c in news.columns])
    best = news.select(news_key().alias("key"), order.alias("order"), row.alias("row")).groupBy("key").agg(F.min_by("row", "order").alias("row"))
    return best.select(text.digest("key").alias("news_id"), "row.*")


def news(sources: list[DataFrame]) -> DataFrame:
    """The collapsed union of standardized sources; files may have columns that others lack."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return collapsed(out)


def gaps_of(news: DataFrame) -> DataFrame:
    """One row: rows, and how many of them lack a url, code, body or any content."""
    blank = lambda c: F.count_if(text.strip(text.or_empty(c)) == "").alias(f"without_{c}")
    return news.agg(F.count("*").alias("rows"), blank("url"), blank("ticker_raw"), blank("body"), F.count_if(~F.col("has_content")).alias("without_content"))


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def prices(primary: DataFrame, fallback: DataFrame | None, index: DataFrame | None, window: protocol.Window) -> DataFrame:
    """Daily prices (date, ticker, open, high, low, close, adj_close, volume) of equities and of the index, flagged. Tickers the primary source
    lacks come from the fallback."""
    columns = ["date", "ticker", "open", "high", "low", "close", "adj_close", "volume"]
    kind = lambda df, instrument, confidence: df.select(*columns).withColumns({"instrument_type": F.lit(instrument), "data_confidence": F.lit(confidence)})
    out = kind(primary, "equity", "primary")
    if fallback is not None:
        out = out.unionByName(kind(fallback.join(primary.select("ticker").distinct(), "ticker", "left_anti"), "equity", "full_history"))
    if index is not None:
        out = out.unionByName(kind(index, "index", "primary"))
    return out.withColumn("is_warmup", protocol.is_warmup("date", window)).withColumn("in_evaluation_window", protocol.in_evaluation("date", window))


def universe_daily(daily: DataFrame, universe: DataFrame, window: protocol.Window, version: str = "v1") -> DataFrame:
    """Every trading date with every ticker of the universe, and whether it has a price. Dates and tickers are few: their pairs are the
    calendar itself, made by exploding the list of dates in each ticker's row."""
    dates = daily.agg(F.array_sort(F.collect_set("date")).alias("dates"))
    tickers = universe.select("ticker").distinct()
    grid = tickers.join(F.broadcast(dates)).select("ticker", F.explode("dates").alias("date"))
    have = daily.where(F.col("close").isNotNull()).select("date", "ticker").distinct().withColumn("has", F.lit(True))
    out = grid.join(have, ["date", "ticker"], "left").select("date", "ticker", F.coalesce("has", F.lit(False)).alias("has_price_data"))
    return out.withColumn("is_warmup", protocol.is_warmup("date", window)).withColumn("in_evaluation_window", protocol.in_evaluation("date", window)).withColumn("version", F.lit(version))


def listed_by(universe: DataFrame, evaluation_end: str) -> DataFrame:
    """Members added by the end of the evaluation; a missing date counts as early."""
    return universe.where(F.coalesce(protocol.day("date_added") <= F.lit(evaluation_end).cast("date"), F.lit(True)))
