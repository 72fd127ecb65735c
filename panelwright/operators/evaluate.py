"""Rank correlation of scores with returns, and portfolios of the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _average_rank(c: str, by: list[str]) -> Column:
    """Ranks from 1; equal values share the mean of their places."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2


def _correlation(x: str, y: str) -> Column:
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def information(rows: DataFrame, score: str = "score", label: str = "label", least: int = 3, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """date, n, ic, rank_ic: correlation of scores and labels across the companies of each date, of values and of average ranks."""
    used = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*by, F.col(score).alias("s"), F.col(label).alias("y"))
    ranked = used.withColumns({"rs": _average_rank("s", [*by]), "ry": _average_rank("y", [*by])})
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.round(_correlation("s", "y"), 6).alias("ic"), F.round(_correlation("rs", "ry"), 6).alias("rank_ic"))
    return out.where(F.col("n") >= least)


def information_summary(daily: DataFrame, by: list[str]) -> DataFrame:
    """Mean, deviation and their ratio of ic and rank_ic."""
    columns = [F.count("*").alias("days")]
    for c in ("ic", "rank_ic"):
        m, s = F.avg(c), F.stddev_samp(c)
        columns += [F.round(m, 6).alias(f"{c}_mean"), F.round(s, 6).alias(f"{c}_std"), F.round(F.try_divide(m, s), 6).alias(f"{c}_ir")]
    return daily.groupBy(*by).agg(*columns)


def decay(scores: DataFrame, daily: DataFrame, horizons: tuple[int, ...] = (1, 2, 5, 10, 20)) -> DataFrame:
    """horizon, days and the summary of ic and rank_ic: scores (date, ticker, score) against the log return of close over the next
    `horizon` rows of daily (date, ticker, close). All returns come of one sort of each ticker."""
    w = Window.partitionBy("ticker").orderBy("date")
    ahead = [F.struct(F.lit(h).alias("horizon"), F.ln(F.lead("close", h).over(w) / F.col("close")).alias("label")) for h in horizons]
    returns = daily.where("close > 0").select("date", "ticker", F.array(*ahead).alias("ahead"))
    rows = scores.select("date", "ticker", "score").join(returns, ["date", "ticker"]).select("date", "score", F.inline("ahead"))
    return information_summary(information(rows, by=("date", "horizon")), ["horizon"])


def portfolio(rows: DataFrame, k: int, score: str = "score", label: str = "label") -> DataFrame:
    """date, n, top, bottom, long_short: mean label of the k companies with the highest and the lowest score; ties go by ticker."""
    used = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    w = Window.partitionBy("date")
    placed = used.withColumns({"hi": F.row_number().over(w.orderBy(F.col(score).desc(), "ticker")), "lo": F.row_number().over(w.orderBy(F.col(score).asc(), "ticker"))})
    mean = lambda c: F.avg(F.when(F.col(c) <= k, F.col(label)))
    out = placed.groupBy("date").agg(F.count("*").alias("n"), mean("hi").alias("top"), mean("lo").alias("bottom"))
    return out.where(F.col("n") >= 2 * k).select("date", "n", F.round("top", 9).alias("top"), F.round("bottom", 9).alias("bottom"), F.round(F.col("top") - F.col("bottom"), 9).alias("long_short"))


def performance(returns: DataFrame, value: str = "long_short", year: int = 252) -> DataFrame:
    """One row: days, annual return and volatility, their ratio, and the largest fall from a peak of the sum of log returns."""
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    path = returns.withColumn("level", F.sum(value).over(run)).withColumn("peak", F.greatest(F.max("level").over(run), F.lit(0.0)))
    m, s = F.avg(value), F.stddev_samp(value)
    return path.agg(F.count("*").alias("days"), F.round(m * year, 6).alias("annual_return"), F.round(s * F.sqrt(F.lit(float(year))), 6).alias("annual_volatility"), F.round(F.try_divide(m, s) * F.sqrt(F.lit(float(year))), 6).alias("sharpe"), F.round(F.max(F.col("peak") - F.col("level")), 6).alias("max_drawdown"))
