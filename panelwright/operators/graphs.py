"""Monthly graphs of companies: by events, by price correlation; snapshots by date."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import text


def snapshots(days: DataFrame) -> DataFrame:
    """The last trading date of each month and its place among the trading dates (date, month)."""
    ranked = days.select("date").distinct().withColumn("day", F.row_number().over(Window.orderBy("date")))
    return ranked.groupBy(text.month("date").alias("month")).agg(F.max("date").alias("graph_date"), F.max("day").alias("graph_day"))


def _top(edges: DataFrame, k: int, weight: Column) -> DataFrame:
    w = Window.partitionBy("graph_date", "source_ticker").orderBy(weight.desc(), "target_ticker")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def semantic(edges: DataFrame, days: DataFrame, span: int = 63, k: int = 5, decay: float = 0.0) -> DataFrame:
    """graph_date, source_ticker, target_ticker, weight, rank: event edges of the last `span` trading days of each snapshot, counted or
    decayed by age, the k heaviest of each source. Edges on other days count on the next trading day. An edge is sent to the
    at most span / 20 snapshots it belongs to by their day numbers, a join on ranges of a calendar that is broadcast."""
    calendar = days.select("date").distinct().withColumn("day", F.row_number().over(Window.orderBy("date")))
    per_day = edges.groupBy("published_date", "source_ticker", "target_ticker").agg(F.count("*").alias("n"))
    following = calendar.select("day", "date", F.coalesce(F.lag("date").over(Window.orderBy("date")), F.lit("")).alias("before"))
    placed = per_day.join(F.broadcast(following), (F.col("published_date") > F.col("before")) & (F.col("published_date") <= F.col("date")))
    s = F.broadcast(snapshots(days))
    within = placed.join(s, (F.col("day") <= F.col("graph_day")) & (F.col("day") > F.col("graph_day") - span))
    weight = F.sum(F.col("n") * F.exp(F.lit(-decay) * (F.col("graph_day") - F.col("day")))) if decay else F.sum("n").cast("double")
    out = within.groupBy("graph_date", "source_ticker", "target_ticker").agg(weight.alias("weight"))
    return _top(out.withColumn("weight", F.round("weight", 6)), k, F.col("weight")).select("graph_date", "source_ticker", "target_ticker", "weight", "rank")


def static_semantic(edges: DataFrame, splits: DataFrame) -> DataFrame:
    """The distinct edges of each split's training years."""
    train = F.broadcast(splits.where("partition = 'train'"))
    return edges.join(train, F.col("published_date").between(F.col("split_start"), F.col("split_end"))).select("split", "source_ticker", "target_ticker").distinct()


def _block(rows: pd.DataFrame, span: int) -> pd.DataFrame:
    """The companies of a block in order, and their returns as one matrix of a row each; days without a return are NaN."""
    rows = rows.sort_values("ticker")
    matrix = np.full((len(rows), span), np.nan)
    for i, (ages, values) in enumerate(zip(rows["ages"], rows["values"], strict=True)):
        matrix[i, ages] = values
    return pd.DataFrame({"graph_date": rows["graph_date"].iloc[:1], "block": rows["block"].iloc[:1], "tickers": [rows["ticker"].tolist()], "returns": [matrix.tobytes()]})


def _correlations(x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """Absolute correlation of each row of x with each of y over the days that both have; NaN below `least` days or without deviation."""

    def centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have = ~np.isnan(m)
        mean = np.where(have, m, 0).sum(1) / np.maximum(have.sum(1), 1)
        return np.where(have, m - mean[:, None], 0), have.astype(float)

    (a, ha), (b, hb) = centred(x), centred(y)
    n = ha @ hb.T
    with np.errstate(invalid="ignore", divide="ignore"):
        sa, sb = a @ hb.T, ha @ b.T
        saa, sbb = (a * a) @ hb.T, ha @ (b * b).T
        va, vb = saa - sa * sa / n, sbb - sb * sb / n
        # what is left of a difference of equal sums is no deviation
        va, vb = np.where(va > 1e-12 * saa, va, np.nan), np.where(vb > 1e-12 * sbb, vb, np.nan)
        out = np.abs(a @ b.T - sa * sb / n) / np.sqrt(va * vb)
    return np.where(n >= least, out, np.nan)


def price(returns: DataFrame, span: int = 60, k: int = 10, block: int = 1024) -> DataFrame:
    """graph_date, source_ticker, target_ticker, weight, rank: absolute correlations of ret_1 over the last `span` trading days of each
    snapshot, the k highest of each company. Both companies must have half of the days in common. A company has one return a day.

    Companies are put in blocks of about `block`; what is joined are pairs of blocks, each a matrix of `block` x `span` numbers, and each pair
    passes on the k best of each of its companies. Ties go by ticker."""
    days = returns.select(F.col("as_of_date").alias("date"))
    calendar = days.distinct().withColumn("day", F.row_number().over(Window.orderBy("date")))
    s = F.broadcast(snapshots(days))
    rows = returns.where("ret_1 is not null").select(F.col("as_of_date").alias("date"), "ticker", "ret_1").join(F.broadcast(calendar), "date")
    rows = rows.join(s, (F.col("day") <= F.col("graph_day")) & (F.col("day") > F.col("graph_day") - span))
    each = F.collect_list(F.struct((F.col("graph_day") - F.col("day")).alias("age"), "ret_1")).alias("r")
    vectors = rows.groupBy("graph_date", "ticker").agg(each).select("graph_date", "ticker", F.col("r.age").alias("ages"), F.col("r.ret_1").alias("values"))
    blocks = max(1, -(-returns.select("ticker").distinct().count() // block))
    numbered = vectors.withColumn("block", F.pmod(F.xxhash64("ticker"), F.lit(blocks)))
    packed = numbered.groupBy("graph_date", "block").applyInPandas(lambda g: _block(g, span), "graph_date string, block long, tickers array<string>, returns binary")
    other = packed.select("graph_date", *[F.col(c).alias(f"other_{c}") for c in ("block", "tickers", "returns")])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = lambda data: np.frombuffer(data).reshape(-1, span)
        for batch in batches:
            for r in batch.itertuples(index=False):
                sources, targets = np.array(r.tickers, dtype=object), np.array(r.other_tickers, dtype=object)
                weights = np.round(_correlations(matrix(r.returns), matrix(r.other_returns), span // 2), 6)
                if r.block == r.other_block:
                    np.fill_diagonal(weights, np.nan)
                top = np.argsort(-weights, axis=1, kind="stable")[:, :k]  # targets are in order; NaN comes last
                source = np.repeat(np.arange(len(sources)), top.shape[1])
                target = top.ravel()
                value = weights[source, target]
                some = ~np.isnan(value)
                yield pd.DataFrame({"graph_date": r.graph_date, "source_ticker": sources[source[some]], "target_ticker": targets[target[some]], "weight": value[some]})

    out = packed.join(other, "graph_date").mapInPandas(best, "graph_date string, source_ticker string, target_ticker string, weight double")
    return _top(out, k, F.col("weight")).select("graph_date", "source_ticker", "target_ticker", "weight", "rank")


def as_of(dates: DataFrame, graph_dates: DataFrame, date: str = "as_of_date") -> DataFrame:
    """Each date with the latest graph_date up to it, or null: both lists in one, ordered once, the last snapshot carried on."""
    both = dates.select(F.col(date).alias("at"), F.lit(None).cast("string").alias("g")).distinct().unionByName(graph_dates.select(F.col("graph_date").alias("at"), F.col("graph_date").alias("g")).distinct())
    w = Window.orderBy("at", F.col("g").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("graph_date", F.last("g", ignorenulls=True).over(w)).where("g is null").select(F.col("at").alias(date), "graph_date")


def stats(graph: DataFrame) -> DataFrame:
    """Nodes, edges, mean out-degree and density of each snapshot."""
    nodes = graph.select("graph_date", F.explode(F.array("source_ticker", "target_ticker")).alias("t")).groupBy("graph_date").agg(F.count_distinct("t").alias("nodes"))
    edges = graph.groupBy("graph_date").agg(F.count("*").alias("edges"), F.count_distinct("source_ticker").alias("sources"))
    out = edges.join(nodes, "graph_date")
    return out.select("graph_date", "nodes", "edges", "sources", F.round(F.col("edges") / F.col("sources"), 6).alias("avg_out_degree"), F.round(F.try_divide(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), 6).alias("density"))
