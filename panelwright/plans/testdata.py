"""The engine's tables made of the driver's: prices of line items, news of orders and documents, companies of parts, suppliers and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.protocol import Window

#: Warm-up 1995, evaluation 1996 to 2001, splits of two, one and one years.
WINDOW = Window("1995-01-01", "1995-12-31", "1996-01-01", "2001-12-31")
SPLITS = [
    ("S1", "train", "1996-01-01", "1997-12-31"), ("S1", "val", "1998-01-01", "1998-12-31"), ("S1", "test", "1999-01-01", "1999-12-31"),
    ("S2", "train", "1997-01-01", "1998-12-31"), ("S2", "val", "1999-01-01", "1999-12-31"), ("S2", "test", "2000-01-01", "2000-12-31"),
    ("S3", "train", "1998-01-01", "1999-12-31"), ("S3", "val", "2000-01-01", "2000-12-31"), ("S3", "test", "2001-01-01", "2001-12-31"),
]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _ticks(self) -> DataFrame:
        parts = self.raw("part").select("p_partkey", F.upper("p_brand").alias("ticker"))
        rows = self.raw("lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
        order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
        return rows.select("ticker", F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity", order.alias("o"))

    def _daily(self, ticks: DataFrame, *keys: str) -> DataFrame:
        return ticks.groupBy(*keys).agg(F.min_by("price", "o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "o").alias("close"), F.max_by("price", "o").alias("adj_close"), F.sum("l_quantity").alias("volume"))

    def prices(self) -> DataFrame:
        return self._daily(self._ticks(), "date", "ticker")

    def index(self) -> DataFrame:
        return self._daily(self._ticks(), "date").withColumn("ticker", F.lit("ALL"))

    def splits(self) -> DataFrame:
        return self.spark.createDataFrame(SPLITS, "split string, partition string, split_start string, split_end string")

    def universe(self) -> DataFrame:
        """Parts, whose names repeat, and suppliers, whose names do not."""
        parts = self.raw("part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ticker"), F.concat_ws(".", "p_brand", F.col("p_partkey").cast("string")).alias("price_ticker"), F.concat(F.col("p_name"), F.when(F.col("p_size") % 3 == 0, " Inc.").when(F.col("p_size") % 3 == 1, " & Co").otherwise(" Group, Ltd.")).alias("company_name"), F.lit("").alias("cik"))
        suppliers = self.raw("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.lit("").alias("price_ticker"), F.concat("s_name", F.lit(" Corp")).alias("company_name"), F.col("s_nationkey").cast("string").alias("cik"))
        return parts.unionByName(suppliers)

    def news(self) -> DataFrame:
        """Orders as dated news about parts; some have blank or unknown codes."""
        n = F.col("o_orderkey")
        part = (n * 7) % self.raw("part").count()
        code = F.when(n % 11 == 0, "").when(n % 11 == 1, F.concat(F.lit(" p"), part.cast("string"), F.lit(" "))).when(n % 11 == 2, "OLD1").when(n % 11 == 3, "nothing").otherwise(F.concat(F.lit("P"), part.cast("string")))
        return self.raw("orders").select(
            F.concat(F.lit("n"), n.cast("string")).alias("news_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_date"), code.alias("ticker_raw"),
            F.concat(F.col("o_orderpriority"), F.lit(" order by Supplier#"), F.lpad((n % 130).cast("string"), 9, "0"), F.lit(" & others")).alias("title"),
            F.when(n % 5 != 0, F.concat(F.lit("Status "), F.col("o_orderstatus"))).alias("body"), F.col("o_orderstatus").alias("source_file"),
        )
