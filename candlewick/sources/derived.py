"""Bars derived from the driver's event and line-item tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _ohlc(df: DataFrame, price: str, order: Column, volume: Column) -> DataFrame:
    return df.groupBy("ticker", "date").agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), volume.cast("long").alias("volume")
    )


def _whole(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"adj_close": F.col("close"), "company": F.concat(F.lit("Co "), F.col("ticker")), "dividends": F.lit(0.0), "stock_splits": F.lit(0.0)})


def bars_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of a walk for each event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    steps = events.select(F.col("event_type").alias("ticker"), hour.alias("date"), "ts", "event_id", (F.round(F.col("value") * 100).cast("long") - 5000).alias("step"))
    # the walk goes on from the hours before: one row an hour is summed along a series, events within their hour alone
    before = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    starts = steps.groupBy("ticker", "date").agg(F.sum("step").alias("n")).select("ticker", "date", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("ticker", "date").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    walk = steps.withColumn("sum", F.sum("step").over(own)).join(starts, ["ticker", "date"])
    hourly = walk.withColumn("px", (F.lit(5000000) + F.col("start") + F.col("sum")).cast("double") / F.lit(50000.0))
    return _whole(_ohlc(hourly, "px", F.struct("ts", "event_id"), F.count("*")))


def _line_bars(spark: SparkSession, sf_dir: str, price: Column) -> DataFrame:
    lines, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    joined = lines.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rows = joined.select(F.col("p_brand").alias("ticker"), F.col("l_shipdate").alias("date"), price.alias("px"), key.alias("k"), F.col("l_quantity").cast("long").alias("q"))
    return _whole(_ohlc(rows, "px", F.col("k"), F.sum("q")))


def bars_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of unit prices for each brand: violent moves."""
    return _line_bars(spark, sf_dir, F.col("l_extendedprice") / F.col("l_quantity"))


def bars_calm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``bars_brand``, with prices of 1,000 to 1,105."""
    return _line_bars(spark, sf_dir, 1000 + F.col("l_extendedprice") / F.col("l_quantity") / 1000)
