"""Gapless ranks without sending a group's rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 20_000


def rank_within(df: DataFrame, group: str, order: list[str | Column], spread: Column, n_rows: int, name: str) -> DataFrame:
    """Add ``name``, a rank from 0 without gaps in each value of ``group``.

    Rows of a group are dealt to buckets by ``spread``; ranks run through a group's buckets in order, and by
    ``order`` within a bucket. Only bucket counts are summed across a group, so a group may hold any share of
    the rows. Nulls in ``group`` form one group.
    """
    buckets = max(1, -(-n_rows // ROWS_PER_BUCKET))
    dealt = df.withColumn("_bucket", F.pmod(F.hash(spread), F.lit(buckets)))
    counts = dealt.groupBy(F.col(group).alias("_group"), "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_group", F.col("_bucket").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(group, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_row", F.row_number().over(own))
    on = ranked[group].eqNullSafe(starts["_group"]) & (ranked["_bucket"] == starts["_at"])
    return ranked.join(starts, on).withColumn(name, F.col("_start") + F.col("_row") - 1).drop("_bucket", "_group", "_at", "_start", "_row")
