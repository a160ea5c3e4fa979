"""Train, validation and test parts of each series, in order of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.operators.series import KEYS, series


def chronological(df: DataFrame, train: float = 0.7, val: float = 0.15, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``split``: the cuts lie at int(n * train) and int(n * (train + val)), each part gets a row at least. Series of
    fewer than three rows, and rows without a key, are left out."""
    if not (0 < train < 1 and 0 < val < 1):
        raise ValueError("ratios lie between 0 and 1")
    if train + val >= 1:
        raise ValueError("train and val together stay below 1")
    whole = df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)) if keys else df
    placed = whole.withColumns({"_n": F.count("*").over(Window.partitionBy(*keys)), "_i": F.row_number().over(series(keys)) - 1}).where("_n >= 3")
    first = F.least(F.greatest(F.floor(F.col("_n") * F.lit(train)), F.lit(1)), F.col("_n") - 2)
    second = F.least(F.greatest(F.floor(F.col("_n") * F.lit(train + val)), first + 1), F.col("_n") - 1)
    part = F.when(F.col("_i") < first, "train").when(F.col("_i") < second, "val").otherwise("test")
    return placed.withColumn("split", part).drop("_n", "_i")
