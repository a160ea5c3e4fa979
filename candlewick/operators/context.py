"""Context vectors: the last rows' features as one array, and their scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.operators.features import FEATURES
from candlewick.operators.series import KEYS, series


def context_windows(df: DataFrame, length: int = 20, features: Sequence[str] = FEATURES, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``context``: features of the last ``length`` rows, oldest first. Rows with fewer before them go. Over a whole
    series, validation and test windows reach back into the rows before their part."""
    if length <= 0:
        raise ValueError("a context has a row at least")
    frame = series(keys).rowsBetween(-(length - 1), 0)
    rows = F.collect_list(F.array(*features)).over(frame)
    return df.withColumn("context", F.flatten(rows)).where(F.size("context") == length * len(features))


def class_weights(df: DataFrame, label: str = "Label_id", classes: int = 3) -> DataFrame:
    """n / (classes * count) of each class; an empty class counts as one."""
    counts = df.agg(F.count(label).alias("n"), *[F.count_if(F.col(label) == k).alias(f"c{k}") for k in range(classes)])
    rows = F.array(*[F.struct(F.lit(k).alias("Label_id"), (F.col("n") / (classes * F.greatest(F.col(f"c{k}"), F.lit(1)))).alias("weight")) for k in range(classes)])
    return counts.select(F.inline(rows))


def standardized(df: DataFrame, moments: DataFrame, vector: str = "context") -> DataFrame:
    """``vector`` scaled by ``moments``: a row a position, so as short as a vector."""
    packed = moments.agg(F.sort_array(F.collect_list(F.struct("pos", "mean", "std"))).alias("_m"))
    scaled = F.zip_with(vector, "_m", lambda x, m: (x - m["mean"]) / m["std"])
    return df.join(F.broadcast(packed)).withColumn(vector, scaled).drop("_m")
