"""Classification measures of (y_true, y_pred), for all rows or each group, in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.scalars import LABELS


def confusion(df: DataFrame, classes: int = 3) -> DataFrame:
    """One row for each true class: how many of each predicted one, zeros kept."""
    counts = df.agg(*[F.count_if((F.col("y_true") == t) & (F.col("y_pred") == p)).alias(f"c{t}{p}") for t in range(classes) for p in range(classes)])
    rows = [F.struct(F.lit(t).alias("y_true"), *[F.col(f"c{t}{p}").alias(f"pred_{p}") for p in range(classes)]) for t in range(classes)]
    return counts.select(F.inline(F.array(*rows)))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def evaluate(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """acc, bal_acc, macro_f1, and precision and recall of each class; a zero denominator gives 0."""
    t, p = F.col("y_true"), F.col("y_pred")
    sums = [F.count("*").alias("n"), F.count_if(t == p).alias("_right")]
    for k, name in enumerate(LABELS):
        sums += [F.count_if((t == k) & (p == k)).alias(f"_tp{k}"), F.count_if(p == k).alias(f"_p{k}"), F.count_if(t == k).alias(f"_t{k}")]
    found = df.groupBy(*by).agg(*sums)
    measures = {"acc": _share(F.col("_right"), F.col("n"))}
    f1 = []
    for k, name in enumerate(LABELS):
        tp, own_p, own_t = (F.col(f"_{c}{k}") for c in ("tp", "p", "t"))
        measures[f"precision_{name.lower()}"], measures[f"recall_{name.lower()}"] = _share(tp, own_p), _share(tp, own_t)
        precision, recall = _share(tp, own_p), _share(tp, own_t)
        f1.append(F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0))
    found = found.withColumns(measures | {"_f1": (f1[0] + f1[1] + f1[2]) / 3})
    recalls = [F.col(f"recall_{name.lower()}") for name in LABELS]
    return found.select(*by, "acc", ((recalls[0] + recalls[1] + recalls[2]) / 3).alias("bal_acc"), F.col("_f1").alias("macro_f1"), *[f"{m}_{name.lower()}" for name in LABELS for m in ("precision", "recall")])


def cross_entropy(df: DataFrame, weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean of -log(p of the true class + 1e-12); ``weights`` has a row a class."""
    p = F.when(F.col("y_true") == 0, F.col("p_sell")).when(F.col("y_true") == 1, F.col("p_hold")).otherwise(F.col("p_buy"))
    joined = df.join(F.broadcast(weights.select(F.col("Label_id").alias("y_true"), "weight")), "y_true")
    return joined.groupBy(*by).agg((-F.sum(F.col("weight") * F.log(p + F.lit(1e-12))) / F.sum("weight")).alias("cross_entropy"))
