"""overlap of classes by Fisher's ratio, averaged over class pairs and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_stats(scaled: DataFrame, labels: DataFrame) -> DataFrame:
    """(label_name, y, f, n, mean, var): moments of each feature in each class; var is the population variance.

    Features are exploded after the labels are joined by id; aggregation is partial before its only shuffle, so a class of
    any size costs a row a task and feature.
    """
    rows = scaled.join(labels, "id").select("label_name", "y", F.posexplode("features").alias("f", "x"))
    x = F.col("x").cast("double")
    return rows.groupBy("label_name", "y", "f").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"))


def pair_ratios(stats: DataFrame) -> DataFrame:
    """(label_name, a, b, f, num, den, term) for class pairs a < b: term is 1 / (1 + num / den), 1 where den is 0."""
    a, b = stats.alias("a"), stats.alias("b")
    pairs = a.join(b, (F.col("a.label_name") == F.col("b.label_name")) & (F.col("a.f") == F.col("b.f")) & (F.col("a.y") < F.col("b.y")))
    d = F.col("a.mean") - F.col("b.mean")
    out = pairs.select(F.col("a.label_name").alias("label_name"), F.col("a.y").alias("a"), F.col("b.y").alias("b"), F.col("a.f").alias("f"), (d * d).alias("num"), (F.col("a.var") + F.col("b.var")).alias("den"))
    return out.withColumn("term", F.coalesce(1 / (1 + F.try_divide("num", "den")), F.lit(1.0)))


def f1(scaled: DataFrame, labels: DataFrame) -> DataFrame:
    """(label_name, value, pairs, zero_denominators)."""
    return pair_ratios(class_stats(scaled, labels)).groupBy("label_name").agg(F.avg("term").alias("value"), F.count("*").alias("pairs"), F.count_if(F.col("den") == 0).alias("zero_denominators"))
