"""F1 over a stream: with frozen bounds, scaled moments of classes add up from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangle.operators import scaling


def batch_moments(df: DataFrame, lo, hi) -> DataFrame:
    """(y, f, n, mean, m2) of a batch of df(features, label): count, mean and sum of squared deviations."""
    rows = scaling.scale(df, lo, hi, width=len(lo)).select(F.col("label").cast("string").alias("y"), F.posexplode("features").alias("f", "x"))
    x = F.col("x").cast("double")
    return rows.groupBy("y", "f").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count("*")).alias("m2"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Moments of both."""
    rows = a.unionByName(b)
    total = rows.groupBy("y", "f").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.collect_list(F.struct("n", "mean", "m2")).alias("parts"))  # two parts
    spread = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["m2"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    return total.select("y", "f", "n", "mean", spread.alias("m2"))


def stats(moments: DataFrame) -> DataFrame:
    """What tangle.functions.fisher.pair_ratios reads."""
    return moments.select(F.lit("").alias("label_name"), "y", "f", "n", "mean", (F.col("m2") / F.col("n")).alias("var"))


def start(stream: DataFrame, lo, hi, path: str, checkpoint: str):
    """Keeps the moments of all batches of stream(features, label) under path/<batch>; returns the running query.

    Each batch reads the moments of the one before, so a batch that is run again after a failure writes the same rows.
    """

    def step(batch: DataFrame, number: int) -> None:
        now = batch_moments(batch, lo, hi)
        if number:
            now = merge(now, batch.sparkSession.read.parquet(f"{path}/{number - 1}"))
        now.write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
