"""Scores of a labelled neighbour table: N3, kDN, CM, C1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """(label_name, i, rank, y, same): each neighbour with whether its class is the sample's own."""
    own = labels.select(F.col("id").alias("i"), "label_name", "y")
    other = labels.select(F.col("id").alias("j"), "label_name", F.col("y").alias("y_j"))
    rows = knn.select("i", "rank", "j").join(other, "j").join(own, ["i", "label_name"])
    return rows.select("label_name", "i", "rank", "y", (F.col("y") == F.col("y_j")).cast("int").alias("same"))


def instances(knn: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """One row a label and sample: error (of the nearest), disagree (count), hard, c1; one shuffle by sample.

    c1 is 1 less the mean purity of the prefixes: a neighbour of rank r counts 1/r + ... + 1/k.
    """
    weights = F.array(*[F.lit(sum(1.0 / j for j in range(r, k + 1)) / k) for r in range(1, k + 1)])
    rows = labelled(knn.filter(F.col("rank") <= k), labels)
    out = rows.groupBy("label_name", "i", "y").agg(
        F.max(F.when(F.col("rank") == 1, 1 - F.col("same"))).alias("error"), F.sum(1 - F.col("same")).alias("disagree"), (1 - F.sum(F.col("same") * weights[F.col("rank") - 1])).alias("c1")
    )
    return out.withColumn("hard", (2 * F.col("disagree") > k).cast("int"))


def sweep(knn: DataFrame, labels: DataFrame, ks: list[int]) -> DataFrame:
    """instances() for each k, with k beside: all from one pass over the neighbours."""
    rank, same, rows = F.col("rank"), F.col("same"), labelled(knn.filter(F.col("rank") <= max(ks)), labels)
    found = [F.max(F.when(rank == 1, 1 - same)).alias("error")]
    for k in ks:
        weights = F.array(*[F.lit(sum(1.0 / j for j in range(r, k + 1)) / k) for r in range(1, k + 1)])
        found += [F.sum(F.when(rank <= k, 1 - same)).alias(f"disagree{k}"), (1 - F.sum(F.when(rank <= k, same * weights[rank - 1]))).alias(f"c{k}")]
    each = [F.struct(F.lit(k).alias("k"), F.col(f"disagree{k}").alias("disagree"), F.col(f"c{k}").alias("c1"), (2 * F.col(f"disagree{k}") > k).cast("int").alias("hard")) for k in ks]
    return rows.groupBy("label_name", "i", "y").agg(*found).select("label_name", "i", "y", "error", F.inline(F.array(*each)))


def by_class(inst: DataFrame) -> DataFrame:
    """(label_name, y, n, errors, n3)."""
    return inst.groupBy("label_name", "y").agg(F.count("*").alias("n"), F.sum("error").alias("errors"), F.avg("error").alias("n3"))


def scores(inst: DataFrame, k: int | None = None) -> DataFrame:
    """(label_name, N3, N3_micro, kDN, CM, C1, ...): N3 is the mean of the classes' rates, the rest are over samples; from one pass
    over the instances. Without k: of a sweep, for each k."""
    keys, k = (["label_name"], F.lit(k)) if k is not None else (["k", "label_name"], F.col("k"))
    n3, n = F.col("n3"), F.sum("n")
    classes = inst.groupBy(*keys, "y").agg(F.count("*").alias("n"), F.avg("error").alias("n3"), *[F.sum(c).alias(c) for c in ("error", "disagree", "hard", "c1")])
    return classes.groupBy(*keys).agg(
        F.avg(n3).alias("N3"), (F.sum("error") / n).alias("N3_micro"), (F.sum("disagree") / (n * k)).alias("kDN"), (F.sum("hard") / n).alias("CM"), (F.sum("c1") / n).alias("C1"),
        F.max(F.when(F.col("y") == "0", n3)).alias("N3_negative"), F.max(F.when(F.col("y") == "1", n3)).alias("N3_positive"),
        F.sum("error").alias("N3_error_count"), F.sum("disagree").alias("kDN_disagreement_count"), F.sum("hard").alias("CM_hard_sample_count"), F.sum("c1").alias("C1_instance_sum"),
    )
