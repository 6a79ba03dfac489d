"""Min-max scaling in float32, with fitted or frozen bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(df: DataFrame) -> tuple[list[float], list[float]]:
    """Least and greatest value of each feature of df(features): one row a feature, by partial aggregation."""
    rows = df.select(F.posexplode("features").alias("f", "x")).groupBy("f").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("f").collect()
    return [r["lo"] for r in rows], [r["hi"] for r in rows]


def _matrix(features: pa.Array) -> np.ndarray:
    return features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1)


def matrix_bounds(df: DataFrame) -> tuple[list[float], list[float]]:
    """bounds() of checked samples, whose rows are finite and equally long: a row a feature leaves a task."""

    def least(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo = hi = None
        for b in it:
            if b.num_rows:
                x = _matrix(b.column(0))
                low, high = x.min(axis=0), x.max(axis=0)
                lo, hi = (low, high) if lo is None else (np.minimum(lo, low), np.maximum(hi, high))
        if lo is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lo), dtype=np.int32)), pa.array(lo.astype(np.float64)), pa.array(hi.astype(np.float64))], names=["f", "lo", "hi"])

    rows = sorted(df.select("features").mapInArrow(least, "f int, lo double, hi double").groupBy("f").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect())
    return [r["lo"] for r in rows], [r["hi"] for r in rows]


def check_bounds(lo, hi, width: int) -> tuple[np.ndarray, np.ndarray]:
    if (lo is None) != (hi is None):
        raise ValueError("reference_min and reference_max must be given together")
    lo, hi = np.asarray(lo, np.float64), np.asarray(hi, np.float64)
    if lo.shape != (width,) or hi.shape != (width,):
        raise ValueError("reference bounds must have one value for each feature")
    if not (np.isfinite(lo).all() and np.isfinite(hi).all()):
        raise ValueError("reference bounds must be finite")
    if (hi < lo).any():
        raise ValueError("reference_max must not be below reference_min")
    return lo, hi


def _scaled(x: Column, lo: float, hi: float, kind: str) -> Column:
    if hi <= lo:
        return F.lit(0.0).cast(kind)
    low, width = F.lit(float(lo)).cast(kind), F.lit(float(hi)).cast(kind) - F.lit(float(lo)).cast(kind)
    z = ((x.cast(kind) - low) / width).cast(kind)
    return F.when(z == 0, F.lit(0.0).cast(kind)).otherwise(z)  # no -0.0


def _in_kind(lo, hi, width: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = check_bounds(lo, hi, width)
    if kind == "float":
        with np.errstate(over="ignore"):
            lo, hi = lo.astype(np.float32), hi.astype(np.float32)
            if not np.isfinite(hi - lo).all():
                raise ValueError("the range of a feature overflows float32")
    return lo, hi


def scale(df: DataFrame, lo=None, hi=None, *, precision: str = "float32", width: int | None = None) -> DataFrame:
    """df with features scaled to (x - lo) / (hi - lo); not clipped; a constant feature becomes 0.

    Expressions are unrolled, one a feature, so that they are compiled; bounds are fitted unless given.
    """
    kind = {"float32": "float", "float64": "double"}[precision]
    width = width or df.select(F.size("features")).first()[0]
    if lo is None and hi is None:
        lo, hi = bounds(df)
    lo, hi = _in_kind(lo, hi, width, kind)
    out = F.array(*[_scaled(F.col("features")[i], float(lo[i]), float(hi[i]), kind) for i in range(width)])
    return df.withColumn("features", out)


def scale_matrix(df: DataFrame, lo, hi, *, precision: str = "float32", width: int) -> DataFrame:
    """scale() of checked samples(id, features), by Arrow batches: no expression a feature has to be made, planned and compiled."""
    kind = {"float32": "float", "float64": "double"}[precision]
    lo, hi = _in_kind(lo, hi, width, kind)
    varied = hi > lo
    low, range_ = lo[varied], hi[varied] - lo[varied]

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                x = _matrix(b.column(1)).astype(low.dtype)
                z = np.zeros_like(x)
                with np.errstate(over="ignore", invalid="ignore"):
                    z[:, varied] = (x[:, varied] - low) / range_ + 0  # no -0.0
                ends = np.arange(0, z.size + 1, width, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, z.ravel())], names=["id", "features"])

    return df.select("id", "features").mapInArrow(work, f"id long, features array<{kind}>")


def fixed_range_scale(df: DataFrame, lo=None, hi=None, *, id_col: str = "id") -> DataFrame:
    """(id, features) scaled; non-finite results are an error when the rows are read."""
    out = scale(df, lo, hi)
    finite = F.forall("features", lambda x: F.abs(x) < float("inf"))
    return out.withColumn("features", F.when(finite, F.col("features")).otherwise(F.raise_error(F.lit("a scaled value is not finite")).cast("array<float>")))


def duplicate_groups(scaled: DataFrame) -> DataFrame:
    """(members, size) of each set of equal scaled rows, members ascending."""
    return scaled.groupBy("features").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("id")).alias("members")).filter("size > 1").select("members", "size")


def alike(scaled: DataFrame) -> bool:
    """Whether rows may be equal: some have one hash. The features themselves don't move."""
    return not scaled.groupBy(F.xxhash64("features").alias("h")).count().filter("count > 1").isEmpty()


def duplicate_counts(scaled: DataFrame, some: bool | None = None) -> tuple[int, int]:
    """How many sets of equal scaled rows there are, and pairs within them; no set is gathered. some: alike(), if known."""
    if not (alike(scaled) if some is None else some):
        return 0, 0
    sizes = scaled.groupBy("features").agg(F.count("*").alias("size")).filter("size > 1")
    got = sizes.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.expr("size * (size - 1) div 2")), F.lit(0)).alias("pairs")).first()
    return got["groups"], got["pairs"]
