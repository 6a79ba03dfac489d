"""Labelled samples: one row per sample with an id, a float32 feature array and one label or several 0/1 labels."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Samples:
    """df(id long, features array<float>) and labels(id, label_name, y string); width features, n samples."""

    df: DataFrame
    labels: DataFrame | None
    n: int
    width: int
    multilabel: bool
    label_names: tuple[str, ...]
    skipped: tuple[str, ...] = ()
    positives: dict[str, int] | None = None
    class_names: dict[str, str] | None = None

    @property
    def valid(self) -> tuple[str, ...]:
        return tuple(x for x in self.label_names if x not in self.skipped)


def _feature_array(df: DataFrame, features: str | list[str]):
    if isinstance(features, str):
        kind = df.schema[features].dataType
        if not isinstance(kind, T.ArrayType):
            raise ValueError("features must be two-dimensional: an array column or several numeric columns")
        if not isinstance(kind.elementType, NUMERIC):
            raise TypeError("features must be numeric")
        return F.col(features) if isinstance(kind.elementType, T.FloatType) else F.transform(F.col(features), lambda x: x.cast("float"))
    if not features:
        raise ValueError("features must be two-dimensional: an array column or several numeric columns")
    for c in features:
        if not isinstance(df.schema[c].dataType, NUMERIC):
            raise TypeError(f"feature {c} must be numeric")
    return F.array(*[F.col(c).cast("float") for c in features])


def load(
    df: DataFrame, id_col: str, features: str | list[str], labels: str | list[str] | None = None, *, multilabel: bool | None = None, label_names: list[str] | None = None, neighbors: int | None = None
) -> Samples:
    """Check and normalise input in one aggregate over the samples and one over the labels.

    labels: a column name (any atomic class values) or a list of 0/1 columns (multilabel). Null or repeated ids, null or
    non-finite features, null labels, fewer than two classes and labels other than 0/1 are errors, as are duplicate names.
    A 0/1 column that is constant is skipped.
    """
    several = isinstance(labels, (list, tuple))
    if multilabel is not None and labels is not None and multilabel != several:
        raise ValueError("labels must be two-dimensional" if multilabel else "labels must be one-dimensional")
    names = list(label_names or labels) if several else []
    if several:
        if not labels:
            raise ValueError("at least one label column is needed")
        if len(names) != len(labels):
            raise ValueError("label_names must have one name for each label column")
        if len(set(names)) != len(names):
            raise ValueError("label_names has duplicates")
    own = df.select(F.col(id_col).cast("long").alias("id"), _feature_array(df, features).alias("features"), *([F.col(c) for c in labels] if several else [F.col(labels)] if labels else []))
    bad = ~F.coalesce(F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in (labels if several else [labels] if labels else [])], F.lit(False))
    stats = own.agg(
        F.count("*").alias("n"), F.count("id").alias("ids"), F.min(F.size("features")).alias("least"), F.max(F.size("features")).alias("most"),
        F.count_if(bad).alias("bad"), F.count_if(missing).alias("missing"),
    ).first()
    if stats["n"] < 2:
        raise ValueError("at least two samples are needed")
    if stats["ids"] < stats["n"] or not own.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError("sample ids must be unique and not null")
    if stats["bad"]:
        raise ValueError("features must be finite")
    if stats["least"] != stats["most"] or stats["least"] < 1:
        raise ValueError("features must be two-dimensional: every sample needs the same number of features, one at least")
    if stats["missing"]:
        raise ValueError("labels must have the same number of samples: an id has no label")
    if neighbors is not None and not 1 <= neighbors < stats["n"]:
        raise ValueError("neighbors must be at least 1 and below the number of samples")
    base = own.select("id", "features")
    if labels is None:
        return Samples(base, None, stats["n"], stats["least"], False, ())
    if not several:
        return _single(own, base, stats, labels, label_names)
    long = own.select("id", F.inline(F.array(*[F.struct(F.lit(n).alias("label_name"), F.col(c).cast("double").alias("y")) for n, c in zip(names, labels, strict=True)])))
    seen = {r["label_name"]: r for r in long.groupBy("label_name").agg(F.sum("y").alias("pos"), F.count_if(~F.col("y").isin(0.0, 1.0)).alias("odd")).collect()}
    if any(r["odd"] for r in seen.values()):
        raise ValueError("multilabel labels must be 0 or 1")
    positives = {n: int(seen[n]["pos"]) for n in names}
    skipped = tuple(n for n in names if not 0 < positives[n] < stats["n"])
    if len(skipped) == len(names):
        raise ValueError("no label column has both values")
    long = long.filter(~F.col("label_name").isin(*skipped)) if skipped else long
    return Samples(base, long.select("id", "label_name", F.col("y").cast("int").cast("string").alias("y")), stats["n"], stats["least"], True, tuple(names), skipped, positives)


def _single(own: DataFrame, base: DataFrame, stats, label: str, label_names: list[str] | None) -> Samples:
    whole = isinstance(own.schema[label].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType))
    counts = own.groupBy(F.col(label).alias("y")).count().orderBy("y").collect()  # a row a class
    if len(counts) < 2:
        raise ValueError("at least two classes are needed")

    def shown(v) -> str:
        if whole and label_names is not None and 0 <= int(v) < len(label_names):
            return label_names[int(v)]
        return f"class_{v}"

    classes = {(str(r["y"]).lower() if isinstance(r["y"], bool) else str(r["y"])): shown(r["y"]) for r in counts}
    labels = own.select("id", F.lit("").alias("label_name"), F.col(label).cast("string").alias("y"))
    return Samples(base, labels, stats["n"], stats["least"], False, ("",), class_names=classes)
