"""The public calls, each on a DataFrame with an id column, features (an array column or numeric columns) and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangle.operators import forest, pairs, scaling
from tangle.operators import neighbors as N_
from tangle.plans import engine
from tangle.plans.engine import EDGE_CUTOFF, KNN_TIE_POLICY, NEIGHBOR_METRICS, SUPPORTED_METRICS, TIE_POLICY, Geometry, Result
from tangle.sources import samples

__all__ = [
    "EDGE_CUTOFF", "KNN_TIE_POLICY", "NEIGHBOR_METRICS", "SUPPORTED_METRICS", "TIE_POLICY", "Geometry", "Result", "build_geometry", "build_knn_graph", "build_knn_graph_blockwise",
    "compute_f1", "compute_metrics", "compute_n1", "compute_neighbor_metrics", "fixed_range_scale", "minimum_spanning_forest", "pairwise_distances", "score_n1",
]

compute_metrics = engine.compute


def _rows(df: DataFrame, id_col: str, features) -> DataFrame:
    return samples.load(df, id_col, features).df


def fixed_range_scale(df: DataFrame, id_col: str, features, *, reference_min=None, reference_max=None) -> DataFrame:
    """(id, features) scaled to [0, 1] by the input's range, or by the given one without clipping."""
    s = samples.load(df, id_col, features)
    if reference_min is not None or reference_max is not None:
        scaling.check_bounds(reference_min, reference_max, s.width)
    return scaling.fixed_range_scale(s.df, reference_min, reference_max)


def build_geometry(df: DataFrame, id_col: str, features, labels=None, *, reference_min=None, reference_max=None, precision: str = "float32") -> Geometry:
    """A handle: scaled samples, bounds, and on demand pairs, neighbours, forest and duplicate groups."""
    return engine.geometry(samples.load(df, id_col, features, labels), reference_min=reference_min, reference_max=reference_max, precision=precision)


def pairwise_distances(df: DataFrame, id_col: str, features) -> DataFrame:
    """(i, j, w) of all ordered pairs of samples as they are, each with itself included."""
    return pairs.pairwise(_rows(df, id_col, features))


def build_knn_graph(source: Geometry | DataFrame, max_k: int, *, return_distances: bool = True) -> DataFrame:
    """(i, rank, j[, w]) of a geometry, or of a distance relation (i, j, w)."""
    if isinstance(source, Geometry):
        found = source.knn(max_k)
    else:
        n = source.select("i").distinct().count()
        N_.check_k(max_k, n)
        found = N_.knn_precomputed(pairs.check_precomputed(source, n), max_k)
    return found if return_distances else found.drop("w")


def build_knn_graph_blockwise(scaled: DataFrame, max_k: int, *, block_size: int = pairs.BLOCK, id_col: str = "id", features="features") -> DataFrame:
    """The same from scaled samples, block_size of them against the rest at a time."""
    s = samples.load(scaled, id_col, features)
    return N_.knn(s.df, N_.check_k(max_k, s.n), size=block_size)


def _padded(labels, how: dict) -> dict:
    """how, with too few label_names made up by label_<index>, as direct calls of a metric allow."""
    names = how.get("label_names")
    if isinstance(labels, (list, tuple)) and names is not None and len(names) < len(labels):
        how = how | {"label_names": [*names, *[f"label_{i}" for i in range(len(names), len(labels))]]}
    return how


def compute_f1(scaled: DataFrame, id_col: str, features, labels, **how) -> Result:
    """F1 of features that are scaled already."""
    return engine.compute(scaled, id_col, features, labels, metrics=("F1",), prescaled=True, **_padded(labels, how))


def compute_neighbor_metrics(table: DataFrame, labelled: DataFrame, id_col: str, labels, metrics=NEIGHBOR_METRICS, neighbors: int = 5, **how) -> Result:
    """N3, kDN, CM, C1 of a neighbour table (i, rank, j) and the samples' labels."""
    rows = labelled.withColumn("_none", F.array(F.lit(0.0)))
    return engine.compute(rows, id_col, "_none", labels, metrics=metrics, neighbors=neighbors, prescaled=True, knn_table=table, **_padded(labels, how))


def minimum_spanning_forest(distances: DataFrame, *, edge_cutoff: float = EDGE_CUTOFF) -> DataFrame:
    """(lo, hi, w): the forest of a distance relation (i, j, w), of which the pairs i < j count."""
    return forest.spanning_forest(distances.filter("i < j").select(F.col("i").alias("lo"), F.col("j").alias("hi"), "w"), edge_cutoff)


def score_n1(edges: DataFrame, labelled: DataFrame, id_col: str, labels, **how) -> Result:
    """N1 of a forest (lo, hi) for any labels of its samples."""
    rows = labelled.withColumn("_none", F.array(F.lit(0.0)))
    return engine.compute(rows, id_col, "_none", labels, metrics=("N1",), prescaled=True, edges=edges, **how)


def compute_n1(df: DataFrame, id_col: str, features, labels, *, edge_cutoff: float = EDGE_CUTOFF, **how) -> Result:
    """N1 end to end; precision="float64" scales and compares in double."""
    return engine.compute(df, id_col, features, labels, metrics=("N1",), edge_cutoff=edge_cutoff, **how)
