"""Exact k nearest neighbours with the tie rule (distance, smaller id); a sample is not its own neighbour, duplicates are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pairs as P
from .tiles import ABSENT, BOUND, NEIGHBOR, PART, _merge, neighbors_of, relations

#: Sets of rows of a given matrix that a task keeps neighbours of at once.
HELD = 256
KNN_TIE_POLICY = "distance, then smallest id"


def check_k(k, n: int) -> int:
    if isinstance(k, bool) or not isinstance(k, (int, np.integer)):
        raise TypeError("max_k must be an integer")
    if not 1 <= k < n:
        raise ValueError("max_k must be at least 1 and below the number of samples")
    return int(k)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("i").orderBy("w", "j")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("i", "rank", "j", "w")


def knn(scaled: DataFrame, k: int, *, size: int = P.BLOCK) -> DataFrame:
    """(i, rank, j, w) of scaled(id, features): each block meets all others in one task, so that its neighbours are final."""
    return neighbors_of(relations(scaled, k=k, size=size))


def knn_precomputed(pairs: DataFrame, k: int) -> DataFrame:
    """The same from a distance relation (i, j, w)."""
    return _ranked(pairs.filter("i <> j"), k)


def knn_matrix(tiles: DataFrame, n: int, k: int) -> DataFrame:
    """(i, rank, j, w) from a matrix of distances given in tiles (i, j, w) of bytes: square, none negative or not finite.

    One pass: a task keeps the k nearest of the rows whose tiles it has, and what is to be checked.
    """

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, columns, odd, least = {}, {}, 0, np.inf

        def rows(kind, i, j, w):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(i), kind, np.int32), i, j, w)], names=["kind", "i", "j", "w"])

        def done(q, best, seen):
            w, j = best
            real = j.ravel() != np.iinfo(np.int64).max
            yield rows(NEIGHBOR, np.repeat(q, k)[real], j.ravel()[real], w.ravel()[real])
            yield rows(BOUND, q, q, seen)

        for b in it:
            for at in range(b.num_rows):
                key, other, flat = (b.column(c)[at].as_buffer() for c in range(3))
                key, (q, ids, w) = key.to_pybytes(), (np.frombuffer(v, t) for v, t in ((key, np.int64), (other, np.int64), (flat, np.float64)))
                w, ids = w.reshape(len(q), len(ids)), ids.copy()
                columns[other.to_pybytes()] = ids
                low, high = w.min(), w.max()
                odd, least = odd + (not (np.isfinite(low) and np.isfinite(high))), min(least, low)
                if key not in held:
                    if len(held) >= HELD:
                        yield from done(*held.pop(next(iter(held))))
                    held[key] = q.copy(), (np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)), np.zeros(len(q))
                q, best, seen = held[key]
                seen += len(ids)
                limit = best[0][:, -1]
                if w.shape[1] > k and np.isinf(limit).any():
                    limit = np.minimum(limit, np.partition(w, k, axis=1)[:, k])  # one of these may be the row itself
                i, j = np.divmod(np.flatnonzero(w <= limit[:, None]), w.shape[1])
                real = q[i] != ids[j]
                i, j = i[real], j[real]
                if len(i):
                    _merge(best, i, ids[j], w[i, j])
        for own in held.values():
            yield from done(*own)
        for ids in columns.values():
            yield rows(PART, ids, ids, np.zeros(len(ids)))
        zero = np.zeros(1, np.int64)
        yield rows(ABSENT, zero + odd, zero, np.full(1, least))

    from tangle.plans.lineage import cut

    found = cut(tiles.mapInArrow(work, "kind int, i long, j long, w double"))
    kind = F.col("kind")
    seen = found.filter(kind == BOUND).groupBy("i").agg(F.sum("w").alias("c")).agg(F.count("*").alias("rows"), F.min("c").alias("least"), F.max("c").alias("most")).first()
    if n < 2 or seen["rows"] != n or not seen["least"] == seen["most"] == n or found.filter(kind == PART).select("i").distinct().count() != n:
        raise ValueError("distances must be square: one for each ordered pair of at least two samples")
    got = found.filter(kind == ABSENT).agg(F.sum("i").alias("odd"), F.min("w").alias("least")).first()
    if got["odd"]:
        raise ValueError("distances must be finite")
    if got["least"] < 0:
        raise ValueError("distances must not be negative")
    return _ranked(found.filter(kind == NEIGHBOR).select("i", "j", "w"), k)


def check_neighbors(table: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """A neighbour table (i, rank, j) given by the user, cut to its first k ranks: one row a sample and rank, known samples,
    no sample its own neighbour, none twice."""
    first = table.filter(F.col("rank") <= k)
    n = ids.count()
    rows = first.groupBy("i").agg(F.count("*").alias("c"), F.count_distinct("j").alias("d"), F.count_distinct("rank").alias("r"), F.count_if(F.col("i") == F.col("j")).alias("own"))
    got = rows.agg(F.count("*").alias("n"), F.count_if((F.col("c") != k) | (F.col("r") != k)).alias("short"), F.count_if(F.col("d") != F.col("c")).alias("twice"), F.sum("own").alias("own")).first()
    if got["n"] != n or got["short"]:
        raise ValueError("neighbour table must have k ranks for every sample")
    if got["own"]:
        raise ValueError("a sample is its own neighbour")
    if got["twice"]:
        raise ValueError("a neighbour is repeated")
    known = ids.select(F.col("id").alias("j"))
    if not first.join(known, "j", "left_anti").isEmpty() or not first.join(ids.select(F.col("id").alias("i")), "i", "left_anti").isEmpty():
        raise ValueError("neighbour table holds an unknown sample")
    return first.select("i", "rank", "j")
