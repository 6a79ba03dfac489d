"""Minimum spanning forest under the total order (distance, smaller id, larger id), and the score N1.

Edges no longer than the cutoff are absent. Each part of the edges yields its own forest under the same order, which holds
every edge of the whole forest among them (cycle property).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pairs as P
from .tiles import _hits, _none, _reduced, edges_of, relations

#: Edges that one task may finish alone (24 bytes each); beyond, rounds of joins do.
ALONE = 1_000_000

#: Edges that a task gathers before it reduces them to a forest again, and that it may keep.
GATHER, KEEP = 1 << 20, 1_000_000
EDGES = "lo long, hi long, w double"

TIE_POLICY = "(distance, smaller id, larger id)"


class _Reach:
    """For each node a weight at most needed on the way to one root within a forest; edges above both ends' are no forest edges."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, w: np.ndarray, rounds: int = 300):
        self.nodes, inv = np.unique(np.concatenate([lo, hi]), return_inverse=True)
        a, b = inv[: len(lo)], inv[len(lo) :]
        self.need = np.full(len(self.nodes) + 1, np.inf)  # the last: unknown nodes
        self.need[a[np.argmin(w)]] = 0.0
        for _ in range(rounds):  # what is not reached by then stays open
            before = np.isinf(self.need).sum()
            np.minimum.at(self.need, a, np.maximum(self.need[b], w))
            np.minimum.at(self.need, b, np.maximum(self.need[a], w))
            if np.isinf(self.need).sum() == before:
                break
        first, last = int(self.nodes[0]), int(self.nodes[-1])
        self.table = None
        if last - first < 1 << 24:
            self.table = np.full(last - first + 1, np.inf)
            self.table[self.nodes - first] = self.need[:-1]

    def of(self, ids: np.ndarray) -> np.ndarray:
        if self.table is not None:
            at = ids - self.nodes[0]
            known = (at >= 0) & (at < len(self.table))
            return np.where(known, self.table[np.where(known, at, 0)], np.inf)
        at = np.searchsorted(self.nodes, ids)
        at[self.nodes[np.minimum(at, len(self.nodes) - 1)] != ids] = len(self.nodes)
        return self.need[at]


def _edges(lo: np.ndarray, hi: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (lo, hi, w)], names=["lo", "hi", "w"])


def reduced(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a task's edges (lo, hi, w); several, if it would keep too many."""
    held: list[tuple[np.ndarray, ...]] = []
    new, reach = 0, None

    for b in it:
        lo, hi, w = (b.column(k).to_numpy() for k in range(3))
        if reach:
            keep = w <= np.maximum(reach.of(lo), reach.of(hi))
            lo, hi, w = lo[keep], hi[keep], w[keep]
        held.append((lo, hi, w))
        new += len(lo)
        if new > GATHER:
            held, new = _reduced(held), 0
            if len(held[0][0]) > KEEP:
                yield _edges(*held[0])
                held, reach = [], None
            else:
                reach = _Reach(*held[0])
    if sum(len(x[0]) for x in held):
        yield _edges(*_reduced(held)[0])


def _reduced_tiles(cutoff: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same of a task's tiles (i, j, w) of a matrix of distances: most are dropped where they stand in their tile.

    What is needed on the way to the root is kept for each set of ids that is a tile's rows or columns, and lessened by the tile's own
    distances before these are judged: a distance that lessened it is not above it, so no edge is dropped for a way by itself.
    """

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        need: dict[bytes, np.ndarray] = {}
        new, reach = 0, None
        for b in it:
            for k in range(b.num_rows):
                rows, columns, flat = (b.column(c)[k].as_buffer() for c in range(3))
                rows, columns, flat = rows.to_pybytes(), columns.to_pybytes(), np.frombuffer(flat, np.float64)
                if not len(flat):
                    continue
                i, j = np.frombuffer(rows, np.int64), np.frombuffer(columns, np.int64)
                w = flat.reshape(len(i), len(j))
                if not (w.min() > cutoff and w.max() < np.inf):
                    w = np.where(_none(w, cutoff), np.inf, w)
                if reach:
                    up, left = (need[c] if c in need else reach.of(own) for c, own in ((rows, i), (columns, j)))
                    left = np.minimum(left, np.maximum(w, up[:, None]).min(axis=0))
                    up = np.minimum(up, np.maximum(w, left).min(axis=1))
                    need[columns], need[rows] = left, up
                    at, to = _hits(w <= np.maximum(up[:, None], left))
                else:
                    at, to = np.nonzero(w < np.inf)
                x, y, v = i[at], j[to], w[at, to]
                real = (v < np.inf) & (x != y)
                x, y, v = x[real], y[real], v[real]
                held.append((np.minimum(x, y), np.maximum(x, y), v))
                new += len(v)
                if new > (GATHER if reach else 0):
                    held, new = _reduced(held), 0
                    need.clear()
                    if len(held[0][0]) > KEEP:
                        yield _edges(*held[0])
                        held, reach = [], None
                    else:
                        reach = _Reach(*held[0])
        if sum(len(e[0]) for e in held):
            yield _edges(*_reduced(held)[0])

    return work


def _checkpoint(df: DataFrame) -> DataFrame:
    from tangle.plans.lineage import cut

    return cut(df)


def candidate_edges(scaled: DataFrame, cutoff: float = P.CUTOFF, size: int = P.BLOCK) -> DataFrame:
    """(lo, hi, w): edges that hold the forest of scaled(id, features)."""
    return edges_of(relations(scaled, cutoff=cutoff, size=size))


def check_cutoff(cutoff: float) -> float:
    if not np.isfinite(cutoff) or cutoff < 0:
        raise ValueError("edge_cutoff must be finite and not negative")
    return float(cutoff)


def spanning_forest(edges: DataFrame, cutoff: float = P.CUTOFF, alone: int = ALONE) -> DataFrame:
    """(lo, hi, w): the forest of edges(lo, hi, w), lo < hi. Tasks reduce their edges to a forest, then those of four tasks
    again; up to `alone` edges are finished in one task, more by Boruvka rounds of distributed joins.

    A round picks each component's least crossing edge; components then merge by hooking to smaller roots and pointer
    jumping. Each round is cut from its lineage; crossing edges at least halve the components.
    """
    edges = edges.filter((F.col("w") > check_cutoff(cutoff)) & (F.col("w") < float("inf"))).select(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.col("w").cast("double").alias("w"))
    edges = _checkpoint(edges.mapInArrow(reduced, EDGES))
    count, parts = edges.count(), edges.rdd.getNumPartitions()
    while count > alone and parts > 1:
        parts, before = -(-parts // 4), count
        edges = _checkpoint(edges.coalesce(parts).mapInArrow(reduced, EDGES))
        count = edges.count()
        if count > 0.7 * before:
            break
    if count <= alone:
        return edges.coalesce(1).mapInArrow(reduced, EDGES)
    edges = edges.distinct()
    crossing = edges.select("lo", "hi", "w", F.col("lo").alias("a"), F.col("hi").alias("b"))
    found = None
    while True:
        ends = crossing.select(F.explode(F.array("a", "b")).alias("c"), F.struct("w", "lo", "hi", "a", "b").alias("e"))
        best = _checkpoint(ends.groupBy("c").agg(F.min("e").alias("e")).select("c", "e.*"))
        if best.isEmpty():
            break
        picked = best.select("lo", "hi", "w").distinct()
        found = picked if found is None else found.unionByName(picked)
        # each component points across its least edge; the only cycles are pairs that share one, whose smaller end is the root
        up = best.select("c", F.when(F.col("a") == F.col("c"), F.col("b")).otherwise(F.col("a")).alias("p"))
        back = up.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        up = _checkpoint(up.join(back, "p").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")))
        while True:
            far = up.join(up.select(F.col("c").alias("p"), F.col("p").alias("pp")), "p")
            moved = _checkpoint(far.select("c", "p", "pp"))
            up = moved.select("c", F.col("pp").alias("p"))
            if moved.filter("p <> pp").isEmpty():
                break
        crossing = crossing.join(up.select(F.col("c").alias("a"), F.col("p").alias("ra")), "a").join(up.select(F.col("c").alias("b"), F.col("p").alias("rb")), "b")
        crossing = _checkpoint(crossing.filter("ra <> rb").select("lo", "hi", "w", F.col("ra").alias("a"), F.col("rb").alias("b")))
    return found if found is not None else edges.limit(0)


def matrix_forest(tiles: DataFrame, cutoff: float = P.CUTOFF, alone: int = ALONE) -> DataFrame:
    """(lo, hi, w): the forest of a matrix of distances given in tiles (i, j, w) of bytes, as pairs.matrix has them, each pair
    once or both ways; of a pair given twice the shorter distance counts.

    All distances are read, by the tasks that have them; what leaves a task is a forest of its tiles.
    """
    return spanning_forest(tiles.mapInArrow(_reduced_tiles(check_cutoff(cutoff)), EDGES), cutoff, alone)


def forest(scaled: DataFrame, cutoff: float = P.CUTOFF, size: int = P.BLOCK) -> DataFrame:
    """The forest of scaled(id, features)."""
    return spanning_forest(candidate_edges(scaled, check_cutoff(cutoff), size), cutoff)


def boundary(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label_name) of samples at an end of an edge between classes; labels(id, label_name, y)."""
    lo = labels.select(F.col("id").alias("lo"), "label_name", F.col("y").alias("y_lo"))
    hi = labels.select(F.col("id").alias("hi"), "label_name", F.col("y").alias("y_hi"))
    cross = edges.select("lo", "hi").join(lo, "lo").join(hi, ["hi", "label_name"]).filter("y_lo <> y_hi")
    return cross.select("label_name", F.explode(F.array("lo", "hi")).alias("id")).distinct()


def n1_scores(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label_name, boundary, n, value): the share of samples at a class boundary, isolated ones included."""
    marked = boundary(edges, labels).withColumn("hit", F.lit(1))
    return labels.join(marked, ["id", "label_name"], "left").groupBy("label_name").agg(F.count("hit").alias("boundary"), F.count("*").alias("n"), (F.count("hit") / F.count("*")).alias("value"))
