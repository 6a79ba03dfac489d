"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated scores.

Random indexing gives every unit a sparse ternary index vector; a unit's context vector is the sum of its neighbours' index
vectors over the whole corpus, counted in integers. Documents pool their units' context vectors (mean and spread) and index
vectors (whose mean is long where few units make the text) and a few counts. The network learns from a bounded sample of
labelled rows; a further part of the sample sets the temperature of its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .units import units

#: Rows of the unit table (units are hashed into it), dimensions, nonzero entries of an index vector.
ROWS, DIM, NONZERO = 1 << 14, 48, 4
#: Labelled rows that the fit may read.
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 3e-3, 1e-4
CUT = 0.7
SLICES = 64
SEED = 11


def index_vectors(rows: int = ROWS, dim: int = DIM, nonzero: int = NONZERO, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's nonzero entries."""
    r = np.random.default_rng(seed)
    places = np.argsort(r.random((rows, dim)), axis=1)[:, :nonzero]
    signs = np.where(np.arange(nonzero) % 2, -1, 1) * np.ones((rows, 1), np.int64)
    return places.astype(np.int64), signs


def _rows(col: pa.Array, rows: int) -> tuple[np.ndarray, np.ndarray]:
    buf, st, en, first = units(col)
    return (C.xxh64_spans(buf, st, en) % np.uint64(rows)).astype(np.int64), first


def context_table(docs: DataFrame, rows: int = ROWS, dim: int = DIM) -> np.ndarray:
    """The context vectors of all rows, from every text of docs(text): a table of fixed size.

    Each task adds up its own table; tables travel as slices, which are added up as they stream in.
    """

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors(rows, dim)
        table = np.zeros(rows * dim, np.int64)
        for b in C.batches(it):
            u, first = _rows(b.column(0), rows)
            inner = np.ones(len(u), bool)
            inner[first[1:][first[1:] > 0] - 1] = False  # the last unit of a document has no next one
            left = np.flatnonzero(inner)
            for x, y in ((u[left], u[left + 1]), (u[left + 1], u[left])) if len(left) else ():
                for k in range(places.shape[1]):
                    table += signs[0, k] * np.bincount(x * dim + places[y, k], minlength=rows * dim)
        if table.any():
            parts = table.astype(np.int32 if np.abs(table).max() < 2**31 else np.int64).reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "part"])

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in it:
            for k, p in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = p.as_buffer()
                x = np.frombuffer(raw, np.int32 if raw.size == 4 * rows * dim // SLICES else np.int64).astype(np.int64)
                held[k] = held[k] + x if k in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["slice", "part"])

    parts = docs.select("text").mapInArrow(count, "slice int, part binary")
    if (many := C.shards_for(docs, 128 << 20)) > SLICES:  # a tree: tables of as many tasks meet in groups first
        parts = parts.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(int(many**0.5)))).repartition(int(many**0.5) * 4, "slice", "group")
        parts = parts.select("slice", "part").mapInArrow(add, "slice int, part binary")
    got = parts.repartition(min(SLICES, 16), "slice").mapInArrow(add, "slice int, part binary").collect()
    out = np.zeros((SLICES, rows * dim // SLICES), np.int64)
    for r in got:  # at most one a slice
        out[r["slice"]] += np.frombuffer(r["part"], np.int64)
    return out.reshape(rows, dim)


def word_vectors(context: np.ndarray) -> np.ndarray:
    """Unit context vectors, with each unit's own index vector beside them; rows never seen have no context."""
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    places, signs = index_vectors(*context.shape)
    own = np.zeros(context.shape)
    np.put_along_axis(own, places, signs / np.sqrt(places.shape[1]), axis=1)
    return np.concatenate([context / np.maximum(norm, 1e-9), own], axis=1).astype(np.float32)


def pooled(col: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row of features for each text; an empty one's are 0."""
    u, first = _rows(col, len(vectors))
    n = np.diff(first)
    d = vectors.shape[1] // 2
    out = np.zeros((len(n), 3 * d + 6), np.float32)
    if not len(u):
        return out
    doc = np.repeat(np.arange(len(n)), n)
    total, square = np.zeros((len(n), 2 * d)), np.zeros((len(n), d))
    for a in range(0, len(u), 1 << 16):  # bounded memory, however long a document is
        v, own = vectors[u[a : a + (1 << 16)]], doc[a : a + (1 << 16)]
        cut = np.flatnonzero(np.diff(own, prepend=-1))
        total[own[cut]] += np.add.reduceat(v, cut, axis=0)
        v = v[:, :d]
        square[own[cut]] += np.add.reduceat(v * v, cut, axis=0)
    size = np.maximum(n, 1)[:, None]
    mean = total / size
    out[:, : 2 * d] = mean
    out[:, 2 * d : 3 * d] = np.sqrt(np.maximum(square / size - mean[:, :d] ** 2, 0))

    def share(key: np.ndarray) -> np.ndarray:
        """Distinct keys of each document, as a share of its units."""
        k = np.sort((doc << 32) | key)
        return np.bincount(k[np.flatnonzero(np.diff(k, prepend=-1))] >> 32, minlength=len(n)) / np.maximum(n, 1)

    nxt = np.append(u[1:], 0)
    after = np.append(u[2:], [0, 0])[: len(u)]
    out[:, 3 * d] = np.log1p(n) / 8
    out[:, 3 * d + 1] = share(u)
    out[:, 3 * d + 2] = share((u * len(vectors) + nxt) & 0xFFFFFFFF)
    out[:, 3 * d + 3] = share(((u * len(vectors) + nxt) * 0x9E3779B1 + after) & 0xFFFFFFFF)
    out[:, 3 * d + 4] = np.bincount(doc, u == nxt, len(n)) / np.maximum(n, 1)
    out[:, 3 * d + 5] = np.linalg.norm(out[:, d : 2 * d], axis=1)
    out[n == 0] = 0
    return out


class Network:
    """Features, standardised; tanh layer; logit over temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, seed: int = SEED):
        r = np.random.default_rng(seed)
        train = ~calibrate if (~calibrate).any() else np.ones(len(y), bool)
        self.mean, self.scale = x[train].mean(0), x[train].std(0) + 1e-3
        z = self._scaled(x)
        self.w = [r.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)]
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        zt, yt = z[train], y[train]
        for _ in range(EPOCHS):
            order = r.permutation(len(yt))
            for a in range(0, len(yt), BATCH):
                rows = order[a : a + BATCH]
                h = np.tanh(zt[rows] @ self.w[0] + self.w[1])
                p = 1 / (1 + np.exp(-(h @ self.w[2] + self.w[3])))
                g = (p - yt[rows][:, None]) / len(rows)
                gh = g @ self.w[2].T * (1 - h * h)
                t += 1
                for k, grad in enumerate((zt[rows].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    self.w[k] = self.w[k] * (1 - RATE * DECAY) - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        held = calibrate if calibrate.any() else train
        logit = self._logit(z[held])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
        loss = [np.logaddexp(0, np.where(y[held] > 0, -logit, logit) / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logit(self, z: np.ndarray) -> np.ndarray:
        return (np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3])[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self._logit(self._scaled(x)) / self.temperature))


def fold(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 4; 0 for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = SAMPLE) -> Network:
    """The network, from at most `sample` labelled rows whose fold isn't 2, by hash of doc_id; fold 3 sets the temperature.

    An id labelled more than once takes its least label; null ids and labels teach nothing. Rows that repeat a labelled id
    teach once, by the least of their features. With no labelled row at all the network is fitted to one empty text of
    label 1: every score is high.
    """
    spark = docs.sparkSession
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y")).filter(fold("doc_id") != 2)
    known = known.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(sample)
    held = spark.sparkContext.broadcast(vectors)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.batches(it):
            x = pooled(b.column(2), held.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "fold", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")  # `sample` rows
    rows = rows.select("doc_id", F.col("y").cast("int").alias("y"), "text", fold("doc_id").cast("int").alias("fold"))
    got = rows.mapInArrow(run, "doc_id long, y int, fold int, x binary").groupBy("doc_id").agg(F.min(F.struct("x", "y", "fold")).alias("row"))
    got = got.select("doc_id", "row.*").toPandas().sort_values("doc_id", kind="stable")  # `sample` rows
    if not len(got):
        return Network(np.zeros((1, 3 * (vectors.shape[1] // 2) + 6)), np.ones(1), np.zeros(1, bool))
    x = np.stack([np.frombuffer(r, np.float32) for r in got["x"]]).astype(np.float64)
    return Network(x, (got["y"].to_numpy() > 0).astype(np.float64), got["fold"].to_numpy() == 3)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, repeats included. Null text scores as empty text does; very
    long texts are read whole. No rows give no rows; columns other than doc_id and text don't matter."""
    vectors = word_vectors(context_table(docs))
    network = fit(docs, labels, vectors, sample)
    held = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.batches(it):
            vectors, network = held.value
            score = network.score(pooled(b.column(2), vectors).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id") == 2).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op6(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return classify(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
