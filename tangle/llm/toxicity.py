"""Toxicity: cumulative-link ordinal regression on sparse text features.

Features are hashed units (runs of letters) and their prefixes, each counted once a document. One weight vector serves all
grades; ordered thresholds turn its sum into P(grade > k), and their sum is the expected severity.

Labels say toxic or not. Grades are derived from them: units and prefixes that occur in toxic documents and (nearly) never
in others are marks; a toxic document's grade is 1, 2 or 3 by how many marks it holds, cut at the terciles over the
sample's toxic documents. A document that isn't toxic has grade 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .units import units

ROWS, PREFIXES = 1 << 18, (4, 5, 6)
#: Labelled rows that the fit may read; at most half of them toxic.
SAMPLE = 12_000
GRADES = 4
EPOCHS, RATE, DECAY = 60, 0.5, 1e-5
#: Features with a weight: log ratio of their shares in toxic and other documents of the sample, at least so many deviations
#: from 0. All others have none, so that long texts don't gather noise.
DEVIATIONS = 3.5
#: A mark: in at least MARK_DOCS toxic documents of the sample, and a share of at least MARK_SHARE of its documents toxic.
MARK_DOCS, MARK_SHARE = 5, 0.95
SEED = 13


def features(col: pa.Array, rows: int = ROWS, prefixes=PREFIXES) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct features, sorted, and features before each document (n + 1 values)."""
    buf, st, en, first = units(col)
    letters = np.zeros(256, bool)
    letters[97:123] = letters[128:] = True
    word = letters[buf[st]] if len(st) else np.zeros(0, bool)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[word]
    st, en = st[word], en[word]
    found = [(doc << 32) | (C.xxh64_spans(buf, st, en, SEED) % np.uint64(rows)).astype(np.int64)]
    if len(st):
        # a prefix counts code points: places of first bytes
        point = np.flatnonzero((buf & 0xC0) != 0x80)
        at = np.searchsorted(point, st)
        for n in prefixes:
            end = np.append(point, len(buf))[np.minimum(at + n, len(point))]
            long = end < en
            found.append((doc[long] << 32) | (C.xxh64_spans(buf, st[long], end[long], SEED + n) % np.uint64(rows)).astype(np.int64))
    key = np.sort(np.concatenate(found))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key & 0xFFFFFFFF, np.searchsorted(key, np.arange(len(first)) << 32)


class Ordinal:
    """P(grade > k) = 1 / (1 + exp(threshold_k - x w)), thresholds ascending, weights shared."""

    def __init__(self, x: np.ndarray, at: np.ndarray, grade: np.ndarray, rows: int = ROWS, share: float | None = None, seed: int = SEED):
        """share: the share of toxic documents in the population, where the sample's differs; it moves the first threshold."""
        n, top = len(grade), GRADES - 1
        self.w = np.zeros(rows)
        rate = np.array([(grade > k).mean() for k in range(top)]).clip(1e-3, 1 - 1e-3)
        base = -np.log(rate / (1 - rate))
        step = np.log(np.maximum(np.diff(base), 0.05))  # thresholds: base and positive steps, so that they stay in order
        theta = np.concatenate([base[:1], step])
        square, square_t = np.full(rows, 1e-6), np.full(top, 1e-6)
        r = np.random.default_rng(seed)
        chosen = self._chosen(x, at, grade, rows)
        use = chosen[x]
        at = np.concatenate([[0], np.cumsum(use)])[at]
        x = x[use]
        size = np.diff(at)
        for _ in range(EPOCHS):
            order = r.permutation(n)
            for a in range(0, n, 256):
                own = np.sort(order[a : a + 256])
                flat = np.concatenate([x[at[i] : at[i + 1]] for i in own])
                doc = np.repeat(np.arange(len(own)), size[own])
                s = np.bincount(doc, self.w[flat], len(own))
                cut = np.concatenate([theta[:1], theta[:1] + np.cumsum(np.exp(theta[1:]))])
                g_s, g_c = self._gradient(s, cut, grade[own])
                used, inv = np.unique(flat, return_inverse=True)
                g = np.bincount(inv, g_s[doc], len(used)) / len(own) + DECAY * self.w[used]
                square[used] += g * g
                self.w[used] -= RATE * g / np.sqrt(square[used])
                g_t = np.concatenate([[g_c.sum()], [g_c[k:].sum() * np.exp(theta[k]) for k in range(1, top)]]) / len(own)
                square_t += g_t * g_t
                theta -= RATE * g_t / np.sqrt(square_t)
        self.cut = np.concatenate([theta[:1], theta[:1] + np.cumsum(np.exp(theta[1:]))])
        if share and 0 < share < 1:
            odds = rate[0] / (1 - rate[0])
            self.cut = self.cut + np.log(odds) - np.log(share / (1 - share))

    @staticmethod
    def _chosen(x: np.ndarray, at: np.ndarray, grade: np.ndarray, rows: int) -> np.ndarray:
        """Which features tell toxic documents from others."""
        toxic = (grade > 0)[np.repeat(np.arange(len(grade)), np.diff(at))]
        a, b = (np.bincount(x[toxic == k], minlength=rows) + 0.5 for k in (True, False))
        ratio = np.log(a / max(1, (grade > 0).sum())) - np.log(b / max(1, (grade == 0).sum()))
        return np.abs(ratio) >= DEVIATIONS * np.sqrt(1 / a + 1 / b)

    @staticmethod
    def _gradient(s: np.ndarray, cut: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the negative log likelihood of the grades, by sum and by threshold."""
        p = 1 / (1 + np.exp(np.clip(cut[None, :] - s[:, None], -30, 30)))
        full = np.concatenate([np.ones((len(s), 1)), p, np.zeros((len(s), 1))], axis=1)  # P(grade >= k)
        d = np.concatenate([np.zeros((len(s), 1)), p * (1 - p), np.zeros((len(s), 1))], axis=1)
        rows = np.arange(len(s))
        like = np.maximum(full[rows, grade] - full[rows, grade + 1], 1e-9)
        up, down = d[rows, grade] / like, d[rows, grade + 1] / like
        g_c = np.zeros(len(cut))
        np.add.at(g_c, (grade - 1)[grade > 0], up[grade > 0])
        np.add.at(g_c, grade[grade < len(cut)], -down[grade < len(cut)])
        return -(up - down), g_c

    def exceed(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """P(grade > k) of every document, a column for each k."""
        s = np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(at)), self.w[x], len(at) - 1)
        return 1 / (1 + np.exp(np.clip(self.cut[None, :] - s[:, None], -30, 30)))


def grades(x: np.ndarray, at: np.ndarray, toxic: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Derived grades of labelled documents."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(at))
    bad, all_ = np.bincount(x, toxic[doc], rows), np.bincount(x, minlength=rows)
    mark = (bad >= MARK_DOCS) & (bad >= MARK_SHARE * all_)
    held = np.bincount(doc, mark[x], len(toxic))
    cuts = np.quantile(held[toxic > 0], [1 / 3, 2 / 3]) if (toxic > 0).any() else [0, 0]
    return np.where(toxic > 0, 1 + (held > cuts[0]) + (held > cuts[1]), 0).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """From at most `sample` labelled rows, half of them toxic at most, by hash of doc_id.

    An id labelled more than once is toxic if any label says so; null ids and labels teach nothing. Rows that repeat a
    labelled id teach once, by the least of their lists of features. Without labelled rows the model is fitted to one empty
    text of grade 0.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = C.durable(known.withColumn("h", F.xxhash64(F.lit(SEED), "doc_id")))
    share = known.agg(F.avg((F.col("toxic") > 0).cast("int"))).first()[0]
    half = lambda where: known.filter(where).orderBy("h", "doc_id").limit(sample // 2).select("doc_id", "toxic")
    chosen = half("toxic > 0").unionByName(half("toxic = 0"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.batches(it):
            x, at = features(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(np.int32)))], names=["doc_id", "toxic", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # `sample` rows
    got = rows.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, "doc_id long, toxic int, x array<int>")
    got = got.groupBy("doc_id").agg(F.min(F.struct("x", "toxic")).alias("row")).select("doc_id", "row.*").toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return Ordinal(np.zeros(0, np.int64), np.zeros(2, np.int64), np.zeros(1, np.int64))
    lists = got.column("x").combine_chunks() if isinstance(got.column("x"), pa.ChunkedArray) else got.column("x")
    at, x = lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy().astype(np.int64)
    return Ordinal(x, at - at[0], grades(x, at - at[0], got.column("toxic").to_numpy()), share=share)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic) of every row of docs, repeats included.

    severity is the expected grade, 0 to 3; grade the median one; toxic says that P(grade > 0) is at least 0.5. Null text
    scores as empty text does; very long texts are read whole. No rows give no rows; columns other than doc_id and text
    don't matter.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.batches(it, C.BATCH_BYTES // 2):
            p = held.value.exceed(*features(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(axis=1).astype(np.int32)), pa.array(p[:, 0] >= 0.5)], names=["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def op2(spark, sf_dir: str) -> DataFrame:
    """doc_id, severity, p_toxic, grade, toxic of every document."""
    return score(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
