"""Exact top-k inner products by distributed histogram selection.

Vectors are integers. For a block of queries, every partition scores its rows and returns a histogram of the scores within
a window, of which only the bins that can hold one of its own k best matter: at most k bins a query and partition. The
summed histograms tell in which bin each query's kth value lies; that bin is the next window, until it is one score wide.
A last pass returns the rows above the kth value and, of those equal to it, as many smallest ids as can be needed.

Integers are exact. Components beyond +-2^62 count as that, and so do scores beyond +-(2^62 - 1): finite floats may be larger
than any long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SCALE, K, BINS = 1024, 10, 2048
#: Queries that one pass holds: bounds what goes to the executors and the counts that come back, whatever the table's size.
BLOCK = 1024
#: The largest component and score.
MOST = 1 << 62


def integers(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component. Rows with a null or empty vector, or with a null or non-finite
    component, take no part; rows without id do. Columns may have any name; no rows give none."""
    given = F.col(C.quoted(vector_col))
    x = F.transform(given, lambda c: c.cast("double"))
    good = (F.size(given) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.least(F.greatest(F.floor(F.lit(float(scale)) * c), F.lit(-MOST)), F.lit(MOST)))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(C.quoted(id_col)).cast("long").alias("vec_id"), whole.alias("v"))


def _matrices(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, ids, which ids are null, and integer matrices of a batch (row, vec_id, v), by dimension."""
    row, ids, lists = b.column(0).to_numpy(), pc.fill_null(b.column(1), 0).to_numpy(zero_copy_only=False), b.column(2)
    without = b.column(1).is_null().to_numpy(zero_copy_only=False)
    offs = lists.offsets.to_numpy()
    n = np.diff(offs)
    flat = lists.values.to_numpy(zero_copy_only=False)
    for d in np.unique(n):
        rows = np.flatnonzero(n == d)
        yield row[rows], ids[rows], without[rows], flat[offs[rows][:, None] + np.arange(d)]


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products, by the cheapest type in which they are exact; see MOST."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if top < 2**62:
        return q @ x.T
    return np.clip(q.astype(object) @ x.T.astype(object), 1 - MOST, MOST - 1).astype(np.int64)


class Block:
    """A block of queries (numbers, own rows, vectors) and each one's window of scores, BINS bins of `width` from `low` up."""

    def __init__(self, number: np.ndarray, own: np.ndarray, vectors: list[np.ndarray], top: int, k: int):
        self.number, self.own, self.dim = number, own, np.array([len(v) for v in vectors])
        self.by = {int(d): np.flatnonzero(self.dim == d) for d in np.unique(self.dim)}
        self.vectors = {d: np.stack([vectors[i] for i in rows]) for d, rows in self.by.items()}
        self.k = k
        self.width = max(1, -(-(2 * top + 1) // BINS))
        self.low = np.full(len(number), -top, np.int64)

    def scored(self, it: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[tuple[np.ndarray, ...]]:
        """Places of queries in the block, candidate ids, which are null, and scores; a query's own row scores below all."""
        for b in it:
            for row, ids, without, x in _matrices(b):
                rows = self.by.get(x.shape[1])
                step = max(1, most // max(1, len(rows) if rows is not None else 1))
                for i in range(0, len(ids) if rows is not None else 0, step):
                    s = _scores(self.vectors[x.shape[1]], x[i : i + step])
                    s[self.own[rows][:, None] == row[None, i : i + step]] = -MOST
                    yield rows, ids[i : i + step], without[i : i + step], s


def search(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of vectors(vec_id, v) for each row of queries(vec_id, v).

    All rows of the query's dimension are candidates but its own: a query's own row is one of vectors with its id and
    vector. Other rows of its id are candidates. A query row that repeats is answered once for each of its rows, each with
    an own row of its own. Ties go to the smaller vec_id, rows without id last; fewer than k: all. A query without id is
    answered too. No vectors or no queries: no rows.

    Queries are asked in blocks of about `block`, each against all rows and each written before the next one begins, so that
    neither the driver, an executor nor the plan holds more than one.
    """
    spark = vectors.sparkSession
    vectors = C.durable(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))
    square = vectors.agg(F.max(F.expr("aggregate(v, 0D, (s, x) -> s + cast(x as double) * x)"))).first()[0] or 0.0
    top = int(min(square * (1 + 1e-9) + 1, MOST - 1))
    same = [F.col("vec_id"), F.col("v")]
    each = Window.partitionBy(*same).orderBy(F.lit(0))
    asked = queries.select("vec_id", "v", F.row_number().over(each).alias("copy"))
    one = Window.partitionBy(*same).orderBy("row")
    known = vectors.join(queries.select(F.col("vec_id").alias("asked_id")).distinct(), F.col("vec_id").eqNullSafe(F.col("asked_id")), "left_semi")
    known = known.select(F.col("vec_id").alias("own_id"), F.col("v").alias("own_v"), F.row_number().over(one).alias("own_copy"), F.col("row").alias("own"))
    meet = F.col("vec_id").eqNullSafe(F.col("own_id")) & (F.col("v") == F.col("own_v")) & (F.col("copy") == F.col("own_copy"))
    asked = C.durable(asked.join(known, meet, "left").select(F.monotonically_increasing_id().alias("number"), "vec_id", F.coalesce("own", F.lit(-1)).alias("own"), "v"))
    blocks = -(-asked.count() // block)
    dealt = C.durable(asked.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(max(1, blocks)))).repartition(max(1, min(blocks, 1 << 10)), "block").sortWithinPartitions("block"))
    folder = C.new_folder(spark)
    schema = "number long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(folder)
    for at in range(blocks):
        rows = dealt.filter(F.col("block") == at).collect()  # about `block` queries; row groups of other blocks are skipped
        if rows:
            part = Block(np.array([r["number"] for r in rows]), np.array([r["own"] for r in rows]), [np.array(r["v"], np.int64) for r in rows], top, k)
            _select(spark, vectors, part).write.mode("append").parquet(folder)
    C.drop(dealt, vectors)
    found = spark.read.schema(schema).parquet(folder)
    return found.join(asked.select("number", F.col("vec_id").alias("query_id")), "number").select("query_id", "rank", "vec_id", "score")


def _select(spark, vectors: DataFrame, block: Block) -> DataFrame:
    """(number, rank, vec_id, score) of the block's queries."""
    k = block.k
    while True:
        held = spark.sparkContext.broadcast(block)  # `block` queries

        def count(it: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            q = held.value
            bins = np.zeros((len(q.number), BINS + 1), np.int64)  # the last: above the window
            for rows, _, _, s in q.scored(it):
                at = s - q.low[rows][:, None]
                inside = at >= 0
                at = np.minimum(at // q.width, BINS)
                bins += np.bincount((rows[:, None] * (BINS + 1) + at)[inside], minlength=bins.size).reshape(bins.shape)
            higher = np.cumsum(bins[:, ::-1], axis=1)[:, ::-1] - bins
            use = np.nonzero((bins > 0) & (higher < q.k))
            yield pa.RecordBatch.from_arrays([pa.array(use[0].astype(np.int32)), pa.array(use[1].astype(np.int32)), pa.array(np.minimum(bins[use], q.k))], names=["q", "bin", "n"])

        got = vectors.mapInArrow(count, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).toPandas()  # at most k bins a query and partition, summed
        held.destroy()
        bins = np.zeros((len(block.number), BINS + 1), np.int64)
        bins[got["q"], got["bin"]] = got["n"]
        from_top = np.cumsum(bins[:, :BINS][:, ::-1], axis=1) + bins[:, BINS:]
        hit = from_top >= k
        at = np.where(hit.any(axis=1), BINS - 1 - hit.argmax(axis=1), 0)  # too few rows: the lowest bin
        block.low = block.low + at * block.width
        if block.width == 1:
            break
        block.width = max(1, -(-block.width // BINS))
    final = spark.sparkContext.broadcast(block)

    def take(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = final.value
        kept = np.zeros((0, 4), np.int64)
        for rows, ids, without, s in q.scored(it):
            r, c = np.nonzero(s >= q.low[rows][:, None])
            kept = _least(np.concatenate([kept, np.stack([rows[r], ids[c], s[r, c], without[c]], axis=1)]), q.k)
        if len(kept):
            yield pa.RecordBatch.from_arrays([pa.array(q.number[kept[:, 0]]), pa.array(kept[:, 1], mask=kept[:, 3] > 0), pa.array(kept[:, 2])], names=["number", "vec_id", "score"])

    best = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    found = vectors.mapInArrow(take, "number long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("number", "rank", "vec_id", "score")


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """The k best (query, vec_id, score[, without id]) of each query, ties to smaller ids, null ones last."""
    x = x[np.lexsort((x[:, 1], x[:, 3] if x.shape[1] > 3 else x[:, 1] * 0, -x[:, 2], x[:, 0]))]
    at = np.searchsorted(x[:, 0], x[:, 0])
    return x[np.arange(len(x)) - at < k]


def op7(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 nearest of each vector whose vec_id is divisible by 100."""
    vectors = integers(C.table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.filter("vec_id % 100 = 0"))


ORACLE_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.own <> c.own AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
