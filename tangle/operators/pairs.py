"""Euclidean distances between all pairs, block against block, with direct differences summed in feature order.

Samples are packed in blocks, a row a block. Each block meets all blocks in one task, its own first, by one shuffle of packed
rows; nothing is broadcast and the plan does not grow with the samples. What leaves a task is bounded: k rows a sample,
or the pairs themselves where pairs are asked for. A task holds two blocks at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples and bytes (as double) of a block at most, columns of a distance tile, and samples below which blocks aren't split further.
BLOCK, BLOCK_BYTES, TILE, LEAST = 1 << 15, 16 << 20, 512, 32
#: Rows of a block, at least, where only some are worked for.
CHOSEN = 1 << 9
#: Distances that are worked on at once, so that they stay in a core's cache.
CACHED = 1 << 15
#: Rows and columns of a tile of a matrix that holds each pair once: long rows take fewer, longer steps for the same distances.
LONG = (128, 4096)
CUTOFF = 1e-8


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of a against rows of b; the sum of squares runs over features in order, as a written-out expression does."""
    total, columns = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    step = max(1, CACHED // max(1, len(b)))
    d = np.empty((step, len(b)))
    for at in range(0, len(a), step):
        part, own = total[at : at + step], a[at : at + step]
        for f in range(a.shape[1]):
            now = np.subtract(own[:, f, None], columns[None, f], out=d[: len(own)])
            now *= now
            part += now
        np.sqrt(part, out=part)
    return total


def packed(df: DataFrame, size: int = BLOCK, some: str | None = None, once: bool = False) -> tuple[DataFrame, int, int]:
    """(blk, ids, x, tags) of df(id, features, longs...): blocks by hash of the id, sorted by id; how many blocks there may be, and
    how many of them, the first, hold the rows whose tag `some` is 1 (without it: all). once: as many tasks of more work as of less
    for each core, where two blocks meet in one task alone.

    There is a block a core where the samples suffice, so that small inputs keep all cores busy. All blocks meet all, so
    more would move the samples more often: a smaller size cuts what is compared at once, beyond that number of blocks.
    """
    cores, chosen = df.sparkSession.sparkContext.defaultParallelism, F.col(some) == 1 if some else F.lit(True)
    got = df.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width"), F.count_if(chosen).alias("some")).first()
    n, width = got["n"], max(1, got["width"] or 1)
    size, most = max(1, size), max(1, min(BLOCK, BLOCK_BYTES // (8 * width)))
    count = max(1, -(-n // most), min(cores, max(n // LEAST, -(-n // size))))
    if count > cores:  # all cores are busy to the end
        count = -(-count // cores) * cores
    if once and count % 2 == 0 and count == cores and n > 2 * count * LONG[1]:  # half of the tasks meet one block more, the first
        count *= 2
    first = max(1, -(-got["some"] // most), min(cores, -(-got["some"] // CHOSEN))) if some else 0
    kind = np.float32 if dict(df.dtypes)["features"] == "array<float>" else np.float64
    tags = [c for c in df.columns if c not in ("id", "features")]
    x = "features" if kind == np.float32 else F.transform("features", lambda v: v.cast("double")).alias("features")
    blk = F.pmod(F.xxhash64("id"), F.lit(count)) + first
    if some:
        blk, count = F.when(chosen, F.pmod(F.xxhash64("id"), F.lit(first))).otherwise(blk), count + first
    spread = df.select(blk.cast("int").alias("blk"), "id", x, *[F.col(c).cast("long") for c in tags])

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(now: int, held: list[list[np.ndarray]]) -> pa.RecordBatch:
            ids, x, *more = (np.concatenate(c) for c in zip(*held, strict=True))
            flat = np.stack(more).tobytes() if more else b""
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *[pa.array([v], pa.binary()) for v in (ids.tobytes(), x.astype(kind).tobytes(), flat)]], names=["blk", "ids", "x", "tags"])

        now, held = None, []
        for b in it:
            if not b.num_rows:
                continue
            blk, columns = b.column(0).to_numpy(), [b.column(1).to_numpy(), b.column(2).flatten().to_numpy().reshape(b.num_rows, -1), *[b.column(3 + k).to_numpy() for k in range(len(tags))]]
            cut = np.flatnonzero(np.concatenate([[True], blk[1:] != blk[:-1]]))
            for i, j in zip(cut, [*cut[1:], len(blk)], strict=True):
                if blk[i] != now and held:
                    yield rows(now, held)
                    held = []
                now = int(blk[i])
                held.append([c[i:j] for c in columns])
        if held:
            yield rows(now, held)

    own = spread.repartition(min(count, 1 << 12), "blk").sortWithinPartitions("blk", "id")
    return own.mapInArrow(pack, "blk int, ids binary, x binary, tags binary"), count, first if some else count


#: What a task makes of a block (number, ids, rows, tags by name) and the blocks it meets, itself first: columns, again and again.
Work = Callable[[tuple, Iterator[tuple]], Iterator[tuple]]


def against_blocks(df: DataFrame, work: Work, schema: str, size: int = BLOCK, *, once: bool = False, some: str | None = None) -> DataFrame:
    """What work makes of every block of df(id, features, longs...) and all blocks; once: two blocks meet in one of their tasks
    alone; some: a tag, only blocks of rows where it is 1 are worked for, and the samples move once for each of these."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BLOCK_BYTES))
    blocks, count, tasks = packed(df, size, some, once) if some or once else packed(df, size)
    names, tags = [c.split()[0] for c in schema.split(", ")], [c for c in df.columns if c not in ("id", "features")]
    kind = np.float32 if dict(df.dtypes)["features"] == "array<float>" else np.float64

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple]:
            for b in it:
                for k in range(b.num_rows):
                    ids, x, more = (np.frombuffer(b.column(c)[k].as_buffer(), t) for c, t in ((2, np.int64), (3, kind), (4, np.int64)))
                    yield b.column(0)[k].as_py(), (b.column(1)[k].as_py(), ids, x.astype(np.float64).reshape(len(ids), -1), dict(zip(tags, more.reshape(len(tags), len(ids)), strict=True)))

        for to, met in itertools.groupby(read(), key=lambda r: r[0]):
            met = (m for _, m in met)
            own = next(met)
            if own[0] == to:  # else no sample has this block's number
                for columns in work(own, itertools.chain([own], met)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    dealt = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("to"), "blk", "ids", "x", "tags")
    if once:
        ahead = 2 * F.pmod(F.col("blk") - F.col("to"), F.lit(count))
        dealt = dealt.filter((ahead < count) | (ahead == count) & (F.col("to") < F.col("blk")))
    return dealt.repartitionById(tasks, "to").sortWithinPartitions("to", F.col("blk") != F.col("to"), "blk").mapInArrow(run, schema)


def pairwise(df: DataFrame, *, directed: bool = True, size: int = BLOCK) -> DataFrame:
    """(i, j, w) of all ordered pairs, i = j included; directed=False: (lo, hi, w) with lo < hi. The output is quadratic."""

    def work(own, others):
        number, q, qx, _ = own
        rows = max(1, (1 << 20) // TILE)
        for other, ids, x, _ in others:
            for at, k in itertools.product(range(0, len(q), rows), range(0, len(ids), TILE)):
                mine, near = q[at : at + rows], ids[k : k + TILE]
                w = distances(qx[at : at + rows], x[k : k + TILE]).ravel()
                i, j = np.repeat(mine, len(near)), np.tile(near, len(mine))
                if directed:
                    yield i, j, w
                elif other != number:
                    yield np.minimum(i, j), np.maximum(i, j), w
                elif (keep := i < j).any():
                    yield i[keep], j[keep], w[keep]

    return against_blocks(df.select("id", "features"), work, "i long, j long, w double" if directed else "lo long, hi long, w double", size, once=not directed)


def matrix(df: DataFrame, *, directed: bool = True, size: int = BLOCK) -> DataFrame:
    """(i, j, w): the matrix of all ordered pairs in tiles, ids (long) and distances (double, row by row) as bytes; directed=False:
    each pair at least once, twice only within a block about its diagonal."""

    rows, columns = (TILE, TILE) if directed else LONG

    def work(own, others):
        number, q, qx, _ = own
        for other, ids, x, _ in others:
            for a, c in itertools.product(range(0, len(q), rows), range(0, len(ids), columns)):
                if not directed and other == number and c + columns <= a:
                    continue
                mine, near = slice(a, a + rows), slice(c, c + columns)
                yield [q[mine].tobytes()], [ids[near].tobytes()], [distances(qx[mine], x[near]).tobytes()]

    return against_blocks(df.select("id", "features"), work, "i binary, j binary, w binary", size, once=not directed)


def check_precomputed(pairs: DataFrame, n: int) -> DataFrame:
    """A distance relation (i, j, w) given by the user: square, no negative, null or non-finite distance."""
    got = pairs.agg(F.count("*").alias("rows"), F.count("w").alias("given"), F.min("w").alias("least"), F.count_if(F.isnan("w") | (F.abs("w") == float("inf"))).alias("odd"), F.count_distinct("i").alias("i"), F.count_distinct("j").alias("j")).first()
    if n < 2 or got["rows"] != n * n or got["i"] != n or got["j"] != n:
        raise ValueError("distances must be square: one for each ordered pair of at least two samples")
    if got["given"] < got["rows"] or got["odd"]:
        raise ValueError("distances must be finite")
    if got["least"] < 0:
        raise ValueError("distances must not be negative")
    return pairs
