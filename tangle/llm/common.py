"""What the operators share: byte-level word spans, vectorised XXH64, durable tables and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of one Arrow batch handed to Python; bounds a worker's memory whatever the rows' lengths.
BATCH_BYTES = 4 << 20

#: A word, wherever a contract says so: a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True


def tune(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a folder of one's own where that is unset (tests on one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tangle-checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: What this process has written to the shared folder and not deleted yet: plain path -> (session, path, table of the catalog or None).
_written: dict[str, tuple[SparkSession, str, str | None]] = {}


def _plain(path: str) -> str:
    return path.removeprefix("file:").lstrip("/")


def new_folder(spark: SparkSession, table: str | None = None) -> str:
    """A folder of one's own in the shared one, still to be written; see discard()."""
    path = f"{shared_dir(spark).rstrip('/')}/tangle-{uuid.uuid4().hex}"
    _written[_plain(path)] = (spark, path, table)
    return path


def durable(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df, written once to the shared folder and read again: lineage is cut and lost executors cost nothing."""
    path = new_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, parts: int) -> DataFrame:
    """df, written once to the shared folder in `parts` buckets of `key`: joins on it don't move these rows again.

    Give a df of whose tasks each holds few buckets, so that there are few files.
    """
    spark, name = df.sparkSession, f"tangle_{uuid.uuid4().hex}"
    path = new_folder(spark, name)
    df.write.bucketBy(parts, key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def written() -> set[str]:
    """What durable() and bucketed() have written and nobody has deleted."""
    return set(_written)


def discard(folders) -> None:
    """Deletes such folders. DataFrames that read them are of no use afterwards."""
    for folder in [x for x in folders if x in _written]:
        spark, path, name = _written.pop(folder)
        if spark.sparkContext._jsc is None:  # the session has been stopped
            continue
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sources(df: DataFrame) -> set[str] | None:
    """The root folders that df reads; None if it reads from anything but files and literal rows."""
    found, leaves = set(), df._jdf.queryExecution().analyzed().collectLeaves()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            found |= {_plain(roots.apply(i).toString()) for i in range(roots.size())}
        elif kind not in ("LocalRelation", "OneRowRelation", "Range", "EmptyRelation"):
            return None
    return found


def drop(*frames: DataFrame) -> None:
    """Deletes the folders of what durable() or bucketed() have returned, once nothing will read them any more."""
    for df in frames:
        discard(sources(df) or ())


@atexit.register
def _discard_all() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        discard(list(_written))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame, *without: str) -> list[Column]:
    """df's columns by quoted names, which may hold dots."""
    return [F.col(quoted(c)) for c in df.columns if c not in without]


def free(name: str, df: DataFrame) -> str:
    """name, or with as many underscores before it as df's columns leave it free."""
    while name in df.columns:
        name = f"_{name}"
    return name


def schema_of(df: DataFrame, **more) -> StructType:
    """df's schema and further fields, for functions over Arrow batches: as types, since names may hold any character."""
    return StructType([*df.schema.fields, *[StructField(k, t) for k, t in more.items()]])


#: A key is hot if more than one in HOT_SHARE of all rows have it, and HOT_LEAST at least: there can be HOT_SHARE such keys at most.
HOT_SHARE, HOT_LEAST, SALTS = 1000, 10_000, 64


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], count: str, how: str = "inner", least: int | None = None) -> DataFrame:
    """rows joined with table(keys, count, ...), which has one row a key; `count` tells how many of rows have the key.

    Rows of hot keys are dealt by a salt as well and meet copies of the key's row of the table. The list of hot keys has at
    most HOT_SHARE entries whatever the data, so it is broadcast; it must be cheap to compute, as table is read twice.
    """
    limit = F.greatest(F.sum(count) / HOT_SHARE, F.lit(float(HOT_LEAST if least is None else least)))
    limit = table.agg(limit.alias("limit")).first()["limit"]
    hot = F.col(count) > F.lit(limit if limit is not None else 0.0)
    few = table.filter(hot).select(*[F.col(k).alias(f"_hot_{k}") for k in keys]).limit(HOT_SHARE + 1).withColumn("_hot", F.lit(True))
    on = [F.col(k) == F.col(f"_hot_{k}") for k in keys]
    for x in on[1:]:
        on[0] = on[0] & x
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*columns(rows), F.spark_partition_id()), F.lit(SALTS)).cast("int")).otherwise(0)
    left = rows.join(F.broadcast(few), on[0], "left").withColumn("_salt", salt).drop("_hot", *[f"_hot_{k}" for k in keys])
    right = table.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size of df's input, 0 where it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0


def shards_for(df: DataFrame, bytes_each: int) -> int:
    """How many shards df's input makes at bytes_each, never under the session's parallelism."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return max(least, -(-plan_bytes(df) // bytes_each))


# --- bytes and words ---------------------------------------------------------------------------------------------


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and its n + 1 offsets; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the number of words before it (n + 1 values)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~_WS.take(buf)
    edge = np.zeros(len(buf) + 1, bool)  # a document starts here
    edge[offs] = True
    turn = ~word[:-1] | edge[1:-1]
    start = word.copy()
    start[1:] &= turn
    turn = ~word[1:] | edge[1:-1]
    word[:-1] &= turn
    st, en = np.flatnonzero(start), np.flatnonzero(word) + 1
    return st, en, np.searchsorted(st, offs)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def _xxh64_same(buf8: np.ndarray, buf4: np.ndarray, buf: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """XXH64 of the n bytes at each place; buf8 and buf4 are unaligned views of buf."""
    s = np.uint64(seed)
    at = at.copy()
    left = n
    if n >= 32:
        acc = [np.full(len(at), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
        while left >= 32:
            for k in range(4):
                acc[k] = _round(acc[k], buf8[at + 8 * k])
            at += 32
            left -= 32
        h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            h = (h ^ _round(np.zeros(1, np.uint64), a)) * _P1 + _P4
    else:
        h = np.full(len(at), s + _P5, np.uint64)
    h = h + np.uint64(n)
    while left >= 8:
        h = _rotl(h ^ _round(np.zeros(1, np.uint64), buf8[at]), 27) * _P1 + _P4
        at += 8
        left -= 8
    if left >= 4:
        h = _rotl(h ^ (buf4[at].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at += 4
        left -= 4
    for _ in range(left):
        h = _rotl(h ^ (buf[at].astype(np.uint64) * _P5), 11) * _P1
        at += 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxh64_spans(buf: np.ndarray, st: np.ndarray, en: np.ndarray, seed: int = 42) -> np.ndarray:
    """Unsigned XXH64 of buf[st:en] for every span, grouped by length so that each step is one array operation."""
    out = np.empty(len(st), np.uint64)
    if not len(st):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    buf8 = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    buf4 = np.ndarray(len(padded) - 3, "<u4", padded, strides=(1,))
    n = en - st
    order = np.argsort(np.minimum(n, 65535).astype(np.uint16), kind="stable")
    cuts = np.flatnonzero(np.diff(n[order], prepend=-1))
    with np.errstate(over="ignore"):
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            rows = order[a:b]
            size = int(n[rows[0]])
            if size <= 256:
                out[rows] = _xxh64_same(buf8, buf4, padded, st[rows], size, seed)
            else:
                out[rows] = [xxhash.xxh64_intdigest(buf[x : x + size].tobytes(), seed) for x in st[rows].tolist()]
    return out


def squeezed(buf: np.ndarray, st: np.ndarray, en: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_spans() again with one space between the words of a document and nothing else: bytes, starts and ends."""
    if not len(st):
        return np.zeros(0, np.uint8), st, en
    n = en - st
    last = np.zeros(len(st), bool)
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    keep = ~_WS.take(buf)
    keep[en[~last]] = True
    out = buf[keep]
    size = n + ~last
    to = np.cumsum(size)
    starts = to - size
    ends = starts + n
    out[ends[~last]] = 32
    return out, starts, ends


# --- graphs ------------------------------------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node reachable from each node of edges(a, b), by alternating large and small stars.

    Every round is two aggregations and two joins on the node, all of them distributed; no node's neighbours are ever
    gathered, so that a hub costs no more than its share of edges, and AQE may split its join. Rounds are written to
    the shared folder and deleted when the next one is. Self-loops are allowed and give single nodes. Rounds grow with the
    logarithm of the longest path; `rounds` of them are more than any graph that fits a cluster needs, beyond is an error.
    """
    first = e = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e, last = e.filter("u <> v"), []
    before = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()  # each larger neighbour to the least
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = durable(small)
        drop(*last)
        last = [e]
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first())
        if now == before or now[0] == now[2] and not e.join(e.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            found = durable(nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root")))
            drop(e, first)
            return found
        before = now
    raise RuntimeError(f"components have not settled in {rounds} rounds")


def arrow_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def trim() -> None:
    """Gives freed memory back to the system, where the C library can: workers live on, and keep what they once held."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: What a worker keeps from task to task, see batches().
kept: dict = {}


def batches(it: Iterator[pa.RecordBatch], most: int = BATCH_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `most` bytes; a single longer row stays whole. Memory is trimmed after each.

    Workers live on when their stage is over: unless the caller wants to keep it, what they hold in `kept` is dropped.
    """
    if kept and not keep:
        kept.clear()
        trim()
    for b in it:
        step = max(1, b.num_rows if b.nbytes <= 1.5 * most else b.num_rows * most // b.nbytes)
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
            trim()
