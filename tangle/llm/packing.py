"""Best-fit packing, certified by dual-feasible-function lower bounds and repaired by exchange.

Documents become pieces of at most `capacity` tokens. Pieces are dealt evenly to partitions of bounded size; each is packed
by best-fit decreasing and certified by a lower bound on its bins. Partitions with a gap release the pieces of their
unfilled bins, which are dealt anew among fewer partitions and packed again; the better packing stays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import vocab

CAPACITY = 4096
VOCABULARY, END = "word_bpe_49k.json", 1
#: Pieces in a partition: bounds a task's memory, and the bins lost to rounding are at most one a partition.
PART = 50_000
ROUNDS = 3

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, capacity: int = CAPACITY, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every row: doc_id, piece, start, length, ids_crc32 (and ids, if asked for).

    Null or empty text: the end id alone. Very long texts make as many pieces as they need; repeated rows are pieces of their
    own; a null doc_id stays null; no rows give none. Strings of the vocabulary's added tokens are those tokens.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocab.coder(vocabulary)
        for b in C.batches(it, C.BATCH_BYTES // 2, keep=True):
            texts = b.column(1)
            odd = words.holds_added(texts)
            if len(odd):  # read as a whole, below
                plain = np.ones(len(texts), bool)
                plain[odd] = False
                texts = pc.if_else(pa.array(plain), texts, "")
            buf, offs = C.buffers(texts)
            st, en, first = C.word_spans(buf, offs)
            flat, n = words.ids_of(buf, st, en)
            upto = np.concatenate([[0], np.cumsum(n)])[first]  # ids before each document, ends left out
            size = np.diff(upto) + 1
            if len(odd):
                own_ids = [words.text_ids(b.column(1)[i].as_py()) for i in odd.tolist()]
                flat = np.insert(flat, np.repeat(upto[odd], [len(x) for x in own_ids]), np.concatenate(own_ids))
                size[odd] += [len(x) for x in own_ids]
            to = np.concatenate([[0], np.cumsum(size)])
            out = np.full(to[-1], end, "<u4")
            own = np.ones(to[-1], bool)
            own[to[1:] - 1] = False
            out[own] = flat
            count = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(size[doc] - start, capacity)
            at = to[doc] + start
            raw = memoryview(out.tobytes())
            crc = [zlib.crc32(raw[4 * x : 4 * (x + y)]) for x, y in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [b.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, to[-1]).astype(np.int32)), pa.array(out.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * ids)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PIECES + ", ids array<int>" * ids)


def lower_bound(length: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of three families of dual feasible functions over all their parameters."""
    if not len(length):
        return 0
    count = np.bincount(length, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    n, w = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * x)])
    for e in range(1, capacity // 2 + 1):  # over capacity - e: a whole bin; under e: nothing; else as it is
        best = max(best, -(-(int(n[-1] - n[capacity - e + 1]) * capacity + int(w[capacity - e + 1] - w[e])) // capacity))
    for k in range(1, 101):  # rounded to k-ths of a bin
        whole = (k + 1) * x % capacity == 0
        f = np.where(whole, x * k, (k + 1) * x // capacity * capacity)  # times k
        best = max(best, -(-int((count * f).sum()) // (k * capacity)))
    return best


def best_fit(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and place of each piece, and each bin's room left. Ties by position."""
    order = np.argsort(-length, kind="stable")
    bins, place = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    left: list[int] = []
    open_ = 0  # bit r: a bin with room r
    for i, size in zip(order.tolist(), length[order].tolist(), strict=True):
        fit = open_ >> size
        if fit:
            r = size + (fit & -fit).bit_length() - 1
            b = rooms[r].pop()
            if not rooms[r]:
                open_ ^= 1 << r
        else:
            r, b = capacity, len(left)
            left.append(capacity)
        bins[i], place[i] = b, capacity - r
        left[b] = r = r - size
        if r:
            rooms[r].append(b)
            open_ |= 1 << r
    return bins, place, np.array(left, np.int64)


_PACKED = f"{_PIECES}, row long, part long, bin long, offset long, room long"


def _pack(rows: DataFrame, capacity: int) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        bins, place, left = best_fit(g["length"].to_numpy(), capacity)
        return g.assign(bin=bins, offset=place, room=left[bins])[[x.split()[0] for x in _PACKED.split(", ")]]

    return rows.select(*[x.split()[0] for x in _PIECES.split(", ")], "row", "part").groupBy("part").applyInPandas(run, _PACKED)


def _certify(packed: DataFrame, capacity: int) -> DataFrame:
    """(part, bins, bound, held): bins in use, the lower bound, and how many of the bins are not full."""
    sizes = packed.groupBy("part", "length").agg(F.count("*").alias("n"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": g["part"].iloc[:1], "bound": lower_bound(np.repeat(g["length"].to_numpy(), g["n"].to_numpy()), capacity)})

    bounds = sizes.groupBy("part").applyInPandas(run, "part long, bound long")
    bins = packed.groupBy("part").agg((F.max("bin") + 1).alias("bins"), F.count_distinct(F.when(F.col("room") > 0, F.col("bin"))).alias("held"))
    return bins.join(bounds, "part")


def pack(rows: DataFrame, capacity: int = CAPACITY, part: int = PART, rounds: int = ROUNDS) -> tuple[DataFrame, dict]:
    """Rows of pieces() with sequence_id and offset, and the certificate: sequences, lower bound, rounds.

    Every row is placed once, repeated rows as often as they come; a null doc_id is a value like any other. No rows: none.
    """
    rows = C.durable(rows.withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    deal = lambda df, n, salt: df.withColumn("part", F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(max(1, n))))
    now = C.durable(_pack(deal(rows, -(-total // part), 0), capacity))
    done, used, bound = [], 0, 0
    for turn in range(rounds + 1):
        state = _certify(now, capacity).toPandas()  # one row a partition of `part` pieces
        gaps = state[state["bins"] > state["bound"]]
        if not turn:
            used, bound = int(state["bins"].sum()), int(state["bound"].sum())
        gap = int((gaps["bins"] - gaps["bound"]).sum())
        if not gap or turn == rounds:
            break
        spark = rows.sparkSession
        marked = now.join(F.broadcast(spark.createDataFrame(gaps[["part"]].assign(open=True), "part long, open boolean")), "part", "left")  # a row a partition
        loose = F.col("open").isNotNull() & (F.col("room") > 0)
        held, freed = int(gaps["held"].sum()), marked.filter(loose).select(*[x.split()[0] for x in _PIECES.split(", ")], "row")
        n = freed.count()
        again = C.durable(_pack(deal(freed, min(-(-n // part), max(1, len(gaps) // 2)), turn + 1), capacity))
        bins = again.select("part", "bin").distinct().count()
        if bins >= held:
            break
        done.append(marked.filter(~loose).drop("open").withColumn("turn", F.lit(turn)))
        used += bins - held
        now = again
    turn = len(done)
    done.append(now.withColumn("turn", F.lit(turn)))
    out = done[0].select(*(names := [*[x.split()[0] for x in _PACKED.split(", ")], "turn"]))
    for x in done[1:]:
        out = out.unionByName(x.select(*names))
    tokens = rows.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    certificate = {"sequences": used, "lower_bound": -(-tokens // capacity), "partition_bounds": bound, "rounds": turn}
    sequence = F.col("turn").cast("long") * (1 << 56) + F.col("part") * (1 << 24) + F.col("bin")
    base = [x.split()[0] for x in _PIECES.split(", ")]
    more = [c for c in rows.columns if c not in {*base, "row"}]
    out = out.select("row", *base, sequence.alias("sequence_id"), "offset")
    if more:  # ids don't take part in the packing; they meet their places afterwards
        out = out.join(rows.select("row", *more), "row")
    return out.select(*base, *more, "sequence_id", "offset"), certificate


def op5(spark, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(pieces(C.table(spark, sf_dir, "documents")))[0]
