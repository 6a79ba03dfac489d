"""Substring dedup: an FM-index per shard finds word windows that smaller documents hold as well.

1. Anchors. Every window of `window` words has an anchor, the least hash of its `gram`-word runs. Consecutive windows of
   one anchor make a piece. Equal windows have equal anchors, so a window can repeat only where its anchor does: pieces
   whose anchor occurs in one document alone need no search.
2. Shards. Pieces with shared anchors go, by anchor, to shards. Each shard builds an FM-index over its distinct pieces: a
   suffix array by prefix doubling, its Burrows-Wheeler transform in a wavelet matrix of packed bits with rank counts.
3. Search. The pieces stream through their shard's index from right to left; each step is one backward extension of all of
   them. Once a match is `window` words long, its interval, widened to all suffixes that share `window` words, tells
   the smallest document that holds the window.
4. Documents lose every word of a window that a smaller document holds.

Anchors met very often send their windows to shards by the windows' own hashes, so that no shard holds a hot anchor whole.
Which anchors are hot is decided once for all pieces: at most one anchor in `hot` pieces is.

Texts never move. They are written once, each task's rows in one bucket, and everything else comes back to them by the
number of the task that read them: flags of pieces, and the shards' replies, one for each batch that sent a piece, so that a
piece of a third of all documents is no hot key. Pieces are equal if 128 bits of hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from . import common as C

WINDOW, GRAM = 13, 5
#: Windows of one piece, so that pieces are shorter than the depth of the suffix order.
RUN, DEPTH = 16, 32
#: An anchor with more entries than this is hot: its windows are sharded one by one.
HOT = 20_000
#: Input bytes for each shard of anchors; piece words for each shard of the index.
ANCHOR_BYTES, SHARD_WORDS = 16 << 20, 800_000
#: Input bytes of a bucket of texts.
TEXT_BYTES = 16 << 20
#: The place of a document without id: after all others.
LAST = (1 << 63) - 1
SECOND = 0x5851F42D4C957F2D

_MIX, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _ODD
        x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _runs_hash(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive values."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _MIX + h[k : k + len(out)]
    return _mix(out)


def _slide_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive values."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:]) if len(x) > width else x[:0]
        width *= 2
    rest = n - width
    return np.minimum(x[:-rest], x[rest:]) if rest and len(x) > rest else x if not rest else x[:0]


def pieces_of(h: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first window, number of windows and anchor of every piece, in order."""
    n = np.diff(first)
    windows = np.maximum(n - window + 1, 0)
    total = int(windows.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    least = _slide_min(_runs_hash(h, gram), window - gram + 1)
    doc = np.repeat(np.arange(len(n)), windows)
    at = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
    a = least[first[doc] + at]
    new = np.ones(total, bool)
    new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
    cut = np.flatnonzero(new)
    since = np.arange(total) - np.repeat(cut, np.diff(np.append(cut, total)))
    cut = np.flatnonzero(since % RUN == 0)
    return doc[cut], at[cut], np.diff(np.append(cut, total)), a[cut]


def _words(col: pa.Array) -> tuple[np.ndarray, ...]:
    """The words' bytes with one space between words, their starts and ends, words before each document, and hashes."""
    buf, offs = C.buffers(col)
    spans = C.word_spans(buf, offs)
    buf, st, en = C.squeezed(buf, *spans)
    return buf, st, en, spans[2], C.xxh64_spans(buf, st, en)


_FLAGS = "rk long, starts array<int>, sizes array<int>, anchors array<long>"
_ENTRY = np.dtype([("a", "<u8"), ("ord", "<i8"), ("rk", "<i8"), ("start", "<i4"), ("n", "<i4")])


def _flag_batch(rk: np.ndarray, start: np.ndarray, n: np.ndarray, a: np.ndarray) -> list[pa.Array]:
    """Columns of _FLAGS, a row a document."""
    order = np.argsort(rk, kind="stable")
    rk = rk[order]
    cut = np.flatnonzero(np.concatenate([[True], rk[1:] != rk[:-1]])) if len(rk) else np.zeros(0, np.int64)
    offs = pa.array(np.append(cut, len(rk)).astype(np.int32))
    return [pa.array(rk[cut]), *(pa.ListArray.from_arrays(offs, pa.array(x[order])) for x in (start.astype(np.int32), n.astype(np.int32), a.view(np.int64)))]


def shared_anchors(docs: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    """_FLAGS of docs(rk, text[, ord]): pieces whose anchor occurs in rows of more than one ord (rk, if there is none), by
    the row key rk; see hot_anchors() for start -1.

    A batch sends each anchor once if several of its documents hold it (they are flagged at once), so that an anchor of a
    third of all documents is an entry a batch. Entries travel packed, a message a batch and shard.
    """
    shards = C.shards_for(docs, ANCHOR_BYTES)

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in C.batches(it, C.BATCH_BYTES):
            rk, who = b.column(0).to_numpy(), b.column(2).to_numpy()
            *_, first, h = _words(b.column(1))
            doc, start, n, a = pieces_of(h, first, window, gram)
            if not len(doc):
                continue
            own, who = rk[doc], who[doc]
            order = np.argsort(a, kind="stable")
            s = a[order]
            cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            size = np.diff(np.append(cut, len(s)))
            many = np.minimum.reduceat(who[order], cut) != np.maximum.reduceat(who[order], cut)
            known = np.zeros(len(a), bool)
            known[order] = np.repeat(many, size)
            lone = np.flatnonzero(~known)
            reps = order[cut[many]]
            entries = np.zeros(len(lone) + len(reps), _ENTRY)
            for name, x in (("a", a), ("ord", who), ("rk", own), ("start", start), ("n", n)):
                entries[name] = np.concatenate([x[lone], x[reps]])
            entries["start"][len(lone) :] = -1  # known as shared
            entries["n"][len(lone) :] = size[many]
            held = np.flatnonzero(known)
            to = (entries["a"] >> np.uint64(32)) % np.uint64(shards)
            order = np.argsort(to.astype(np.uint32), kind="stable")
            cut = np.flatnonzero(np.diff(to[order].astype(np.int64), prepend=-1))
            kind, rows = to[order[cut]].astype(np.int32), []
            for x, y in zip(cut, [*cut[1:], len(order)], strict=True):
                part = entries[order[x:y]]
                rows.append(squeeze.compress(b"".join(part[c].tobytes() for c in _ENTRY.names)))
            n_rows = len(rows)
            empty = pa.nulls(n_rows, pa.list_(pa.int32()))
            sent = [pa.array(kind), pa.array(rows, pa.binary()), pa.nulls(n_rows, pa.int64()), empty, empty, pa.nulls(n_rows, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(sent, names=names)
            flags = _flag_batch(own[held], start[held], n[held], a[held])
            m = len(flags[0])
            shard = pa.array(((flags[0].to_numpy().view(np.uint64) * _ODD >> np.uint64(32)) % np.uint64(shards)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([shard, pa.nulls(m, pa.binary()), *flags], names=names)

    names = ["shard", "entries", "rk", "starts", "sizes", "anchors"]

    def met(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """What one shard's entries say."""
        a, who, rk, start, n = (np.concatenate(x) for x in held)
        order = np.argsort(a, kind="stable")
        s = a[order]
        cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.append(cut, len(s)))
        who = who[order]
        many = (np.minimum.reduceat(who, cut) != np.maximum.reduceat(who, cut)) | (np.minimum.reduceat(start[order], cut) < 0)
        weight = np.add.reduceat(np.where(start[order] < 0, n[order], 1), cut)
        marks = order[cut[many & (weight > hot)]]  # one of its row keys tells that an anchor is hot
        order = order[np.repeat(many, size) & (start[order] >= 0)]
        start = np.concatenate([start[order], np.full(len(marks), -1, start.dtype)])
        n = np.concatenate([n[order], np.zeros(len(marks), n.dtype)])
        order = np.concatenate([order, marks])
        if len(order):
            yield pa.RecordBatch.from_arrays(_flag_batch(rk[order], start, n, a[order]), names=names[2:])

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, now = zstandard.ZstdDecompressor(), None
        held: list[list[np.ndarray]] = [[] for _ in _ENTRY.names]
        for b in it:
            message = b.column(1).is_valid()
            passed = b.filter(pa.compute.invert(message))
            if passed.num_rows:
                yield passed.select(names[2:])
            for shard, raw in zip(b.column(0).filter(message).to_pylist(), b.column(1).drop_null(), strict=True):
                if shard != now:  # rows come in order of their shards: one is held at a time
                    if held[0]:
                        yield from met(held)
                        C.trim()
                    now, held = shard, [[] for _ in _ENTRY.names]
                raw = open_.decompress(raw.as_py())
                n, upto = len(raw) // _ENTRY.itemsize, 0
                for k, c in enumerate(_ENTRY.names):
                    held[k].append(np.frombuffer(raw, _ENTRY[c], n, upto))
                    upto += n * _ENTRY[c].itemsize
        if held[0]:
            yield from met(held)

    rows = docs.select("rk", "text", F.col("ord" if "ord" in docs.columns else "rk").alias("ord"))
    sent = rows.mapInArrow(send, f"shard int, entries binary, {_FLAGS}")
    return sent.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(meet, _FLAGS)


def hot_anchors(flagged: DataFrame) -> np.ndarray:
    """Hot anchors, sorted: those that _FLAGS name with start -1."""
    marks = flagged.select(F.explode(F.filter(F.arrays_zip("starts", "anchors"), lambda z: z["starts"] < 0)).alias("z"))
    found = marks.select("z.anchors").distinct().toPandas()["anchors"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


# --- the index ---------------------------------------------------------------------------------------------------


class WaveletMatrix:
    """Rank queries over a sequence of symbols: one plane of packed bits with counts for each bit of a symbol."""

    def __init__(self, seq: np.ndarray):
        top = int(seq.max(initial=0))
        self.planes = []
        start = np.zeros(top + 1, np.int64)  # where each symbol begins after the last plane
        symbols = np.arange(top + 1)
        for k in reversed(range(max(1, top.bit_length()))):
            bit = (seq >> k & 1).astype(bool)
            packed = np.packbits(np.append(bit, np.zeros(128 - len(bit) % 64, bool)), bitorder="little").view("<u8")
            count = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            zeros = len(bit) - int(count[-1])
            self.planes.append((k, packed, count, zeros))
            start = self._step(self.planes[-1], symbols, start)
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.start = start

    @staticmethod
    def _step(plane, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        k, packed, count, zeros = plane
        word = i >> 6
        ones = count[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
        return np.where(c >> k & 1, zeros + ones, i - ones)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c occurs before each i."""
        for plane in self.planes:
            i = self._step(plane, c, i)
        return i - self.start[c]


class FMIndex:
    """Pieces' words (64-bit hashes) in a row, each piece closed by symbol 0; owner[p] is a value of piece p to minimise."""

    def __init__(self, words: np.ndarray, size: np.ndarray, owner: np.ndarray, window: int):
        values, symbol = np.unique(words, return_inverse=True)
        self.size, self.window = size, window
        end = np.cumsum(size + 1)
        self.begin = end - size - 1
        text = np.zeros(int(end[-1]), np.int64)
        inner = np.ones(len(text), bool)
        inner[end - 1] = False
        text[inner] = symbol + 1
        self.text = text
        rank, depth, at_eight = text, 1, None
        eight = 8
        while depth < DEPTH:
            if depth == eight:
                at_eight = rank
            after = np.zeros(len(text), np.int64)
            after[:-depth] = rank[depth:]
            key = rank * (int(rank.max()) + 1) + after
            order = np.argsort(key, kind="stable")
            s = key[order]
            rank = np.empty(len(text), np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
            depth *= 2
        sa = order
        # suffixes with the same first `window` words stand together: two overlapping runs of eight tell them
        far = np.append(at_eight, np.zeros(window, np.int64))
        new = np.zeros(len(sa), bool)
        new[0] = True
        for k in {*range(0, window - 8, 8), window - 8}:
            new[1:] |= far[sa[1:] + k] != far[sa[:-1] + k]
        self.group = np.cumsum(new) - 1
        piece = np.searchsorted(end, sa, side="right")
        self.least = np.minimum.reduceat(owner[piece], np.flatnonzero(new))
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(values) + 1))])
        self.bwt = WaveletMatrix(text[sa - 1])

    def search(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Streams all pieces from right to left: (piece, window's place, the least owner of that window), step by step."""
        live = np.arange(len(self.size))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(self.text), np.int64)
        for done in range(1, int(self.size.max(initial=0)) + 1):
            more = self.size[live] >= done
            live, lo, hi = live[more], lo[more], hi[more]
            c = self.text[self.begin[live] + self.size[live] - done]
            lo = self.counts[c] + self.bwt.rank(c, lo)
            hi = self.counts[c] + self.bwt.rank(c, hi)
            if done >= self.window:
                assert (lo < hi).all(), "a piece is in its own index"
                yield live, self.size[live] - done, self.least[self.group[lo]]


def _piece_hash(h: np.ndarray, at: np.ndarray, n: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each run of n words; two seeds make 128 bits."""
    out = n.astype(np.uint64) ^ np.uint64(seed)
    with np.errstate(over="ignore"):
        for k in range(int(n.max(initial=0))):
            out = np.where(k < n, _mix(out * _MIX + (h[np.minimum(at + k, len(h) - 1)] ^ np.uint64(seed))), out)
    return out


def alike(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, the last one first, and where in it each run of rows with all keys equal but the first begins."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys[1:]:
            new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, np.flatnonzero(new)


def _cut(b: pa.RecordBatch, window: int, anchors: np.ndarray) -> tuple[np.ndarray, ...]:
    """Flagged pieces of documents (ord, rk, text, starts, sizes, anchors): row, start, words, both hashes, shard key, bytes, first
    byte and end.

    anchors: the hot ones, whose windows are pieces of their own.
    """
    buf, st, en, first, h = _words(b.column(2))
    starts = b.column(3)
    offs = starts.offsets.to_numpy()
    row = np.repeat(np.arange(b.num_rows), np.diff(offs))
    start, size, anchor = (b.column(k).values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]] for k in (3, 4, 5))
    start, size, key = start.astype(np.int64), size.astype(np.int64), anchor.view(np.uint64)
    n = np.diff(first)
    good = (start >= 0) & (start + size + window - 1 <= n[row])  # flags of another text with the same key don't count
    row, start, size, key = row[good], start[good], size[good], key[good]
    if (hot := np.isin(key, anchors)).any():  # windows one by one, by their own hashes
        each = np.where(hot, size, 1)
        up = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        row, start, key, hot = np.repeat(row, each), np.repeat(start, each) + up, np.repeat(key, each), np.repeat(hot, each)
        size = np.where(hot, 1, np.repeat(size, each))
    at, words = first[row] + start, size + window - 1
    ph, pg = _piece_hash(h, at, words), _piece_hash(h, at, words, SECOND)
    return row, start, words, ph, pg, np.where(hot, ph, key) if len(row) else key, buf, st[at], en[at + words - 1]


_REPLY = ["pid", "ph", "pg", "places", "least"]


def search_shards(flagged: DataFrame, window: int, anchors: Broadcast) -> DataFrame:
    """(pid, ph, pg, places, least): for each distinct piece that the flagged documents of a pid hold, its windows that a
    smaller document holds as well, and the least one that does."""
    n = flagged.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x + (window - 1)))).first()[0] or 0
    shards = max(1, -(-n // SHARD_WORDS))

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in C.batches(it, C.BATCH_BYTES):
            row, start, words, ph, pg, key, buf, begin, end = _cut(b, window, anchors.value)
            if not len(row):
                continue
            owner, pid = b.column(0).to_numpy()[row], b.column(6).to_numpy()[row].astype(np.int64)
            order, cut = alike(owner, pg, ph, pid)  # a piece of several documents is one entry
            low, high = order[cut], order[np.append(cut[1:], len(order)) - 1]
            shard = ((key[low] >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
            by = np.argsort(shard, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], shard[by][1:] != shard[by][:-1]]))
            raw, sent = memoryview(buf.tobytes()), []
            for x, y in zip(cut, [*cut[1:], len(by)], strict=True):
                one, top = low[by[x:y]], high[by[x:y]]
                head = b"".join(c.tobytes() for c in (ph[one], pg[one], owner[one], owner[top], words[one].astype("<i8"), pid[one]))
                sent.append(squeeze.compress(len(one).to_bytes(8, "little") + head + b" ".join([raw[i:j] for i, j in zip(begin[one].tolist(), end[one].tolist(), strict=True)])))
            yield pa.RecordBatch.from_arrays([pa.array(shard[by[cut]]), pa.array(sent, pa.binary())], names=["shard", "pieces"])

    def searched(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """One shard's index, and what its search says to each sender."""
        ph, pg, low, high, size, pid, flat = (np.concatenate(x) for x in zip(*held, strict=True))
        at = np.cumsum(size) - size
        order, cut = alike(pid, pg, ph)
        lows, highs, one = np.minimum.reduceat(low[order], cut), np.maximum.reduceat(high[order], cut), order[cut]
        n = size[one]
        end = np.cumsum(n)
        words = flat[np.repeat(at[one] - end + n, n) + np.arange(end[-1])]
        found = [(p[x], w[x], least[x]) for p, w, least in FMIndex(words, n, lows, window).search() if (x := least < highs[p]).any()]
        if not found:
            return
        p, w, least = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((w, p))
        p, w, least = p[by], w[by], least[by]
        begin = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        offs = pa.array(np.append(begin, len(p)).astype(np.int32))
        places, leasts = pa.ListArray.from_arrays(offs, pa.array(w.astype(np.int32))), pa.ListArray.from_arrays(offs, pa.array(least))
        held_by = np.full(len(cut), -1)
        held_by[p[begin]] = np.arange(len(begin))
        first = np.full(len(cut), LAST)
        first[p[begin]] = np.minimum.reduceat(least, begin)
        piece = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(order))))
        told = (held_by[piece] >= 0) & (high[order] > first[piece])
        run = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (pid[order][1:] != pid[order][:-1])]))
        run = run[np.logical_or.reduceat(told, run)]  # a pid that sent a piece from several batches is told once
        to, which = order[run], pa.array(held_by[piece[run]])
        for x in range(0, len(to), 1 << 16):
            rows = slice(x, x + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(pid[to[rows]]), pa.array(ph[to[rows]].view(np.int64)), pa.array(pg[to[rows]].view(np.int64)), places.take(which[rows]), leasts.take(which[rows])], names=_REPLY)

    def index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, held, now = zstandard.ZstdDecompressor(), [], None
        for b in it:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != now:  # rows come in order of their shards: one is held at a time
                    if held:
                        yield from searched(held)
                        C.trim()
                    held, now = [], k
                raw = open_.decompress(raw.as_py())
                n = int.from_bytes(raw[:8], "little")
                head = np.frombuffer(raw, "<i8", 6 * n, 8).reshape(6, n)
                text = np.frombuffer(raw, np.uint8, offset=8 + 48 * n)
                st, en, _ = C.word_spans(text, np.array([0, len(text)]))
                held.append((head[0].view(np.uint64), head[1].view(np.uint64), *head[2:], C.xxh64_spans(text, st, en)))
        if held:
            yield from searched(held)

    sent = flagged.select(*_FLAGGED).mapInArrow(send, "shard int, pieces binary")
    return sent.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(index, "pid long, ph long, pg long, places array<int>, least array<long>")


_FLAGGED = ("ord", "rk", "text", "starts", "sizes", "anchors", "pid")


def _members(flagged: DataFrame, window: int, anchors: Broadcast) -> DataFrame:
    """(pid, ord, rk, ph, pg, start) of every flagged piece."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.batches(it, C.BATCH_BYTES):
            row, start, _, ph, pg, *_ = _cut(b, window, anchors.value)
            ord_, rk, pid = (b.column(k).to_numpy()[row] for k in (0, 1, 6))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pid, ord_, rk, ph.view(np.int64), pg.view(np.int64), start.astype(np.int32))], names=["pid", "ord", "rk", "ph", "pg", "start"])

    return flagged.select(*_FLAGGED).mapInArrow(run, "pid long, ord long, rk long, ph long, pg long, start int")


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """docs without the words of windows that a document of smaller id holds: its columns, the text being what is left, and
    _n_words, _n_removed (words) and _spans (removed runs of words, from and to). digest: in place of what is left, the
    SHA-256 of its words joined by one space, taken where the text is cut so that texts don't travel twice.

    Windows are judged on the input. What is left keeps its white space, each removed word taking the white space after it
    along. Null text stays null and counts no word; empty texts stay; very long ones are searched whole. A document without
    id comes after all others, and rows of one id (or without) never lose words to each other. Rows that repeat are judged
    alike, each by itself: n of them cost n times one. No rows give no rows. Columns of docs may have any name; where one
    is called _n_words, _n_removed or _spans, the operator's own gets a further underscore.
    """
    if not 8 < window <= DEPTH - RUN + 1 or not 1 <= gram < window:
        raise ValueError(f"window must be 9 to {DEPTH - RUN + 1}, gram under it")
    spark = docs.sparkSession
    # each side of a join lies in buckets of pid, one of its keys: that is enough for rows to meet without moving
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    names = docs.columns
    order = F.coalesce(F.col(C.quoted(id_col)).cast("long"), F.lit(LAST))
    rest = F.struct(F.lit(0).alias("_"), *[F.col(C.quoted(c)).alias(f"c{k}") for k, c in enumerate(names) if c != text_col])
    own = docs.select(F.monotonically_increasing_id().alias("rk"), order.alias("ord"), F.col(C.quoted(text_col)).alias("text"), rest.alias("rest"))
    pid = F.shiftright("rk", 33).alias("pid")
    parts = C.shards_for(docs, TEXT_BYTES)
    texts = C.bucketed(own.select("*", pid), "pid", parts)
    flags = shared_anchors(texts, window, gram, hot).select("*", pid).repartition(parts, "pid")
    flags = flags.groupBy("pid", "rk").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "sizes", "anchors")])
    flags = C.bucketed(flags, "pid", parts)
    flagged = texts.join(flags, ["rk", "pid"])
    anchors = spark.sparkContext.broadcast(hot_anchors(flags))
    replies = C.durable(search_shards(flagged, window, anchors))
    hits = _members(flagged, window, anchors).join(replies, ["pid", "ph", "pg"])
    smaller = F.filter(F.arrays_zip("places", "least"), lambda z: z["least"] < F.col("ord"))
    hits = hits.select("pid", "rk", F.transform(smaller, lambda z: z["places"] + F.col("start")).alias("windows")).filter("size(windows) > 0")
    hits = hits.repartition(parts, "pid").groupBy("pid", "rk").agg(F.flatten(F.collect_list("windows")).alias("windows"))
    rows = texts.join(hits, ["rk", "pid"], "left").select("text", "rest", "windows")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.batches(it, C.BATCH_BYTES):
            buf, offs = C.buffers(b.column(0))
            st, en, first = C.word_spans(buf, offs)
            some = [(i, w.values.to_numpy()) for i, w in enumerate(b.column(2)) if w.is_valid and len(w)]
            texts, removed, spans = b.column(0), np.zeros(b.num_rows, np.int64), [[]] * b.num_rows
            if some:
                texts = texts.to_pylist()
                for i, windows in some:
                    texts[i], spans[i] = _without(buf[offs[i] : offs[i + 1]].tobytes(), st[first[i] : first[i + 1]] - offs[i], windows, window)
                    removed[i] = sum(s["end"] - s["start"] for s in spans[i])
                texts = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([kept_hash(texts) if digest else texts, b.column(1), pa.array(np.diff(first)), pa.array(removed), pa.array(spans, _SPANS)], names=["text", "rest", "_n_words", "_n_removed", "_spans"])

    spans = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
    out = rows.mapInArrow(run, C.schema_of(rows.select("text", "rest"), _n_words=LongType(), _n_removed=LongType(), _spans=spans))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("rest").getField(f"c{k}").alias(c) for k, c in enumerate(names)], *[F.col(c).alias(C.free(c, docs)) for c in ("_n_words", "_n_removed", "_spans")])


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _without(text: bytes, st: np.ndarray, windows: np.ndarray, window: int) -> tuple[str, list[dict]]:
    """text without the windows' words, and the removed runs."""
    edge = np.zeros(len(st) + 1, np.int64)
    np.add.at(edge, windows, 1)
    np.add.at(edge, windows + window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    at = np.append(st, len(text))
    out, upto = [], 0
    spans = []
    for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
        out.append(text[upto : at[a]])
        upto = int(at[b])
        spans.append({"start": a, "end": b})
    out.append(text[upto:])
    return b"".join(out).decode(), spans


def kept_hash(col: pa.Array) -> pa.Array:
    import hashlib

    buf, offs = C.buffers(col)
    buf, st, en, first = *C.squeezed(buf, *(s := C.word_spans(buf, offs))), s[2]
    raw = memoryview(buf.tobytes())
    return pa.array([hashlib.sha256(raw[st[a] : en[b - 1]] if b > a else b"").hexdigest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.string())


def op1(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    found = dedup(C.table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("text").alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{C.WORD}') AS w FROM documents),
n AS (SELECT doc_id, array_to_string(w[p : p + {WINDOW - 1}], ' ') AS s, p FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d WHERE len(w) >= {WINDOW})),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM n),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) AS k FROM f WHERE least < doc_id),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t FROM x ANTI JOIN g USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN kept USING (doc_id)"""
