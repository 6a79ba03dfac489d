"""SimHash near-duplicates found by pigeonring filtering.

A fingerprint's 64 bits are cut into `segments` runs that stand in a ring. If two fingerprints differ in at most
`distance` bits, some place in the ring starts a chain of consecutive segments whose cumulative differences stay within
the proportional budget l * distance / segments after each of l = 1, 2, ... segments. While that budget is below one the
segments must be equal, so they are the bucket key (27 bits with 7 segments and distance 2); later budgets prune the
pairs of a bucket before the full Hamming check.

Fingerprints are the vertices of the graph: documents (with or without an id, repeated ids, copies) only hang on them. A
bucket of over DENSE distinct fingerprints is not compared pair by pair along its chains but joined by masks: sorting by the
fingerprint less `distance` of its free bits puts linked ones side by side, exactly and in time linear in the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Buckets of more fingerprints are searched by masks, in time linear in their size.
DENSE = 2048
_LANES = np.uint64(0x0101010101010101)


def fingerprints_of(buf: np.ndarray, offs: np.ndarray, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Unsigned fingerprint of each document: bit set in over half the shingles' XXH64, repeats counted; no word: 0."""
    low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    buf, st, en, first = *C.squeezed(low, *(spans := C.word_spans(low, offs))), spans[2]
    n = np.diff(first)
    m = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    at = np.concatenate([[0], np.cumsum(m)])
    out = np.zeros(len(n), np.uint64)
    if not at[-1]:
        return out
    doc = np.repeat(np.arange(len(n)), m)
    begin = first[doc] + np.arange(at[-1]) - at[doc]
    h = C.xxh64_spans(buf, st[begin], en[np.minimum(begin + shingle, first[doc + 1]) - 1], seed)
    full = np.flatnonzero(m)
    cuts = np.unique(np.concatenate([at[full], np.arange(0, at[-1], 255)]))  # eight byte-wide counters never overflow
    own = np.searchsorted(cuts, at[full])
    for j in range(8):
        part = np.add.reduceat((h >> np.uint64(j)) & _LANES, cuts).view(np.uint8).reshape(-1, 8)
        count = np.add.reduceat(part.astype(np.int64), own, axis=0)
        for b in range(8):
            out[full] |= (2 * count[:, b] > m[full]).astype(np.uint64) << np.uint64(8 * b + j)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", keys: list[Column] | None = None) -> DataFrame:
    """(doc_id, fp) of every row, and k0, k1, ... of `keys`, longs; fp is the fingerprint as a signed long. Null text: no
    word, fingerprint 0."""
    more = [k.alias(f"k{i}") for i, k in enumerate(keys or [])]
    names = ["doc_id", "fp", *[f"k{i}" for i in range(len(more))]]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.batches(it):
            fp = fingerprints_of(*C.buffers(b.column(1)), shingle, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more)
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges a-b and the smallest node that each reaches."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = inv[: len(a)], inv[len(a) :], np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        if not (open_ := rx != ry).any():
            return nodes, nodes[root]
        x, y, rx, ry = x[open_], y[open_], rx[open_], ry[open_]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while ((up := root[root]) != root).any():
            root = up


class Ring:
    """Segments of the ring, the chains' keys and budgets."""

    def __init__(self, distance: int, segments: int):
        if not 0 <= distance < segments <= 64:
            raise ValueError("segments must be over distance, and 64 at most")
        self.distance, self.segments = distance, segments
        edge = [64 * k // segments for k in range(segments + 1)]
        self.mask = [((1 << edge[k + 1]) - (1 << edge[k])) for k in range(segments)]
        self.budget = [(k + 1) * distance // segments for k in range(segments)]
        self.zero = sum(x == 0 for x in self.budget)
        self.chain = [[sum(self.mask[(i + t) % segments] for t in range(k + 1)) for k in range(segments)] for i in range(segments)]
        self.key = [self.chain[i][self.zero - 1] for i in range(segments)]

    def links(self, start: int, x: np.ndarray) -> np.ndarray:
        """Which differences x = a ^ b keep every budget of the chain from `start`, the last one being the full check."""
        ok = np.ones(len(x), bool)
        for k in range(self.zero, self.segments):
            if k + 1 == self.segments or self.budget[k + 1] > self.budget[k]:  # the longest chain of a budget holds the shorter ones
                at = np.flatnonzero(ok)
                ok[at] = np.bitwise_count(x[at] & np.uint64(self.chain[start][k])) <= self.budget[k]
        return ok


def _pairs(ring: Ring, key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked nodes of rows sorted by key; whole buckets only."""
    cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
    size = np.diff(np.append(cut, len(key)))
    group = np.repeat(np.arange(len(cut)), size)
    at = np.flatnonzero(size[group] <= DENSE)
    for lag in range(1, DENSE):
        at = at[at + lag < len(group)]
        at = at[group[at + lag] == group[at]]
        if not len(at):
            break
        x = fp[at] ^ fp[at + lag]
        for start in range(ring.segments):
            own = at[key[at, 0] == start]
            own = own[ring.links(start, x[key[at, 0] == start])]
            if len(own):
                yield node[own], node[own + lag]
    for g in np.flatnonzero(size > DENSE):
        rows = slice(cut[g], cut[g] + size[g])
        f, v, start = fp[rows], node[rows], int(key[cut[g], 0])
        free = [1 << b for b in range(64) if not ring.key[start] >> b & 1]
        label = np.arange(len(f))
        for bits in combinations(free, ring.distance):  # equal but for these bits
            masked = f & np.uint64(~sum(bits) & (1 << 64) - 1)
            o = np.argsort(masked, kind="stable")
            same = masked[o[1:]] == masked[o[:-1]]
            a, b = label[o[1:][same]], label[o[:-1][same]]
            if len(a := a[d := a != b]):
                nodes, roots = local_roots(a, b[d])
                to = np.arange(len(f))
                to[nodes] = roots
                label = to[label]
        yield v, v[label]


def links(fps: DataFrame, distance: int = 2, segments: int = 7) -> DataFrame:
    """(a, b): edges over the nodes of fps(fp, node), distinct fingerprints, that join exactly what links of `distance` bits join.
    node may be the fingerprint itself.

    Each fingerprint goes to one bucket per chain. A task reads its buckets in key order and returns a spanning forest of
    their links, so that a dense group returns as many edges as it has members. Buckets of over DENSE fingerprints are
    joined by masks instead of pairs: exact, and linear in the bucket.
    """
    ring = Ring(distance, segments)
    chains = F.array(*[F.struct(F.lit(i).alias("chain"), F.col("fp").bitwiseAND(F.lit(k - (1 << 64) if k >> 63 else k)).alias("key")) for i, k in enumerate(ring.key)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def search(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = list(_pairs(ring, rows[:, :2], rows[:, 2].view(np.uint64), rows[:, 3]))
            if found:
                nodes, roots = local_roots(*(np.concatenate(x) for x in zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["a", "b"])

        for b in it:
            if not b.num_rows:
                continue
            held.append(np.ascontiguousarray(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)))
            if sum(map(len, held)) >= 200_000:
                rows = np.concatenate(held)
                last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
                whole = int(last[-1]) + 1 if len(last) else 0
                held = [rows[whole:]]
                if whole:
                    yield from search(np.ascontiguousarray(rows[:whole]))
        if held and sum(map(len, held)):
            yield from search(np.ascontiguousarray(np.concatenate(held)))

    rows = fps.select(F.inline(chains), "fp", "node").select("chain", "key", "fp", "node")
    return rows.repartition("chain", "key").sortWithinPartitions("chain", "key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 2, segments: int = 7, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", hot: int = C.HOT_LEAST) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs.

    component_id is the smallest doc_id reachable over links of at most `distance` differing bits, itself included. Copies
    collapse into one fingerprint before any comparison. Null text counts as empty; very long texts are read whole. A row
    without doc_id links like any other and names no component: where no row of a component has an id, component_id is
    null. Rows that repeat, or share a doc_id and not their text, are all returned, each in its own fingerprint's
    component. No rows give no rows. Fingerprints of over `hot` rows (and one in 1000) are dealt by a salt.
    """
    own = C.durable(fingerprints(docs, shingle, seed, id_col, text_col))
    distinct = C.durable(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    moved = _roots(distinct, distance, segments)
    rooted = distinct.join(moved, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = C.durable(rooted.join(least, "root").select("fp", "copies", "component_id"))
    C.drop(distinct, moved)
    return C.join_hot(own, named, ["fp"], "copies", least=hot).select("doc_id", "fp", "component_id")


def _roots(distinct: DataFrame, distance: int, segments: int) -> DataFrame:
    """(fp, root) of those of distinct(fp, ...) that reach a smaller fingerprint."""
    edges = links(distinct.select("fp", F.col("fp").alias("node")), distance, segments)
    found = C.components(edges)
    out = C.durable(found.filter("node <> root").select(F.col("node").alias("fp"), "root"))
    C.drop(found)
    return out


def deduplicate(docs: DataFrame, distance: int = 2, segments: int = 7, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each component of near_duplicates(): the one of smallest doc_id, rows without
    id after all others, ties by fingerprint and a hash of the whole row; of rows equal in every column one stays.

    Rows are told apart by a 128-bit hash of all their columns, so that rows that merely share a doc_id are judged by their
    texts. Texts move once, dealt by that hash; everything before moves numbers.
    """
    cols = C.columns(docs)
    keys = [F.xxhash64(F.lit(k), *cols, *[F.isnull(c) for c in cols]) for k in (1, 2)]
    own = C.durable(fingerprints(docs, shingle, seed, id_col, text_col, keys))
    row = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "fp", "k0", "k1")
    distinct = C.durable(own.groupBy("fp").agg(F.min(row).alias("row"), F.count("*").alias("copies")))
    moved = _roots(distinct, distance, segments)
    first = distinct.join(moved, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("row").alias("row"))
    stay = C.durable(first.select("row.k0", "row.k1"))
    repeated = not own.join(stay, ["k0", "k1"], "left_semi").groupBy("k0", "k1").count().filter("count > 1").isEmpty()
    C.drop(own, distinct, moved)
    # docs may have any column: names of one's own that none of them has
    a, b = (f"_key{k}" + "_" * max(map(len, docs.columns)) for k in (0, 1))
    rows = docs.withColumns({a: keys[0], b: keys[1]})
    if repeated:  # partial aggregation collapses equal rows where they lie
        rows = rows.dropDuplicates([a, b])
    stay = stay.toDF(a, b).hint("merge")  # as at scale, where the list of those that stay is no small table
    return rows.join(stay, [a, b], "left_semi").select(*cols)


def op10(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = near_duplicates(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
