"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents stand in a random but fixed order; their words, in that order, are cut into blocks of equal length.
A pass over a source visits its blocks in a permuted order. The blocks that a source owes (its quota) are split among the
output shards by a tree: at each node a multivariate-hypergeometric draw deals the node's quotas to its two halves, so that
quotas add up exactly at every level and each shard is a random sample of the mix. Shards then draw disjoint runs of the
permuted blocks, and order what they hold by hash.

Every node's draw follows from the seed and the node alone, so that a task walks only the branches its own blocks lead to:
no table of shards is built or sent anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from . import common as C

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
#: Words in a block, and blocks in an output shard. numpy's draw holds up to 1e9 blocks a node: 3e13 words.
BLOCK, SHARD = 32768, 512
SEED = 7
#: Input bytes for each partition of hash ranges.
RANGE_BYTES = 32 << 20
#: Nodes of the tree that a task remembers.
NODES = 1 << 14


@dataclass
class Source:
    """What the mix takes from one source: names of sources are few, as a recipe's are, and held by the driver."""

    name: str | None
    size: int
    target: float
    turns: list[tuple[int, int, int, int, int]]  # words owed, permutation a and c, place of the short block, first draw


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Each source's target: shares by weight in order of code points, null last, none over cap times its size; the excess
    is shared again by weight among the others until none is above."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: [ord(c) for c in n]) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, open_, found = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[n] for n in open_)
        over = [n for n in open_ if left * weight[n] / total > cap * sizes[n]]
        if not over:
            return found | {n: left * weight[n] / total for n in open_}
        for n in over:
            found[n] = cap * sizes[n]
        left -= sum(found[n] for n in over)
        open_ = [n for n in open_ if n not in over]
    return found


def _left(quotas: np.ndarray, a: int, b: int, seed: int) -> np.ndarray:
    """What of a node's quotas goes to its left half: shards a to b stand under the node."""
    n = int(quotas.sum()) * ((a + b) // 2 - a) // (b - a)
    return np.random.default_rng([seed, a, b]).multivariate_hypergeometric(quotas, n, method="marginals")


def split_quotas(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """quotas[source] dealt among shards by the whole tree: rows are shards, each of an equal number of blocks but for rounding."""
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        a, b, q = todo.pop()
        if b - a == 1 or not len(q):
            out[a] = q
            continue
        left = _left(q, a, b, seed)
        todo += [(a, (a + b) // 2, left), ((a + b) // 2, b, q - left)]
    return out


def shards_of(quotas: np.ndarray, shards: int, source: np.ndarray, draw: np.ndarray, seed: int = SEED, known: dict | None = None) -> np.ndarray:
    """The shard of each draw of a source (0 .. quota - 1): where split_quotas() puts it, walking only the branches needed."""
    known = {} if known is None else known
    out = np.zeros(len(draw), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64), np.asarray(draw, np.int64), np.arange(len(draw)))]
    while todo:
        a, b, q, at, rows = todo.pop()
        if not len(rows):
            continue
        if b - a == 1:
            out[rows] = a
            continue
        if (a, b) not in known:
            if len(known) >= NODES:
                known.clear()
            known[a, b] = _left(q, a, b, seed)
        left, mid = known[a, b], (a + b) // 2
        first = left[source[rows]]
        low = at < first
        todo += [(a, mid, left, at[low], rows[low]), (mid, b, q - left, (at - first)[~low], rows[~low])]
    return out


@dataclass
class Recipe:
    """Sources, in the order of their numbers, the blocks that each owes, and the number of shards."""

    sources: list[Source]
    quotas: np.ndarray
    shards: int
    seed: int
    block: int


def recipe(sizes: dict[str | None, int], block: int = BLOCK, shard: int = SHARD, seed: int = SEED, **share) -> Recipe:
    sources, quotas = [], []
    for k, (name, target) in enumerate((found := targets(sizes, **share)).items()):
        size, owed, turns, drawn = sizes[name], int(target), [], 0
        n = -(-size // block)
        for turn in range(-(-owed // size) if size else 0):
            a, c = 1, 0
            if n > 1:
                r = np.random.default_rng([seed, k, turn])
                c = int(r.integers(n))
                a = int(r.integers(1, min(n, 1 << 30)))
                while np.gcd(a, n) != 1:
                    a = a % (min(n, 1 << 30)) + 1
            short = (a * (n - 1) + c) % n if size % block else n
            need = min(size, owed - turn * size)
            turns.append((need, a, c, short, drawn))
            blocks = -(-need // block)
            drawn += blocks + (short < blocks < n and blocks * block - (block - size % block) < need)
        sources.append(Source(name, size, found[name], turns))
        quotas.append(drawn)
    order = sorted(range(len(sources)), key=lambda i: (sources[i].name is None, sources[i].name or ""))
    return Recipe([sources[i] for i in order], np.array([quotas[i] for i in order], np.int64), max(1, -(-sum(quotas) // shard)), seed, block)


def draws(plan: Recipe, src: np.ndarray, off: np.ndarray, size: np.ndarray, known: dict | None = None) -> tuple[np.ndarray, ...]:
    """What is drawn of documents at word `off` of their sources: document, turn, block, shard, start, length of each piece."""
    found, block = [], plan.block
    n = np.where(size > 0, (off + size - 1) // block - off // block + 1, 0)
    doc = np.repeat(np.arange(len(src)), n)
    b = off[doc] // block + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    for k, s in enumerate(plan.sources):
        mine = np.flatnonzero(src[doc] == k)
        blocks = -(-s.size // block)
        for turn, (need, a, c, short, first) in enumerate(s.turns):
            if not len(mine):
                continue
            d, at = doc[mine], b[mine]
            rank = (a * at + c) % blocks
            before = rank * block - np.where(rank > short, block - s.size % block, 0)
            whole = np.minimum(block, s.size - at * block)
            take = np.clip(need - before, 0, whole)
            lo = np.maximum(off[d], at * block)
            length = np.minimum(off[d] + size[d], at * block + take) - lo
            keep = length > 0
            drawn, inv = np.unique(first + rank[keep], return_inverse=True)
            shard = shards_of(plan.quotas, plan.shards, np.full(len(drawn), k), drawn, plan.seed, known)[inv]
            found.append((d[keep], np.full(keep.sum(), turn), at[keep], shard, (lo - off[d])[keep], length[keep]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    joined = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.lexsort((joined[4], joined[1], joined[0]))
    return tuple(x[order] for x in joined)


_PIECE = ArrayType(StructType([StructField("turn", IntegerType()), StructField("block", LongType()), StructField("shard", IntegerType()), StructField("start", LongType()), StructField("length", LongType())]))
_PIECE_TYPE = pa.list_(pa.struct([("turn", pa.int32()), ("block", pa.int64()), ("shard", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))


def _placed(docs: DataFrame, carry: bool, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, Recipe]:
    """Rows of docs (src, span, head, h, doc_id, source, size, source_size, target; carry: text, rest) in the order of their
    sources' words, each range of hashes in one partition behind a head row whose size tells where it begins; the recipe."""
    spark = docs.sparkSession
    text, source = F.col(C.quoted(text_col)), F.col(C.quoted(source_col)).cast("string")
    own = [F.col(C.quoted(id_col)).alias("doc_id"), source.alias("source"), F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(C.quoted(id_col)), text).alias("h")]
    parts = C.shards_for(docs, RANGE_BYTES)
    ranges = 1 << max(1, (16 * parts - 1).bit_length())  # many a partition, so that a large source deals out evenly
    span = F.shiftrightunsigned("h", 64 - ranges.bit_length() + 1).cast("long")
    sums = C.durable(docs.select(*own).groupBy("source", span.alias("span")).agg(F.sum("size").alias("n")))  # at most `ranges` rows a source
    sizes = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # a row a source
    plan = recipe(sizes, block, shard, seed, weights=weights, share=share, cap=cap)
    numbers = spark.createDataFrame([(s.name, k, s.size, s.target) for k, s in enumerate(plan.sources)], "name string, src int, source_size long, target double")
    numbered = lambda df: df.join(F.broadcast(numbers), df["source"].eqNullSafe(F.col("name"))).drop("name")  # noqa: E731  a row a source
    begins = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    heads = numbered(sums.select("source", "span", F.coalesce(F.sum("n").over(begins), F.lit(0)).alias("size")))
    rest = F.struct(F.lit(0).alias("_"), *[F.col(C.quoted(c)).alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col])
    rows = numbered(docs.select(*own, *[text.alias("text"), rest.alias("rest")] * carry).withColumn("span", span))
    rows = rows.withColumn("head", F.lit(False)).select(*_PLACED, *["text", "rest"] * carry)
    both = rows.unionByName(heads.withColumn("head", F.lit(True)).select("src", "span", "head", "source", "size", "source_size", "target"), allowMissingColumns=True)
    return both.repartition(parts, "src", "span").sortWithinPartitions("src", "span", F.desc("head"), "h", "doc_id"), plan


_PLACED = ["src", "span", "head", "h", "doc_id", "source", "size", "source_size", "target"]


def _offsets(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches without head rows; each row's source, word of its source where it begins, and size."""
    upto = 0
    for b in C.batches(it):
        if not b.num_rows:
            continue
        src, size = (b.column(_PLACED.index(c)).to_numpy().astype(np.int64) for c in ("src", "size"))
        head = b.column(_PLACED.index("head")).to_numpy(zero_copy_only=False)
        words = np.where(head, 0, size)
        off = np.cumsum(words) - words + upto
        if len(cut := np.flatnonzero(head)):  # from each head on, words count from where it says
            shift = np.zeros(len(src), np.int64)
            shift[cut] = np.diff(size[cut] - off[cut], prepend=0)
            off = off + np.cumsum(shift)
        upto = int(off[-1] + words[-1])
        keep = np.flatnonzero(~head)
        if len(keep):
            yield (b if len(keep) == len(src) else b.take(pa.array(keep))), src[keep], off[keep], size[keep]


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, pieces. how: see _placed().

    A source takes int(target) words exactly; a document at most cap times its words, rounded up to whole turns. Null text
    has no words and nothing of it is taken; a null source is a source of its own. Repeated rows are documents of their own;
    very long texts are cut at block ends like any other. No rows give no rows. Columns of docs may have any name.

    The order of a source's words follows hashes of doc_id and text, so that reruns agree. Hashes are cut into ranges; a
    first pass adds up the words of each source and range, which tells where every range begins. Those sums travel beside
    the documents of their range, so that each task knows its beginnings: neither the driver nor a broadcast holds them.
    Rows move once, without their texts.
    """
    dealt, plan = _placed(docs, False, **how)
    held = docs.sparkSession.sparkContext.broadcast(plan)  # a few numbers a source

    def draw(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b, src, off, size in _offsets(it):
            d, turn, at, to, start, length = draws(held.value, src, off, size, known)
            taken = np.bincount(d, length, len(src)).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(src)))]).astype(np.int32)
            parts = pa.StructArray.from_arrays([pa.array(turn.astype(np.int32)), pa.array(at), pa.array(to.astype(np.int32)), pa.array(start), pa.array(length)], fields=list(_PIECE_TYPE.value_type))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(taken), pa.ListArray.from_arrays(pa.array(ends), parts)], names=[*_PLACED, "taken", "pieces"])

    out = dealt.mapInArrow(draw, C.schema_of(dealt, taken=LongType(), pieces=_PIECE))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "pieces")


def materialize(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: columns of docs and _piece (shard, turn, start, length); a row a piece, its words of the text, shuffled
    within shards.

    A text that is taken whole stays as it is, a part of it is its span from first to last word. n_chars, if it is a column
    of docs, is counted again. Rows of a shard lie in one partition, ordered by hash. Texts move twice: to their range,
    where the pieces are drawn and cut, and to their shards.
    """
    if "text" not in docs.columns or "doc_id" not in docs.columns:
        raise ValueError("docs needs doc_id and text")
    names = docs.columns
    dealt, plan = _placed(docs, True, **how)
    held = docs.sparkSession.sparkContext.broadcast(plan)  # a few numbers a source
    t, r = len(_PLACED), len(_PLACED) + 1

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b, src, off, size in _offsets(it):
            d, turn, _, to, start, length = draws(held.value, src, off, size, known)
            if not len(d):
                continue
            texts = b.column(t).take(pa.array(d))
            if len(part := np.flatnonzero(length < size[d])):
                buf, offs = C.buffers(b.column(t))
                st, en, first = C.word_spans(buf, offs)
                texts = texts.to_pylist()
                for i in part.tolist():
                    x = first[d[i]] + start[i]
                    texts[i] = buf[st[x] : en[x + length[i] - 1]].tobytes().decode()
                texts = pa.array(texts, pa.string())
            place = [pa.array(x.astype(np.int32)) for x in (turn, to)] + [pa.array(start), pa.array(length)]
            yield pa.RecordBatch.from_arrays([b.column(_PLACED.index("doc_id")).take(pa.array(d)), *place, texts, b.column(r).take(pa.array(d))], names=["doc_id", "turn", "shard", "start", "length", "text", "rest"])

    fields = dealt.select("doc_id", "text", "rest").schema
    schema = StructType([fields["doc_id"], *[StructField(c, IntegerType()) for c in ("turn", "shard")], *[StructField(c, LongType()) for c in ("start", "length")], fields["text"], fields["rest"]])
    order = F.xxhash64(F.lit(how.get("seed", SEED)), "shard", "doc_id", "turn", "start")
    own = {c: F.col("text") if c == "text" else F.col("rest").getField(f"c{k}") for k, c in enumerate(names)}
    if "n_chars" in names:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    placed = dealt.mapInArrow(cut, schema).withColumn("order", order).repartition("shard").sortWithinPartitions("shard", "order")
    return placed.select(*[own[c].alias(c) for c in names], F.struct("shard", "turn", "start", "length").alias(C.free("_piece", docs)))


def op3(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix(C.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
