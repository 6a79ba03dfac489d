"""What the search over all pairs leaves out: distances, copies, blocks and edges that cannot count."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tangle import queries
from tangle.operators import forest, neighbors, pairs, scaling, tiles

from test_engine import brute, frame


def test_forest_of_given_distances_reduces_before_anything_meets(spark, monkeypatch):
    """F1 (msf_precomputed): what is kept of n(n - 1)/2 pairs is a forest a task."""
    x = np.random.default_rng(7).random((200, 3))
    given = pairs.pairwise(frame(spark, x).select("id", "features"), directed=False)
    kept, real = [], forest._checkpoint

    def checkpoint(df):
        kept.append((out := real(df)).count())
        return out

    monkeypatch.setattr(forest, "_checkpoint", checkpoint)
    assert {(r.lo, r.hi) for r in forest.spanning_forest(given, alone=5000).collect()} == brute(x, 1)[1]
    assert max(kept) <= 199 * given.rdd.getNumPartitions() < 200 * 199 // 2


def test_forest_of_given_distances_takes_tiles(spark, tmp_path, monkeypatch):
    """F2 (msf_precomputed): distances go from task to task in tiles, no row each, and none is left out."""
    made, real = [], pairs.against_blocks
    monkeypatch.setattr(pairs, "against_blocks", lambda *a, **how: made.append(out := real(*a, **how)) or out)
    x = np.random.default_rng(11).random((90, 3)).astype(np.float32)
    spark.createDataFrame([(k, v.tolist(), k % 2) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    scaled = (x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0))
    assert {(r.lo, r.hi) for r in queries.QUERIES["msf_precomputed"](spark, str(tmp_path)).collect()} == brute(scaled, 1)[1]
    tiles_ = [(np.frombuffer(r.i, np.int64), np.frombuffer(r.j, np.int64), len(r.w) // 8) for r in made[0].collect()]
    assert len(tiles_) < 90 and all(n == len(i) * len(j) for i, j, n in tiles_)
    assert {(min(a, b), max(a, b)) for i, j, _ in tiles_ for a in i for b in j if a != b} == {(a, b) for b in range(90) for a in range(b)}


@pytest.mark.parametrize("size, gather, keep, cutoff", [(7, 1, 10**6, 1e-8), (40, 50, 10**6, 0.3), (16, 1 << 20, 5, 0.0)])
def test_tiles_of_a_matrix_leave_a_forest(monkeypatch, size, gather, keep, cutoff):
    """F2 (msf_precomputed): ties, distances that are no edges, any tiles, each pair once or both ways."""
    r = np.random.default_rng(size)
    x, ids = r.integers(0, 5, (60, 2)).astype(float), r.permutation(500)[:60]
    w = pairs.distances(x, x)
    odd = r.random(w.shape) < 0.2
    w[odd | odd.T] = np.inf if size > 7 else np.nan
    monkeypatch.setattr(forest, "GATHER", gather)
    monkeypatch.setattr(forest, "KEEP", keep)
    lo, hi = np.minimum.outer(ids, ids), np.maximum.outer(ids, ids)
    edge = np.triu((w > cutoff) & (w < np.inf), 1)
    own = tiles.local_forest(lo[edge], hi[edge], w[edge])
    want = set(zip(lo[edge][own], hi[edge][own], w[edge][own], strict=True))
    for both in (False, True):
        cut = [[v.tobytes() for v in (ids[a : a + size], ids[c : c + size], w[a : a + size, c : c + size])] for a in range(0, 60, size) for c in range(0 if both else a, 60, size)]
        batches = (pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in t], names=["i", "j", "w"]) for t in cut)
        got = [np.concatenate(c) for c in zip(*([c.to_numpy() for c in b.columns] for b in forest._reduced_tiles(cutoff)(batches)), strict=True)]
        if keep < 60:  # several forests left the task
            got = [c[np.unique(np.stack([got[0], got[1]]), axis=1, return_index=True)[1]] for c in got]
            got = [c[k] for k in [tiles.local_forest(*got)] for c in got]
        assert sorted(zip(*got, strict=True)) == sorted(want)


@pytest.fixture
def work(monkeypatch):
    """What a task does, run here: neighbours of blocks of 0 of all blocks."""

    def run(blocks, *args, **how):
        got = {}
        monkeypatch.setattr(pairs, "against_blocks", lambda rows, work, *a, **b: got.update(work=work))
        tiles.search(None, *args, **how)
        return list(got["work"](blocks[0], iter(blocks)))

    return run


def test_search_computes_few_distances(work, monkeypatch):
    """F3, F5, F9 (cm, c1, neighbor_prefix_sweep): exact distances of pairs that may be among the nearest alone."""
    x, exact, count = np.random.default_rng(8).random((3000, 16)), tiles._exact, []
    monkeypatch.setattr(tiles, "_exact", lambda q, x, i, j: count.append(len(i)) or exact(q, x, i, j))
    got = work([(k, np.arange(k, 3000, 3), x[k::3], {}) for k in range(3)], 4)
    near = {(i, r, j): w for kind, *c in got for z, i, j, r, w in zip(kind, *c, strict=True) if z == tiles.NEIGHBOR}
    w = pairs.distances(x[::3], x)
    w[np.arange(1000), np.arange(0, 3000, 3)] = np.inf
    want = {(3 * i, r + 1, j): w[i, j] for i in range(1000) for r, j in enumerate(np.lexsort((np.arange(3000), w[i]))[:4])}
    assert near == want
    assert sum(count) < 0.02 * 3e6


def test_small_blocks_do_not_multiply_what_is_moved(spark):
    """F12 (knn_blockwise): every block is sent to each, so a small size must not make more of them than cores need."""
    df = frame(spark, np.random.default_rng(9).random((600, 2))).select("id", "features")
    assert pairs.packed(df, 1)[1] <= 4 * spark.sparkContext.defaultParallelism
    near, _ = brute(np.array([r.features for r in df.orderBy("id").collect()]), 2)
    assert {(r.i, r["rank"], r.j) for r in neighbors.knn(df, 2, size=1).collect()} == {(i, k + 1, j) for i, v in near.items() for k, (_, j) in enumerate(v)}


def test_copies_meet_as_one(spark, monkeypatch):
    """F13 (knn_tie_break): of many copies the k + 1 least ids enter the search, and all get their neighbours."""
    df = spark.range(3000).selectExpr("(id * 7919) % 3000 as id", "array(cast((id * 7919) % 3000 % 6 as float)) as features")
    sent, real = [], pairs.packed
    monkeypatch.setattr(pairs, "packed", lambda rows, size: sent.append(rows.count()) or real(rows, size))
    got = {}
    for r in neighbors.knn(scaling.scale(df, width=1), 3).collect():
        got.setdefault(r.i, {})[r["rank"]] = (r.j, r.w)
    assert sent == [24]
    assert got == {i: {r + 1: (j, 0.0) for r, j in enumerate([c for c in range(i % 6, 3000, 6) if c != i][:3])} for i in range(3000)}


@pytest.mark.parametrize("many", [False, True])
def test_forest_of_clusters_and_copies(spark, many):
    """F6, F7, F15, F16 (msf_summary, n1, n1_boundary_samples, n1_multilabel): clusters whose listed neighbours all lie inside
    are joined by further searches; copies are leaves."""
    r = np.random.default_rng(10)
    x = np.concatenate([r.random((40, 2)).round(1 if many else 6) + 50 * r.random(2) for _ in range(5)])
    r.shuffle(x)
    z = frame(spark, x).select("id", "features").repartition(3)
    found = tiles.relations(z, 3, 1e-8, 16).cache()
    near, edges = brute(x, 3)
    assert {(e.lo, e.hi) for e in tiles.edges_of(found).collect()} == edges
    assert {(e.i, e["rank"], e.j) for e in tiles.neighbors_of(found).collect()} == {(i, k + 1, j) for i, v in near.items() for k, (_, j) in enumerate(v)}
    w = pairs.distances(x, x)
    assert tiles.absent_of(found) == int(((w <= 1e-8).sum() - len(x)) // 2)
    assert {(e.lo, e.hi) for e in forest.forest(z).collect()} == edges


def test_given_matrix_in_one_pass(spark, monkeypatch):
    """F10 (precomputed_distance_knn): of n * n distances, k a sample leave the tasks, with the checks of the same pass."""
    from tangle.plans import lineage

    x = np.random.default_rng(11).integers(0, 6, (300, 2)).astype(float)
    tiles_ = pairs.matrix(frame(spark, x).select("id", "features"), size=64)
    kept, real = [], lineage.cut
    monkeypatch.setattr(lineage, "cut", lambda df: kept.append((out := real(df)).count()) or out)
    got = {(r.i, r["rank"], r.j) for r in neighbors.knn_matrix(tiles_, 300, 4).collect()}
    assert got == {(i, k + 1, j) for i, v in brute(x, 4)[0].items() for k, (_, j) in enumerate(v)}
    blocks = tiles_.select("i").distinct().count()
    assert len(kept) == 1 and kept[0] <= 300 * (4 + 1) + blocks * 301
    with pytest.raises(ValueError, match="square"):
        neighbors.knn_matrix(tiles_.limit(blocks * blocks - 1), 300, 4)
    negative = spark.createDataFrame([(np.arange(2).tobytes(), np.arange(2).tobytes(), np.array([0.0, v, v, 0.0]).tobytes()) for v in (-1.0,)], "i binary, j binary, w binary")
    with pytest.raises(ValueError, match="negative"):
        neighbors.knn_matrix(negative, 2, 1)
    with pytest.raises(ValueError, match="finite"):
        neighbors.knn_matrix(negative.select("i", "j", F.lit(np.array([0.0, np.nan, 1.0, 0.0]).tobytes()).alias("w")), 2, 1)


def test_ordered_runs_lie_close():
    """F16 (n1_multilabel): runs of the order have small boxes, and each row has one place."""
    x = np.random.default_rng(12).random((4000, 2))
    order = tiles._ordered(x, 100)
    assert sorted(order) == list(range(4000))
    low, high = tiles._boxes(x[order], 100)
    assert (high - low).max() < 0.5 and (high - low).prod(axis=1).sum() < 2


def test_far_runs_do_not_meet(work, monkeypatch):
    """F4, F14, F16 (multilabel_weighted, multilabel_macro, n1_multilabel): with few features most pairs need not be compared."""
    x, met, of = np.random.default_rng(13).random((6000, 2)), [], tiles._Product.of
    monkeypatch.setattr(tiles._Product, "of", lambda self, a, b: met.append((a.stop - a.start) * (b.stop - b.start)) or of(self, a, b))
    got = work([(k, np.arange(k, 6000, 2), x[k::2], {"m": np.ones(3000, int)}) for k in range(2)], 5, cutoff=0.001)
    w = pairs.distances(x[::2], x)
    absent = (w <= 0.001).sum() - 3000
    w[np.arange(3000), np.arange(0, 6000, 2)] = np.inf
    near = {(i, r, j) for kind, *c in got for z, i, j, r in zip(kind, *c[:3], strict=True) if z == tiles.NEIGHBOR}
    assert near == {(2 * i, r + 1, j) for i in range(3000) for r, j in enumerate(np.lexsort((np.arange(6000), w[i]))[:5])}
    assert absent == 2 * next(c[-1][0] for c in got if c[0][0] == tiles.ABSENT)
    assert sum(met) < 0.5 * 3000 * 6000


def test_single_precision_where_it_is_fine_enough(work, monkeypatch):
    """F2, F3, F5, F8, F9, F11 (all_metrics, cm, c1, n1_float64, neighbor_prefix_sweep, diagnostics): most products are in single
    precision, of far from centred rows too, and the neighbours stay exact."""
    x, kinds, of = 100 + np.random.default_rng(14).random((3000, 32)), [], tiles._Product.of
    monkeypatch.setattr(tiles._Product, "of", lambda self, a, b: kinds.append(self.kind) or of(self, a, b))
    got = work([(k, np.arange(k, 3000, 2), x[k::2], {}) for k in range(2)], 4)
    near = {(i, r, j): v for kind, *c in got for z, i, j, r, v in zip(kind, *c, strict=True) if z == tiles.NEIGHBOR}
    w = pairs.distances(x[::2], x)
    w[np.arange(1500), np.arange(0, 3000, 2)] = np.inf
    assert near == {(2 * i, r + 1, j): w[i, j] for i in range(1500) for r, j in enumerate(np.lexsort((np.arange(3000), w[i]))[:4])}
    assert kinds.count(np.float32) > 0.8 * len(kinds)


def test_open_rows_share_few_blocks(spark):
    """F6, F7, F8, F15 (msf_summary, n1, n1_float64, n1_boundary_samples): where few rows are searched for, the samples move
    once for each of their few blocks, not for all."""
    rows = frame(spark, np.random.default_rng(15).random((3000, 2))).selectExpr("id", "features", "id % 2 as part", "cast(id % 100 = 0 as int) as open")
    blocks, count, tasks = pairs.packed(rows, 64, "open")
    held = {r.blk: np.frombuffer(r.ids, np.int64) for r in blocks.collect()}
    assert tasks == 1 < count and set(held[0]) == set(range(0, 3000, 100)) and sum(map(len, held.values())) == 3000
    x = np.array([r.features for r in rows.orderBy("id").collect()])
    w = np.where((np.arange(3000) % 2 == 1)[None], pairs.distances(x[::100], x), np.inf)
    want = {(100 * i, r + 1, j) for i in range(30) for r, j in enumerate(np.lexsort((np.arange(3000), w[i]))[:3])}
    got = tiles.search(rows, 3, cutoff=0.0, apart=True, size=64).filter(F.col("kind") == tiles.NEIGHBOR).collect()
    assert {(r.i, r["rank"], r.j) for r in got} == want


def test_texts_are_read_once(spark):
    """F4, F14, F16 (multilabel_weighted, multilabel_macro, n1_multilabel): words are counted once, not by each of the jobs."""
    from tangle import queries

    s = queries._doc_samples(spark, "/root/testdata/sf0.001")
    assert "regexp_count" not in s.df._jdf.queryExecution().toString() + s.labels._jdf.queryExecution().toString()


@pytest.mark.parametrize("precision", ["float32", "float64"])
def test_one_task_finishes_a_small_forest(spark, monkeypatch, precision):
    """F2, F6, F7, F8, F11, F15 (all_metrics, msf_summary, n1, n1_float64, diagnostics, n1_boundary_samples): one search of all
    pairs, no rounds after it; the rounds that larger samples need give the same forest."""
    rng = np.random.default_rng(21)
    x = (rng.random((40, 3))[:, None] + 1e-3 * rng.random((40, 15, 3))).reshape(-1, 3)
    scaled = scaling.scale(frame(spark, x).select("id", "features"), width=3, precision=precision)
    calls, real = [], tiles.search
    monkeypatch.setattr(tiles, "search", lambda *a, **b: calls.append(1) or real(*a, **b))
    got = {(r.lo, r.hi, r.w) for r in forest.forest(scaled).collect()}
    assert len(calls) == 1 and len(got) == 599
    values = np.array([r.features for r in scaled.orderBy("id").collect()], np.float64)
    assert {e[:2] for e in got} == brute(values, 1)[1]
    for name in ("ALONE_BYTES", "MET"):
        monkeypatch.setattr(tiles, name, 0)
        calls.clear()
        assert {(r.lo, r.hi, r.w) for r in forest.forest(scaled).collect()} == got and len(calls) > 1


def test_distinct_rows_do_not_move_to_be_told_apart(spark, monkeypatch):
    """F12 (knn_blockwise): a block a core at most where these suffice; rows are gathered by their features only where some may be equal."""
    df = frame(spark, np.random.default_rng(22).random((600, 2))).select("id", "features")
    assert pairs.packed(df, 1)[1] <= spark.sparkContext.defaultParallelism
    calls, real = [], tiles._copies
    monkeypatch.setattr(tiles, "_copies", lambda *a: calls.append(1) or real(*a))
    assert neighbors.knn(df, 2).count() == 1200 and not calls
    twice = df.filter("id < 3").unionByName(df.filter("id = 0").selectExpr("id + 700 as id", "features"))
    assert {(r.i, r.j) for r in neighbors.knn(twice, 1).collect()} >= {(0, 700), (700, 0)} and calls == [1]


def test_more_blocks_than_cores_keep_all_cores_busy(spark, monkeypatch):
    """F4, F14 (multilabel_weighted, multilabel_macro): a count of blocks that leaves cores idle in its last wave is raised."""
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(pairs, "BLOCK", 10)
    df = frame(spark, np.random.default_rng(23).random((10 * cores + 1, 2))).select("id", "features")
    assert pairs.packed(df)[1] == 2 * cores


def test_runs_meet_together(work, monkeypatch):
    """F5, F9 (c1, neighbor_prefix_sweep): runs of rows next to each other meet in one product of matrices."""
    x, calls, of = np.random.default_rng(24).random((20 * 256, 64)), [], tiles._Product.of
    monkeypatch.setattr(tiles._Product, "of", lambda self, *a: calls.append(1) or of(self, *a))
    blocks = [(0, np.arange(256), x[:256], {}), (1, np.arange(256, len(x)), x[256:], {})]
    got = work(blocks, 4)
    assert len(calls) < 14
    near = {(i, r, j) for kind, *c in got for z, i, j, r, _ in zip(kind, *c, strict=True) if z == tiles.NEIGHBOR}
    w = pairs.distances(x[:256], x)
    w[np.arange(256), np.arange(256)] = np.inf
    assert near == {(i, r + 1, j) for i in range(256) for r, j in enumerate(np.lexsort((np.arange(len(x)), w[i]))[:4])}


def test_words_are_counted_as_the_expression_does():
    """F4, F14 (multilabel_weighted, multilabel_macro): words of texts as bytes, of slices too."""
    import re

    import pyarrow as pa

    from tangle import queries

    texts = ["", None, " ", "a", " a", "a ", "a b", "  a  b ", "é ñ  漢字", "x\ny z", "a", "", "b", " "]
    rows = pa.RecordBatch.from_arrays([pa.array(range(14)), pa.array(range(14)), pa.array(texts)], names=["doc_id", "n_chars", "text"])
    for first, n in ((0, 14), (3, 8), (0, 1), (0, 0)):
        got = next(queries._counted(iter([rows.slice(first, n)]))).column(2).to_pylist()
        assert got == [None if t is None else len(re.findall("[^ ]+", t)) for t in texts[first : first + n]]


def test_lone_task_orders_its_rows_once(work, monkeypatch):
    """F6, F7, F8, F15 (msf_summary, n1, n1_float64, n1_boundary_samples): a task that finishes the forest alone does not order
    and convert all rows again for each search of a few; the forest stays exact."""
    import pyarrow as pa

    rng = np.random.default_rng(31)
    x = (rng.random((40, 3))[:, None] + 1e-3 * rng.random((40, 15, 3))).reshape(-1, 3)
    found = [np.concatenate(c) for c in zip(*work([(0, np.arange(600), x, {"m": np.ones(600, int)})], tiles.LISTED, cutoff=1e-8), strict=True)]
    real = (found[0] == tiles.BOUND) | (found[0] == tiles.NEIGHBOR)
    none = pa.nulls(int(real.sum()), pa.binary())
    names = [c.split()[0] for c in tiles._SCHEMA.split(", ")] + ["ids", "x"]
    lists = pa.RecordBatch.from_arrays([*[pa.array(c[real]) for c in found], none, none], names=names)
    block = [[v] for v in (tiles.ABSENT, 0, 0, 0, 0.0, np.arange(600).tobytes(), x.tobytes())]
    block = pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(block, lists.schema, strict=True)], names=names)
    calls, ordered = [], tiles._ordered
    monkeypatch.setattr(tiles, "_ordered", lambda *a: calls.append(1) or ordered(*a))
    kind, i, j = (c.to_numpy() for c in next(iter(tiles._alone(1e-8, np.float64, pairs.BLOCK)(iter([lists, block])))).columns[:3])
    assert {(a, b) for k, a, b in zip(kind, i, j, strict=True) if k == tiles.EDGE} == brute(x, 1)[1]
    assert len(calls) == 1


@pytest.mark.parametrize("cutoff", [0.0, 0.2])
def test_search_outside_of_parts(work, cutoff):
    """F6 (msf_summary): rows of the same part and pairs that are no edges never enter, where few are near and where many are."""
    rng = np.random.default_rng(32)
    x, part, open_ = rng.random((1500, 3)), np.sort(rng.integers(0, 9, 1500)), (rng.random(1500) < 0.3).astype(np.int64)
    blocks = [(b, np.arange(b, 1500, 3), x[b::3], {"open": open_[b::3], "part": part[b::3]}) for b in range(3)]
    got = {(i, r): (j, w) for kind, *c in work(blocks, 4, cutoff=cutoff, apart=True) for z, i, j, r, w in zip(kind, *c, strict=True) if z == tiles.NEIGHBOR}
    w = pairs.distances(x, x)
    w[(part[:, None] == part) | (w <= cutoff)] = np.inf
    assert got == {(i, r + 1): (j, w[i, j]) for i in range(0, 1500, 3) if open_[i] for r, j in enumerate(np.lexsort((np.arange(1500), w[i]))[:4])}


def test_rows_are_told_apart_once(spark, monkeypatch):
    """F2, F11 (all_metrics, diagnostics): one look at the hashes of the rows serves the counts of copies and the search."""
    from tangle.plans import engine

    x, calls, real = np.random.default_rng(33).random((60, 3)), [], scaling.alike
    for module in (scaling, tiles):
        monkeypatch.setattr(module, "alike", lambda df: calls.append(1) or real(df))
    got = engine.compute(frame(spark, x).selectExpr("id", "features", "id % 3 as label"), "id", "features", "label", neighbors=3)
    assert calls == [1] and got.diagnostics["geometry"]["exact_duplicate_group_count"] == 0 and got.diagnostics["distance_pass_count"] == 1


def test_a_finished_forest_is_not_reduced_again(spark, monkeypatch):
    """F7, F15 (n1, n1_boundary_samples): what the search gives is the forest."""
    from tangle.plans import engine
    from tangle.sources import samples

    x = np.random.default_rng(34).integers(0, 9, (120, 2)).astype(float)
    monkeypatch.setattr(forest, "spanning_forest", None)
    g = engine.geometry(samples.load(frame(spark, x).selectExpr("id", "features", "id % 2 as label"), "id", "features", "label"))
    values = np.array([r.features for r in g.scaled.orderBy("id").collect()], np.float64)
    assert {(r.lo, r.hi) for r in g.forest().collect()} == brute(values, 1)[1]


@pytest.mark.parametrize("precision", ["float32", "float64"])
def test_samples_are_scaled_by_batches(spark, monkeypatch, precision):
    """F2, F8, F12 (all_metrics, n1_float64, knn_blockwise): the plan does not hold an expression a feature; values are the same bits."""
    from tangle.plans import engine
    from tangle.sources import samples

    x = np.random.default_rng(35).normal(size=(300, 7)) * [1e-30, 1, 1, 1e30, 0, 3, 1]
    x[:5, 1] = -0.0
    s = samples.load(frame(spark, x).selectExpr("id", "features", "id % 2 as label"), "id", "features", "label")
    for given in ({}, {"reference_min": [-1e-31] * 7, "reference_max": [1e-31] * 7}, {"reference_min": [0.0] * 7, "reference_max": [1.0, 0.0, 2.0, 3.0, 4.0, 5.0, 0.1]}):
        lo, hi = given.values() if given else scaling.bounds(s.df)
        want = scaling.scale(s.df, lo, hi, precision=precision, width=7).orderBy("id").collect()
        with monkeypatch.context() as m:
            m.setattr(scaling, "scale", None)
            got = engine.geometry(s, precision=precision, **given)
        assert not given and (got.lo, got.hi) == (lo, hi) or given
        rows = got.scaled.orderBy("id").collect()
        assert [r.id for r in rows] == [r.id for r in want]
        assert np.array([r.features for r in rows]).tobytes() == np.array([r.features for r in want]).tobytes()


def test_scores_read_the_neighbours_once(spark):
    """F5 (c1): all scores come from one pass over the instances, without a join of two."""
    from tangle.functions import scores

    rows = [("", i, str(i % 2), i % 3 % 2, i % 4, i / 7, int(i % 4 > 1)) for i in range(10)]
    got = scores.scores(spark.createDataFrame(rows, "label_name string, i long, y string, error int, disagree long, c1 double, hard int"), 3)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    r, mean = got.first(), lambda v: sum(v) / len(v)
    zero, one = (mean([x[3] for x in rows if x[2] == y]) for y in "01")
    assert (r.N3, r.N3_negative, r.N3_positive, r.N3_error_count) == (pytest.approx((zero + one) / 2), zero, one, sum(x[3] for x in rows))
    assert [r.N3_micro, r.kDN, r.CM, r.C1] == pytest.approx([mean([x[3] for x in rows]), mean([x[4] for x in rows]) / 3, mean([x[6] for x in rows]), mean([x[5] for x in rows])])


def test_all_prefixes_in_one_pass(spark):
    """F9 (neighbor_prefix_sweep): the neighbours meet the labels once, not once for each k."""
    from tangle import queries
    from tangle.functions import scores

    plan = queries.QUERIES["neighbor_prefix_sweep"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2
    rng = np.random.default_rng(36)
    near = spark.createDataFrame([(i, r + 1, int(j)) for i in range(30) for r, j in enumerate(rng.permutation([k for k in range(30) if k != i])[:4])], "i long, rank int, j long")
    labels = spark.createDataFrame([(i, n, str((i * 7 + len(n)) % 3 % 2)) for i in range(30) for n in ("a", "bb")], "id long, label_name string, y string")
    both = scores.scores(scores.sweep(near, labels, [1, 2, 4]))
    for k in (1, 2, 4):
        want = {r.label_name: r.asDict() for r in scores.scores(scores.instances(near, labels, k), k).collect()}
        got = {r.label_name: {c: v for c, v in r.asDict().items() if c != "k"} for r in both.filter(f"k = {k}").collect()}
        assert got.keys() == want.keys() == {"a", "bb"}
        for n in got:
            assert {c: v for c, v in got[n].items() if c != "label_name"} == pytest.approx({c: v for c, v in want[n].items() if c != "label_name"})


def test_eight_runs_meet_together(work, monkeypatch):
    """F12 (knn_blockwise): runs next to each other meet in one product, eight at once, and the neighbours stay exact."""
    x, calls, of = np.random.default_rng(37).random((65 * 256, 64)), [], tiles._Product.of
    monkeypatch.setattr(tiles._Product, "of", lambda self, *a: calls.append(1) or of(self, *a))
    got = work([(0, np.arange(256), x[:256], {}), (1, np.arange(256, len(x)), x[256:], {})], 4)
    assert len(calls) <= 12
    near = {(i, r, j) for kind, *c in got for z, i, j, r, _ in zip(kind, *c, strict=True) if z == tiles.NEIGHBOR}
    w = pairs.distances(x[:256], x)
    w[np.arange(256), np.arange(256)] = np.inf
    assert near == {(i, r + 1, j) for i in range(256) for r, j in enumerate(np.lexsort((np.arange(len(x)), w[i]))[:4])}
