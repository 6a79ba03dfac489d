"""Golden values, invariants, ties and invalid input of the class-overlap engine."""

import numpy as np
import pytest

from tangle.functions import scores
from tangle.operators import forest, neighbors, pairs, scaling, tiles
from tangle.plans import engine
from tangle.sources import samples

B = [[0.0, 0.0], [0.0, 0.0], [1.0, 0.0], [-1.0, 0.0]]
D = [[0, 0], [0.125, 0.25], [0.25, 0.125], [0.375, 0.5], [0.625, 0.5], [0.75, 0.875], [0.875, 0.75], [1, 1]]
E1 = [[0, 0], [0.1, 0.2], [0.8, 0.7], [1, 1]]
E2 = [[0, 0], [0.1, 0.15], [0.2, 0.05], [0.75, 0.8], [0.9, 0.85], [1, 1]]


def frame(spark, x, y=None):
    y = y if y is not None else [0] * len(x)
    return spark.createDataFrame([(i, [float(v) for v in row], label) for i, (row, label) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, y " + ("string" if isinstance(y[0], str) else "long"))


@pytest.mark.parametrize(
    ("x", "y", "k", "want", "composite"),
    [
        ([[0.0], [0.1], [0.9], [1.0]], [0, 0, 1, 1], 1, (1 / 163, 0.5, 0, 0, 0, 0), 0.084355829),
        (B, [0, 1, 0, 1], 3, (0.666666667, 1.0, 0.75, 0.666666667, 1.0, 0.680555556), None),
        (B, [0, 0, 1, 1], 3, (1.0, 1.0, 0.5, 0.666666667, 1.0, 0.638888889), None),
        (D, [0, 0, 1, 0, 1, 2, 2, 2], 3, (0.316650712, 0.625, 0.555555556, 0.541666667, 0.375, 0.493055556), 0.484488082),
        (E1, [0, 0, 1, 1], 2, (0.035814327, 0.5, 0, 0.5, 0, 0.25), 0.214302388),
        (E2, [0, 0, 0, 1, 1, 1], 3, (0.021843737, 0.333333333, 0, 0.333333333, 0, 0.111111111), 0.133270252),
    ],
)
def test_goldens(spark, x, y, k, want, composite):
    got = engine.compute(frame(spark, x, y), "id", "features", "y", neighbors=k)
    assert list(got.metrics) == list(engine.SUPPORTED_METRICS)
    assert list(got.metrics.values()) == pytest.approx(want, abs=2e-6)
    assert got.composite == pytest.approx(np.mean(want) if composite is None else composite, abs=2e-6)
    assert got.diagnostics["geometry_build_count"] == got.diagnostics["knn_build_count"] == 1


def test_knn_and_forest_of_duplicates(spark):
    z = scaling.fixed_range_scale(frame(spark, B).select("id", "features"))
    near = neighbors.knn(z.withColumn("features", z.features), 3).orderBy("i", "rank").collect()
    assert [[r.j for r in near if r.i == i] for i in range(4)] == [[1, 2, 3], [0, 2, 3], [0, 1, 3], [0, 1, 2]]
    assert near[0].w == 0
    assert {(r.lo, r.hi) for r in forest.forest(z).collect()} == {(0, 2), (0, 3), (1, 2)}


def test_multilabel(spark):
    x = [[0, 0], [0.2, 0.1], [0.4, 0.4], [0.6, 0.6], [0.8, 0.9], [1, 1]]
    y = zip([1, 0, 0, 0, 0, 1], [0] * 6, [1, 1, 1, 1, 0, 0], strict=True)
    df = spark.createDataFrame([(i, *map(float, a), *b) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, f0 double, f1 double, rare int, constant int, common int")
    got = engine.compute(df, "id", ["f0", "f1"], ["rare", "constant", "common"], neighbors=2)
    assert got.diagnostics["skipped_labels"] == ["constant"]
    assert list(got.per_label) == ["rare", "common"]
    assert [got.per_label["common"][m] for m in engine.SUPPORTED_METRICS] == pytest.approx([0.129074213, 0.333333333, 0, 0.25, 0, 0.125], abs=2e-6)
    assert list(got.metrics.values()) == pytest.approx([0.564537107, 0.5, 0.375, 0.375, 0.166666667, 0.354166667], abs=2e-6)
    assert list(got.label_weighted_metrics.values()) == pytest.approx([0.419382809, 0.444444444, 0.25, 0.333333333, 0.111111111, 0.277777778], abs=2e-6)
    assert {"N3_negative", "N3_positive"} <= set(got.per_label["rare"])


def test_frozen_bounds_do_not_clip(spark):
    df = frame(spark, [*E1, [1.5, -0.5]], [0, 0, 1, 1, 1])
    got = engine.compute(df, "id", "features", "y", neighbors=2, reference_min=[0, 0], reference_max=[1, 1])
    assert list(got.metrics.values()) == pytest.approx([0.450874127, 0.4, 0, 0.5, 0, 0.25], abs=2e-6)
    s = samples.load(df, "id", "features", "y")
    last = engine.geometry(s, reference_min=[0, 0], reference_max=[1, 1]).scaled.filter("id = 4").first()
    assert last.features == [1.5, -0.5]


def test_degenerate(spark):
    same = engine.compute(frame(spark, [[0, 5]] * 3, [0, 1, 1]), "id", "features", "y", metrics=("N1",))
    assert same.metrics["N1"] == 0
    assert same.diagnostics["components"]["N1"] == {"edge_count": 0, "component_count": 3, "mst_build_count": 1}
    split = engine.compute(frame(spark, [[0], [0], [1], [1]], [0, 0, 1, 1]), "id", "features", "y", metrics=("F1",))
    assert split.metrics["F1"] == 1.0
    assert split.diagnostics["geometry_build_count"] == 0
    zero = scaling.scale(spark.createDataFrame([(0, [-0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "id long, features array<float>"))
    assert [r.members for r in scaling.duplicate_groups(zero).collect()] == [[0, 1]]


def test_class_names(spark):
    got = engine.compute(frame(spark, [[0], [1], [2], [3]], ["a", "b", "a", "b"]), "id", "features", "y", metrics=("N3",), neighbors=1)
    assert list(got.per_label) == ["class_a", "class_b"]
    got = engine.compute(frame(spark, [[0], [1], [2], [3]], [0, 1, 0, 1]), "id", "features", "y", metrics=("N3",), neighbors=1, label_names=["no", "yes"])
    assert list(got.per_label) == ["no", "yes"]


def brute(x, k):
    """Neighbours and forest by sorting all pairs."""
    w = pairs.distances(x, x)
    n = len(x)
    near = {i: sorted((w[i, j], j) for j in range(n) if j != i)[:k] for i in range(n)}
    root, edges = list(range(n)), set()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for d, i, j in sorted((w[i, j], i, j) for i in range(n) for j in range(i + 1, n) if w[i, j] > 1e-8):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            edges.add((i, j))
    return near, edges


@pytest.mark.parametrize("alone", [0, 10**6])
def test_tie_grid_in_blocks(spark, alone):
    x = np.random.default_rng(1).integers(0, 6, (120, 2)).astype(float)
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, features array<float>").repartition(3)
    z = scaling.scale(df)
    near, edges = brute(np.float32(x / 5).astype(float), 4)
    if alone:
        got = neighbors.knn(z, 4, size=50).collect()
        assert {(r.i, r["rank"], r.j) for r in got} == {(i, k + 1, j) for i, v in near.items() for k, (_, j) in enumerate(v)}
    found = forest.spanning_forest(forest.candidate_edges(z, size=50), alone=alone)
    assert {(r.lo, r.hi) for r in found.collect()} == edges


def test_invariants(spark):
    r = np.random.default_rng(3)
    df = frame(spark, r.random((60, 3)).round(1).tolist(), r.integers(0, 3, 60).tolist())
    one = engine.compute(df, "id", "features", "y", neighbors=1)
    assert one.metrics["kDN"] == one.metrics["CM"] == one.metrics["C1"] == one.diagnostics["N3_micro"]
    a, b = (engine.compute(x, "id", "features", "y", neighbors=4).metrics for x in (df, df.orderBy("y", "id").repartition(5)))
    assert a == pytest.approx(b, abs=1e-12)


def test_precomputed(spark):
    z = scaling.scale(frame(spark, E2).select("id", "features"))
    p = pairs.check_precomputed(pairs.pairwise(z), 6)
    want = {(r.i, r["rank"], r.j) for r in neighbors.knn(z, 2).collect()}
    near = neighbors.knn_precomputed(p, 2)
    assert {(r.i, r["rank"], r.j) for r in near.collect()} == want
    assert neighbors.check_neighbors(near, z, 1).count() == 6
    with pytest.raises(ValueError, match="k ranks"):
        neighbors.check_neighbors(near, z, 3)
    with pytest.raises(ValueError, match="square"):
        pairs.check_precomputed(p.filter("i > 0"), 6)
    with pytest.raises(ValueError, match="negative"):
        pairs.check_precomputed(p.withColumn("w", -p.w), 6)
    labels = samples.load(frame(spark, E2, [0, 0, 0, 1, 1, 1]), "id", "features", "y").labels
    assert scores.scores(scores.instances(near, labels, 2), 2).first()["kDN"] == 0


@pytest.mark.parametrize(
    ("x", "y", "how", "error", "text"),
    [
        ([[0], [float("nan")]], [0, 1], {"metrics": ("F1",)}, ValueError, "finite"),
        ([[0], [1]], [0, 1], {"metrics": ()}, ValueError, "cannot be empty"),
        ([[0], [1]], [0, 1], {"metrics": ("F1", "F1")}, ValueError, "duplicates"),
        ([[0], [1]], [0, 1], {"metrics": ("unknown",)}, ValueError, "Unsupported"),
        ([[0], [0.5], [1]], [0, 1, 1], {"metrics": ("N3",), "neighbors": 0}, ValueError, "neighbors"),
        ([[0], [1]], [0, 1], {"multilabel": True}, ValueError, "two-dimensional"),
        ([[0], [1]], [0, 0], {"metrics": ("F1",)}, ValueError, "two classes"),
        ([[0], [1, 2]], [0, 1], {"metrics": ("F1",)}, ValueError, "two-dimensional"),
        ([[0]], [0], {"metrics": ("F1",)}, ValueError, "two samples"),
        ([[0], [1]], [0, 1], {"metrics": ("F1",), "reference_min": [0]}, ValueError, "together"),
        ([[0], [1]], [0, 1], {"metrics": ("F1",), "reference_min": [1], "reference_max": [0]}, ValueError, "below"),
        ([[0], [1]], [0, 1], {"metrics": ("F1",), "reference_min": [-3e38], "reference_max": [3e38]}, ValueError, "overflows"),
        ([[0], [1]], [0, 1], {"metrics": ("N1",), "edge_cutoff": -1.0}, ValueError, "edge_cutoff"),
    ],
)
def test_invalid(spark, x, y, how, error, text):
    with pytest.raises(error, match=text):
        engine.compute(frame(spark, x, y), "id", "features", "y", **how)


def test_invalid_columns(spark):
    df = frame(spark, E1, [0, 0, 1, 1])
    with pytest.raises(ValueError, match="two-dimensional"):
        engine.compute(df, "id", "y", "y")
    with pytest.raises(ValueError, match="same number of samples"):
        engine.compute(df.selectExpr("id", "features", "nullif(y, 0) as y"), "id", "features", "y")
    with pytest.raises(ValueError, match="unique"):
        engine.compute(df.selectExpr("id div 2 as id", "features", "y"), "id", "features", "y")
    with pytest.raises(TypeError):
        engine.compute(df.selectExpr("id", "cast(y as string) as s", "y"), "id", ["s"], "y")
    with pytest.raises(ValueError, match="label_names"):
        engine.compute(df.selectExpr("id", "features", "y", "1 - y as z"), "id", "features", ["y", "z"], label_names=["only_one"])
    with pytest.raises(TypeError):
        neighbors.check_k(True, 5)


def test_streaming_f1(spark, tmp_path):
    from pyspark.sql import functions as F

    from tangle.functions import fisher
    from tangle.streaming import frozen

    r = np.random.default_rng(5)
    x, y = r.random((90, 2)), r.integers(0, 3, 90)
    whole = frame(spark, x.tolist(), y.tolist())
    for part in range(3):
        whole.filter(F.col("id") % 3 == part).selectExpr("cast(features as array<float>) as features", "y as label").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("features array<float>, label long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    frozen.start(stream, [0, 0], [1, 1], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = fisher.pair_ratios(frozen.stats(spark.read.parquet(str(tmp_path / "out/2")))).agg(F.avg("term")).first()[0]
    want = engine.compute(whole, "id", "features", "y", metrics=("F1",), reference_min=[0, 0], reference_max=[1, 1]).metrics["F1"]
    assert got == pytest.approx(want, abs=1e-9)


def test_public_calls(spark):
    from tangle import api

    df = frame(spark, D, [0, 0, 1, 0, 1, 2, 2, 2])
    want = engine.compute(df, "id", "features", "y", neighbors=3).metrics
    geo = api.build_geometry(df, "id", "features", "y")
    table = api.build_knn_graph(geo, 3, return_distances=False)
    assert api.compute_neighbor_metrics(table, df, "id", "y", neighbors=3).metrics == pytest.approx({m: want[m] for m in api.NEIGHBOR_METRICS})
    distances = api.pairwise_distances(df, "id", "features")  # these features are scaled already
    edges = api.minimum_spanning_forest(distances)
    assert api.score_n1(edges, df, "id", "y").metrics["N1"] == want["N1"] == api.compute_n1(df, "id", "features", "y", precision="float64").metrics["N1"]
    assert api.compute_f1(df, "id", "features", "y").metrics["F1"] == pytest.approx(want["F1"], abs=1e-9)
    key = lambda x: sorted((r.i, r["rank"], r.j) for r in x.collect())
    assert key(api.build_knn_graph(distances, 3)) == key(table) == key(api.build_knn_graph_blockwise(df, 3, block_size=3))
    assert api.fixed_range_scale(df, "id", "features").count() == 8
    with pytest.raises(ValueError, match="unknown"):
        api.score_n1(edges.selectExpr("lo + 100 as lo", "hi", "w"), df, "id", "y")


def test_one_pass_and_diagnostics(spark):
    df = frame(spark, B, [0, 0, 1, 1])
    got = engine.compute(df, "id", "features", "y", neighbors=2).diagnostics
    assert got["distance_pass_count"] == got["geometry_build_count"] == got["knn_build_count"] == 1
    assert (got["geometry"]["exact_duplicate_group_count"], got["geometry"]["exact_duplicate_pair_count"]) == (1, 1)
    assert got["forest"]["absent_or_zero_upper_edge_count"] == 1
    assert got["knn"]["max_k"] == 2 and got["knn"]["self_exclusion"]
    f1 = got["components"]["F1"][""]
    assert (f1["class_values"], f1["class_counts"], f1["class_pair_count"], f1["feature_count"]) == (["0", "1"], [2, 2], 1, 2)
    assert sum(got["components"]["neighbors"][""]["N3_class_error_counts"].values()) == got["components"]["neighbors"][""]["N3_error_count"]
    assert {"geometry", "distances", "F1", "neighbors", "N1"} <= set(got["timings_ms"])
    assert engine.compute(df, "id", "features", "y", metrics=("F1",)).diagnostics["distance_pass_count"] == 0


@pytest.mark.parametrize("size", [1, 7, 64])
def test_blocks_of_any_size(spark, size):
    x = np.random.default_rng(6).integers(0, 4, (70, 3)).astype(float)
    z = spark.createDataFrame([(5 * i, list(map(float, r))) for i, r in enumerate(x)], "id long, features array<float>").repartition(4)
    near, edges = brute(x, 3)
    geo = tiles.relations(z, 3, 1e-8, size)
    geo = geo.cache()
    assert {(r.i, r["rank"], r.j) for r in tiles.neighbors_of(geo).collect()} == {(5 * i, k + 1, 5 * j) for i, v in near.items() for k, (_, j) in enumerate(v)}
    assert {(r.lo, r.hi) for r in forest.spanning_forest(tiles.edges_of(geo)).collect()} == {(5 * i, 5 * j) for i, j in edges}
    w = pairs.distances(x, x)
    assert tiles.absent_of(geo) == int(((w <= 1e-8).sum() - len(x)) // 2)
    assert pairs.pairwise(z, size=size).count() == 4900 and pairs.pairwise(z, directed=False, size=size).count() == 70 * 69 // 2


def test_short_label_names(spark):
    from tangle import api

    df = frame(spark, E2, [0, 0, 0, 1, 1, 1]).selectExpr("id", "features", "y", "1 - y as z")
    got = api.compute_f1(df, "id", "features", ["y", "z"], label_names=["first"])
    assert list(got.per_label) == ["first", "label_1"]
