"""The facade: all metrics of one set of samples, each intermediate built once and only if a requested metric needs it."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangle.functions import fisher, scores
from tangle.operators import forest as F_
from tangle.operators import neighbors as N_
from tangle.operators import pairs, scaling, tiles
from tangle.plans.lineage import cut
from tangle.sources import samples as S

SUPPORTED_METRICS = ("F1", "N1", "N3", "kDN", "CM", "C1")
NEIGHBOR_METRICS = ("N3", "kDN", "CM", "C1")
EDGE_CUTOFF = pairs.CUTOFF
KNN_TIE_POLICY, TIE_POLICY = N_.KNN_TIE_POLICY, F_.TIE_POLICY


@dataclass(frozen=True)
class Result:
    """metrics in requested order, their mean, values by label or class, prevalence-weighted values, diagnostics."""

    metrics: dict[str, float]
    composite: float
    per_label: dict[str, dict[str, float]]
    label_weighted_metrics: dict[str, float]
    diagnostics: dict = field(default_factory=dict)

    def frame(self, spark) -> DataFrame:
        """(scope, label, metric, value)."""
        rows = [("overall", "", m, v) for m, v in self.metrics.items()] + [("overall", "", "composite", self.composite)]
        rows += [("label", n, m, v) for n, own in self.per_label.items() for m, v in own.items()]
        rows += [("weighted", "", m, v) for m, v in self.label_weighted_metrics.items()]
        return spark.createDataFrame(rows, "scope string, label string, metric string, value double")


def check_metrics(metrics) -> tuple[str, ...]:
    metrics = tuple(metrics)
    if not metrics:
        raise ValueError("metrics cannot be empty")
    if len(set(metrics)) != len(metrics):
        raise ValueError("metrics has duplicates")
    if odd := [m for m in metrics if m not in SUPPORTED_METRICS]:
        raise ValueError(f"Unsupported metrics: {odd}")
    return metrics


@dataclass
class Geometry:
    """Scaled samples and what is derived from them on demand, each once."""

    samples: S.Samples
    scaled: DataFrame
    lo: list[float]
    hi: list[float]
    range_source: str
    size: int = pairs.BLOCK
    passes: int = 0
    _found: list[tuple[int | None, float | None, DataFrame]] = field(default_factory=list)
    _some: bool | None = None

    def prepare(self, k: int | None = None, cutoff: float | None = None) -> DataFrame:
        """One pass over all distances for what is wanted of neighbours and forest, unless an earlier one has it."""
        if k is not None:
            N_.check_k(k, self.samples.n)
        if cutoff is not None:
            F_.check_cutoff(cutoff)
        for known, limit, found in self._found:
            if (k is None or known is not None and known >= k) and cutoff in (None, limit):
                return found
        found = cut(tiles.relations(self.scaled, k, cutoff, self.size, self.alike()))
        self.passes += 1
        self._found.append((k, cutoff, found))
        return found

    def knn(self, k: int) -> DataFrame:
        return tiles.neighbors_of(self.prepare(k=k)).filter(F.col("rank") <= k)

    def forest(self, cutoff: float = pairs.CUTOFF) -> DataFrame:
        return tiles.edges_of(self.prepare(cutoff=cutoff))

    def absent(self, cutoff: float = pairs.CUTOFF) -> int:
        """Pairs of samples that are no edges of the forest's graph."""
        return tiles.absent_of(self.prepare(cutoff=cutoff))

    def pairs(self) -> DataFrame:
        return pairs.pairwise(self.scaled, size=self.size)

    def alike(self) -> bool:
        """Whether rows may be equal."""
        if self._some is None:
            self._some = scaling.alike(self.scaled)
        return self._some

    def duplicates(self) -> DataFrame:
        return scaling.duplicate_groups(self.scaled)


def geometry(samples: S.Samples, *, reference_min=None, reference_max=None, precision: str = "float32", size: int = pairs.BLOCK) -> Geometry:
    """Scaled samples under fitted or frozen bounds. precision float64 scales and compares in double."""
    given = reference_min is not None or reference_max is not None
    lo, hi = (reference_min, reference_max) if given else scaling.matrix_bounds(samples.df)
    scaled = cut(scaling.scale_matrix(samples.df, lo, hi, precision=precision, width=samples.width))
    return Geometry(samples, scaled, list(lo), list(hi), "reference" if given else "input", size)


def _known_edges(edges: DataFrame, samples: S.Samples) -> DataFrame:
    ids = samples.df.select("id")
    ends = edges.selectExpr("explode(array(lo, hi)) as id")
    if not ends.join(ids, "id", "left_anti").isEmpty():
        raise ValueError("edges hold an unknown sample")
    return edges


def compute(
    df: DataFrame, id_col: str, features, labels, *, metrics=SUPPORTED_METRICS, neighbors: int = 5, multilabel: bool | None = None, label_names=None, reference_min=None, reference_max=None, precision: str = "float32", edge_cutoff: float = pairs.CUTOFF,
    prescaled: bool = False, knn_table: DataFrame | None = None, edges: DataFrame | None = None,
) -> Result:
    """The requested class-overlap scores of labelled samples.

    One validation pass, one scaling, at most one distance pass, for the neighbours and the forest together; F1 alone needs no
    distances. The driver receives a row a label, class or metric. prescaled: features are used as they are. knn_table
    (i, rank, j) and edges (lo, hi), if given, take the place of the neighbours and of the forest.
    """
    began, timings = time.perf_counter(), {}

    def lap(name: str) -> None:
        nonlocal began
        now = time.perf_counter()
        timings[name], began = round(1000 * (now - began), 3), now

    metrics = check_metrics(metrics)
    wanted = [m for m in metrics if m in NEIGHBOR_METRICS]
    samples = S.load(df, id_col, features, labels, multilabel=multilabel, label_names=label_names, neighbors=neighbors if wanted else None)
    if prescaled:
        geo = Geometry(samples, cut(samples.df), [0.0] * samples.width, [1.0] * samples.width, "given")
    else:
        geo = geometry(samples, reference_min=reference_min, reference_max=reference_max, precision=precision)
    lap("geometry")
    per: dict[str, dict[str, float]] = {n: {} for n in samples.valid}
    diagnostics = {
        "backend": "spark", "dtype": precision, "metrics_requested": list(metrics), "geometry_build_count": int(bool(wanted) or "N1" in metrics), "knn_build_count": int(bool(wanted)),
        "geometry": {"n_samples": samples.n, "n_features": samples.width, "range_source": geo.range_source, "constant_feature_count": sum(b <= a for a, b in zip(geo.lo, geo.hi, strict=True))}, "components": {}, "timings_ms": timings,
    }
    k = neighbors if set(wanted) - {"N3"} else 1
    if own_knn := bool(wanted) and knn_table is None:
        diagnostics["knn"] = {"algorithm": "exact_blocks", "tie_policy": KNN_TIE_POLICY, "self_exclusion": True, "zero_distance_duplicates_retained": True, "n_samples": samples.n, "max_k": k, "returned_distances": True}
    if own_forest := "N1" in metrics and edges is None:
        F_.check_cutoff(edge_cutoff)
    if own_knn or own_forest:
        groups, copies = scaling.duplicate_counts(geo.scaled, geo.alike())
        diagnostics["geometry"] |= {"exact_duplicate_group_count": groups, "exact_duplicate_pair_count": copies}
        geo.prepare(k if own_knn else None, edge_cutoff if own_forest else None)
        lap("distances")
    classes: dict[str, float] = {}
    if "F1" in metrics:
        got = fisher.f1(geo.scaled, samples.labels).collect()
        for r in got:
            per[r["label_name"]]["F1"] = r["value"]
        diagnostics["components"]["F1"] = {r["label_name"]: {"pair_feature_count": r["pairs"], "zero_denominator_count": r["zero_denominators"], "nonfinite_ratio_count": r["zero_denominators"], "class_pair_count": r["pairs"] // samples.width, "feature_count": samples.width} for r in got}
        counts = {n: {} for n in samples.valid}
        for r in samples.labels.groupBy("label_name", "y").count().collect():  # a row a label and class
            counts[r["label_name"]][r["y"]] = r["count"]
        for n, own in diagnostics["components"]["F1"].items():
            order = list(samples.class_names) if samples.class_names else ["0", "1"]
            own |= {"class_count": len(counts[n]), "class_values": order, "class_counts": [counts[n].get(c, 0) for c in order]}
        lap("F1")
    if wanted:
        table = geo.knn(k) if knn_table is None else N_.check_neighbors(knn_table, samples.df.select("id"), k)
        inst = cut(scores.instances(table, samples.labels, k))
        for r in scores.scores(inst, k).collect():
            own = per[r["label_name"]]
            own |= {m: r[m] for m in wanted}
            if "N3" in wanted and samples.multilabel:
                own |= {"N3_negative": r["N3_negative"], "N3_positive": r["N3_positive"], "N3_micro": r["N3_micro"]}
            diagnostics["components"].setdefault("neighbors", {})[r["label_name"]] = {c: r[c] for c in ("N3_error_count", "kDN_disagreement_count", "CM_hard_sample_count", "C1_instance_sum")} | {"neighbors_used": k, "neighbors_available": k}
            diagnostics["N3_micro" if not samples.multilabel else "N3_micro_label_macro"] = r["N3_micro"]
        if samples.multilabel:
            diagnostics["N3_micro_label_macro"] = sum(p["N3_micro"] for p in per.values()) / len(per) if "N3" in wanted else None
        elif "N3" in wanted:
            order = list(samples.class_names)
            by = sorted(scores.by_class(inst).collect(), key=lambda r: order.index(r["y"]))  # a row a class
            classes = {samples.class_names[r["y"]]: r["n3"] for r in by}
            diagnostics["components"]["neighbors"][""]["N3_class_error_counts"] = {samples.class_names[r["y"]]: r["errors"] for r in by}
        lap("neighbors")
    if "N1" in metrics:
        edges = geo.forest(edge_cutoff) if own_forest else _known_edges(edges, samples)
        count = edges.count()
        diagnostics["components"]["N1"] = {"edge_count": count, "component_count": samples.n - count, "mst_build_count": 1}
        for r in F_.n1_scores(edges, samples.labels).collect():
            per[r["label_name"]]["N1"] = r["value"]
        diagnostics["forest"] = {"algorithm": "boruvka", "tie_policy": TIE_POLICY, "edge_cutoff": edge_cutoff, "absent_or_zero_upper_edge_count": geo.absent(edge_cutoff) if own_forest else None}
        lap("N1")
    diagnostics["distance_pass_count"] = geo.passes
    if not samples.multilabel:
        values = {m: float(per[""][m]) for m in metrics}
        return Result(values, sum(values.values()) / len(values), {n: {"N3": v} for n, v in classes.items()}, {}, diagnostics)
    values = {m: sum(p[m] for p in per.values()) / len(per) for m in metrics}
    total = sum(samples.positives[n] for n in per)
    weighted = {m: sum(p[m] * samples.positives[n] for n, p in per.items()) / total for m in metrics}
    diagnostics |= {"valid_labels": list(samples.valid), "skipped_labels": list(samples.skipped), "positive_label_weights": {n: samples.positives[n] for n in samples.valid}}
    return Result(values, sum(values.values()) / len(values), per, weighted, diagnostics)
