"""The pipeline's stages against plain versions."""

from brute import base_counts, fingerprint, groups, substrings as brute_substrings

import corpus_pipeline


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, docs, rows, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "substring_dedup", "mixing", "packing"]
    now, before = docs, {r[0]: r[1] for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, "")
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        got = texts(now) if k < 4 else None
        if name == "quality_rules":
            counts = {i: base_counts(t) for i, t in before.items()}
            passed = {i for i, c in counts.items() if c[0] >= 50 and 100 * c[4] <= 50 * c[0]}
            assert set(got) <= passed and len(got) >= 0.7 * len(passed)
            assert all(got[i] == before[i] for i in got)
        if name == "near_duplicates":
            group = groups([(i, fingerprint(t)) for i, t in before.items()])
            assert set(got) == set(group.values()) and now.count() == len(got)
        if name == "substring_dedup":
            want = brute_substrings(before.items())
            assert {i: len(t.split()) for i, t in got.items()} == {i: w[0] - w[1] for i, w in want.items()}
            assert all(r.n_chars == len(r.text) for r in now.collect())
        if name == "mixing":
            assert set(got) <= set(before)
            words = sum(len(r.text.encode().split()) for r in now.collect())
            assert 1.45 * sum(len(t.encode().split()) for t in before.values()) <= words + 10
        before = got
    assert now.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").isEmpty()


def test_nulls_and_nothing(spark, odd, nothing):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, "").count()
        assert stage(spark, nothing, "").count() == 0
