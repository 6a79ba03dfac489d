"""Equal windows of a hot anchor meet, whichever batch and shard they come from."""

from brute import substrings as brute_substrings

from tangle.llm import substrings

PASSAGE = " ".join(f"shared{k}" for k in range(40))


def test_hot_anchors_of_several_batches_and_shards(spark, monkeypatch):
    rows = [(i, " ".join([*(f"a{i}x{k}" for k in range(20)), PASSAGE, *(f"b{i}x{k}" for k in range(20))])) for i in range(14)]
    # a batch that holds the passage twice and batches that hold it once
    cuts = [rows[13:14], rows[0:2], rows[2:3], rows[3:5], rows[5:6], rows[6:13]]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(cuts, len(cuts)).flatMap(lambda x: x), "doc_id long, text string")
    monkeypatch.setattr(substrings, "SHARD_WORDS", 40)
    want = brute_substrings(rows)
    for hot in (1, 5, substrings.HOT):
        got = {r.doc_id: r["_n_removed"] for r in substrings.dedup(docs, hot=hot).collect()}
        assert got == {i: w[1] for i, w in want.items()}, hot
    own = docs.selectExpr("doc_id as rk", "text")
    flags = substrings.shared_anchors(own, 13, 5, 1)
    marked = {a for r in flags.collect() for s, a in zip(r.starts, r.anchors, strict=True) if s < 0}
    assert marked == {a for r in flags.collect() for s, a in zip(r.starts, r.anchors, strict=True) if s >= 0}
