"""Operators against brute force on a small corpus, with nulls, empty and long texts, repeats and clashing columns."""

import zlib

import numpy as np
import pytest
from brute import base_counts, fingerprint, groups, substrings as brute_substrings, topk as brute_topk
from pyspark.sql import functions as F

from tangle.llm import common, fertility, htmltext, mixing, packing, quality, simhash, substrings, topk, toxicity, urlrules


def write(df, path, name="documents"):
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("hot", [substrings.HOT, 1])
def test_substrings(docs, rows, hot):
    left = substrings.dedup(docs, hot=hot).collect()
    want = brute_substrings({r[0]: (r[0], r[1]) for r in rows}.values())
    assert len(left) == len(rows)
    for r in left:
        assert (r["_n_words"], r["_n_removed"]) == want[r.doc_id][:2], r.doc_id
        assert sum(s["end"] - s["start"] for s in r["_spans"]) == r["_n_removed"]
    import pyarrow as pa

    assert {r.doc_id: h for r, h in zip(left, substrings.kept_hash(pa.array([r.text for r in left], pa.string())).to_pylist(), strict=True)} == {i: w[2] for i, w in want.items()}
    assert next(r for r in left if r.doc_id == 60).text is None


def test_substrings_odd(odd, nothing):
    left = {r.doc_id: r for r in substrings.dedup(odd).filter("doc_id is not null").collect()}
    assert left[0]["_n_removed"] == 0
    last = substrings.dedup(odd).filter("doc_id is null and text is not null").first()
    assert last["_n_removed"] == last["_n_words"] > 0  # no id: after all others
    assert last["row"] == "a"
    assert substrings.dedup(nothing).count() == 0
    with pytest.raises(ValueError, match="window"):
        substrings.dedup(nothing, window=8)


def test_near_duplicates(docs, rows, odd, nothing, spark, tmp_path):
    got = simhash.op10(spark, write(docs, tmp_path)).collect()
    fps = {r[0]: fingerprint(r[1]) for r in rows}
    want = groups(list(fps.items()))
    assert len(got) == len(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}
    loose = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert {(None, 0), (None, None)} <= loose
    assert simhash.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_random_bits(spark):
    r = np.random.default_rng(8)
    base = r.integers(0, 2**63, 60)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in r.integers(0, 63, n)) for b in base for n in (0, 1, 2, 3, 4)})
    df = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, node long")
    moved = {x.node: x.root for x in common.components(simhash.links(df)).collect()}
    want = groups([(i, f) for i, f in enumerate(fps)])
    assert {i: moved.get(i, i) for i in want} == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(5, 5)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 141)} | {k: 7 for k in [7, *range(200, 260)]} | {5: 5}


def test_fertility(docs, rows, odd, nothing):
    got = fertility.judge(docs).collect()
    want = {r[0]: base_counts(r[1]) for r in rows}
    for r in got:
        n = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.kept and r.base_failed)
    assert len(got) == len(rows)
    kept = fertility.judge(odd, carry=True)
    assert kept.select("row.*").columns == odd.columns and kept.count() == odd.count()
    assert fertility.judge(nothing).count() == 0


def test_fertility_bands(spark):
    """Measures, medians and verdicts by plain Python."""
    import sentencepiece

    from tangle.llm.vocab import vocabulary_path

    r = np.random.default_rng(1)
    clean = [" ".join(r.choice(["the", "house", "of", "green", "river", "stones", "walks", "under", "morning"], 70 + int(n))) for n in r.integers(0, 40, 60)]
    junk = [" ".join(w + "&&&" if k % 2 else "$$$" + w for k, w in enumerate(t.split())) for t in clean[:3]]
    data = [(i, t, "en") for i, t in enumerate(clean + junk)]
    got = {x.doc_id: x for x in fertility.judge(spark.createDataFrame(data, "doc_id long, text string, lang string"), least=10).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(fertility.VOCABULARY))
    for i, t, _ in data:
        ids = [y for w in t.split() for y in model.encode(w)]
        p = np.unique(ids, return_counts=True)[1] / len(ids)
        assert got[i].n_tokens == len(ids)
        assert got[i].entropy == pytest.approx(-(p * np.log2(p)).sum())
        assert got[i].chars_per_token == pytest.approx(len(t.replace(" ", "")) / len(ids))
    assert all(got[i].kept for i in range(60) if not got[i].base_failed)
    assert not any(got[i].kept for i in range(60, 63))


def test_mix(docs, rows, odd, nothing):
    got = mixing.mix(docs, block=64, shard=4).collect()
    again = mixing.mix(docs.repartition(5), block=64, shard=4).collect()
    key = lambda x: sorted((r.doc_id, r.taken) for r in x)
    assert key(got) == key(again)
    by = {}
    for r in got:
        assert r.size == len((dict((x[0], x[1]) for x in rows)[r.doc_id] or "").encode().split())
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == sum(p["length"] for p in r.pieces)
        by.setdefault(r.source, [0, r.source_size, r.target])[0] += r.taken
    assert all(taken == int(target) for taken, _, target in by.values())
    assert sum(t for _, _, t in by.values()) == pytest.approx(1.5 * sum(n for _, n, _ in by.values()))
    assert all(t <= 2 * n for _, n, t in by.values())
    assert mixing.mix(nothing).count() == 0
    assert mixing.mix(odd).count() == odd.count()


def test_mix_materialized(docs, odd):
    plan = {}
    for r in mixing.mix(docs, block=64, shard=4).collect():
        plan[r.doc_id] = plan.get(r.doc_id, 0) + r.taken
    out = mixing.materialize(docs, block=64, shard=4)
    assert out.drop("_piece").columns == docs.columns
    words = {}
    for r in out.collect():
        n = len(r.text.encode().split())
        assert n == r["_piece"]["length"] and r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + n
    assert words == {i: n for i, n in plan.items() if n}
    assert mixing.materialize(odd).drop("_piece").columns == odd.columns


def test_pieces_and_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    from tangle.llm.vocab import vocabulary_path

    model = Tokenizer.from_file(vocabulary_path(packing.VOCABULARY))
    want = []
    for i, t, *_ in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want.append((i, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    packed, certificate = packing.pack(packing.pieces(docs), part=7)
    got = packed.collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    held = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 4096
    assert len(held) == certificate["sequences"]
    whole, one = packing.pack(packing.pieces(docs, ids=True))
    assert one["sequences"] == whole.select("sequence_id").distinct().count() <= certificate["sequences"]
    assert one["sequences"] - one["lower_bound"] <= 1
    assert whole.filter("size(ids) <> length").count() == 0
    assert packing.pack(packing.pieces(nothing))[0].count() == 0


def test_topk(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(r.normal(0, 0.3, 6))]) for i in range(230)]
    rows += [(i, rows[7][1]) for i in range(300, 340)]  # ties
    rows += [(400, None), (401, []), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (600, [float("nan")] * 6), (None, rows[1][1]), (700, [float("inf")] * 6), (800, [1.0, 2.0]), (801, [0.5, 0.25]), (900, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.op7(spark, write(df, tmp_path, "embeddings"))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(brute_topk(rows))
    v = topk.integers(df)
    few = topk.search(v, v.filter("vec_id % 100 = 0"), block=2)
    assert sorted(map(tuple, few.collect())) == sorted(brute_topk(rows))
    none = topk.integers(df.limit(0))
    assert topk.search(none, none).count() == 0


def test_url_rules(spark):
    urls = ["http://A.Example.COM/en/7x?q=/de/", "https://x.com/en/1", "https://x.net/de/8", "https://example.net/de/81#top", "https://y.org/es/", "https://y.org", "no url", None, "", "ftp://com/en/", "https://h?x=/en/", "https://xcom/en/1", "http://a.b.co.uk/en/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, "https://x.com/en/1")], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.filter_urls(pages, labels).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1] == got[None] == ("x.com", "/en/1", "com/en/", "block")
    assert got[2] == ("x.net", "/de/8", "net/de/", "block")
    assert got[3] == ("example.net", "/de/81", "example.net/de/8", "allow")
    assert got[4] == ("y.org", "/es/", "org/es/", "block")
    assert got[5] == ("y.org", "", None, "allow")
    assert got[6] == got[7] == got[8] == ("", "", None, "allow")
    assert got[9] == ("com", "/en/", "com/en/", "block")
    assert got[10] == ("h", "", None, "allow") and got[11][2] is None and got[12][2] is None


def test_url_rules_of_the_contract(spark, tmp_path):
    """F1 (op8_host_reputation): each rule's word is the one that the contract's list gives it."""
    urls = {"https://x.com/en/1": "block", "https://a.example.com/en/7": "allow", "https://x.net/de/8": "allow", "https://b.example.net/de/7": "allow", "https://b.example.net/de/8": "block", "https://y.org/es/": "block", "https://y.org/": "allow"}
    write(spark.createDataFrame([(u,) for u in urls], "url string").selectExpr("monotonically_increasing_id() as page_id", "url"), tmp_path, "pages")
    folder = write(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    got = {(r.host, r.path): (r.rule, r.verdict) for r in urlrules.op8(spark, folder).collect()}
    assert {f"https://{h}{p}": v for (h, p), (_, v) in got.items()} == urls
    assert got["b.example.net", "/de/7"][0] == "net/de/" and got["b.example.net", "/de/8"][0] == "example.net/de/8"


def test_reputation(spark):
    bad = [(i, f"http://spam.evil.org/x/{i}") for i in range(60)] + [(100 + i, f"http://h{i % 20}.fine.org/x/{100 + i}") for i in range(200)] + [(900, "http://new.evil.org/x/9999"), (901, "http://one.fine.org/x/500")]
    pages = spark.createDataFrame(bad, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 0) for i in range(60)] + [(100 + i, 1, 0) for i in range(200)] + [(500, 0, None), (500, None, 1), (None, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urlrules.filter_urls(pages, labels).collect()}
    assert got[3].verdict == "block" and got[100].verdict == "allow"
    assert got[900].bad_mean > 0.5  # takes after its domain
    assert got[901].verdict == "allow"  # one bad page is too little
    assert len(got) == len(bad)


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="no-comments">
    <header><a href="/">Home</a></header><nav><ul><li><a href=x>A</a></li></ul></nav><div class="ad">Buy the best of it</div>
    <article><header><h1>Caf&eacute; &amp; more &am</h1></header><p>One  two<br>three <b>four</b></p><p>Five<p>six &lt;b&gt;
    <div class="newsletter-box"><form>Mail</form></div><blockquote>A quote</blockquote><section id="comments"><p>Nice post of the day</p></section></article>
    <aside>Side</aside><footer>&copy; x</footer></body>"""
    assert htmltext.main_text(page) == "Café & more &am\n\nOne two three four\n\nFive\n\nsix <b>\n\nA quote"
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<script>x") == ""
    long = "It was the best of the times and it was the worst of times for all of them who had been there with us in the town. "
    plain = f"<body><div><a href=a>Home</a> <a href=b>About</a></div><h2>Title</h2><p>{long * 2}</p><p>Short.</p><p>{long * 2}</p><div>Copyright 2020</div><div><a href=c>More</a></div>"
    assert htmltext.main_text(plain) == f"Title\n\n{(long * 2).strip()}\n\nShort.\n\n{(long * 2).strip()}"
    assert htmltext.main_text("<article><p>cut off he") == "cut off he"
    assert htmltext.main_text("<article><p>a</p><p") == "a"


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>x é</p></article>"), (1, "u", "<article><p>x é</p></article>"), (None, None, None), (2, "v", "")], "page_id long, url string, html string")
    assert sorted(map(tuple, htmltext.extract(df).collect()), key=str) == sorted([(1, "u", "x é", 3), (1, "u", "x é", 3), (None, None, "", 0), (2, "v", "", 0)], key=str)


def labelled(spark, n, seed):
    r = np.random.default_rng(seed)
    good, bad = ["the", "river", "of", "stones", "is", "green", "and", "old", "houses", "stand"], ["menu", "|", "login", "&&&", "click"]
    rows, labels = [], []
    for i in range(n):
        q, t = int(r.random() < 0.7), int(r.random() < 0.25)
        words = list(r.choice(good if q else bad, 60))
        if t:
            words[5] = words[20] = str(r.choice(["idiot", "scumbag", "moron"]))
        rows.append((i, " ".join(words)))
        labels.append((i, q, t))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {x[0]: x for x in labels}


def test_quality(spark, odd, nothing):
    docs, labels, truth = labelled(spark, 400, 1)
    got = quality.classify(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in held]) > 0.97
    few = quality.classify(odd, labels.limit(0)).collect()
    assert len(few) == odd.count() and all(0 <= r.score <= 1 for r in few)
    assert quality.classify(nothing, labels).count() == 0


def test_held_out_labels_are_not_learnt(spark):
    docs, labels, _ = labelled(spark, 200, 2)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.classify(docs, x).collect()} for x in (labels, flipped))
    assert a == pytest.approx(b, abs=1e-9)


def test_toxicity(spark, odd, nothing):
    docs, labels, truth = labelled(spark, 600, 3)
    train = labels.filter("doc_id < 400")
    got = toxicity.score(docs, train).collect()
    test = [r for r in got if r.doc_id >= 400]
    assert np.mean([r.toxic == bool(truth[r.doc_id][2]) for r in test]) > 0.97
    assert all(0 <= r.severity <= 3 and r.toxic == (r.p_toxic >= 0.5) for r in got)
    assert not any(r.toxic for r in toxicity.score(odd, labels.limit(0)).collect())
    assert toxicity.score(nothing, labels).count() == 0


def test_ordinal_gradient():
    r = np.random.default_rng(0)
    s, cut, grade = r.normal(0, 1, 20), np.array([-0.5, 0.4, 1.1]), r.integers(0, 4, 20)

    def loss(s, cut):
        p = np.concatenate([np.ones((20, 1)), 1 / (1 + np.exp(cut[None] - s[:, None])), np.zeros((20, 1))], axis=1)
        return -np.log(p[np.arange(20), grade] - p[np.arange(20), grade + 1]).sum()

    g_s, g_c = toxicity.Ordinal._gradient(s, cut, grade)
    e = 1e-6
    for k in range(20):
        d = np.eye(20)[k] * e
        assert g_s[k] == pytest.approx((loss(s + d, cut) - loss(s - d, cut)) / (2 * e), abs=1e-5)
    for k in range(3):
        d = np.eye(3)[k] * e
        assert g_c[k] == pytest.approx((loss(s, cut + d) - loss(s, cut - d)) / (2 * e), abs=1e-5)
