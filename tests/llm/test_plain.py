"""Operators that no SQL expresses, against plain Python."""

import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from brute import fingerprint, groups, substrings as brute_substrings
from pyspark.sql import functions as F

import corpus_pipeline
from tangle.llm import common, fertility, htmltext, mixing, packing, quality, simhash, substrings, toxicity, urlrules

DOTTED = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, row string, rest string, _n_words int, n int"


@pytest.fixture(scope="session")
def dotted(spark, rows):
    data = [(*r, 1, "a", "b", 2, 3) for r in [*rows[:5], (None, rows[0][1], None, None, 5), (None, None, None, None, None), (8, "", "en", "s0", 0)]]
    return spark.createDataFrame(data, DOTTED)


def test_clashing_names_and_nothing(spark, dotted):
    none = dotted.limit(0)
    for work in (fertility.judge, simhash.near_duplicates, simhash.deduplicate, substrings.dedup, mixing.mix, mixing.materialize):
        assert work(none).count() == 0
    kept = fertility.judge(dotted, carry=True).select("row.*")
    assert kept.columns == dotted.columns and kept.count() == 8
    assert simhash.deduplicate(dotted).columns == dotted.columns
    assert substrings.dedup(dotted).columns == [*dotted.columns, "__n_words", "_n_removed", "_spans"]
    mixed = mixing.materialize(dotted)
    assert mixed.columns == [*dotted.columns, "_piece"] and mixed.select("`a.b`").distinct().collect()[0][0] == 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, dotted, "").count() >= 0


def units(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x7f]+|[a-z\u0080-\U0010ffff]+|[0-9]+|[^\sa-z0-9\u0080-\U0010ffff]+", low)


def test_toxic_features():
    texts = ["You IDIOT, moronic scum 42!", "é naïveté", "", None, "a " * 5000 + "scumbags"]
    x, at = toxicity.features(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        want = set()
        for w in re.findall(r"[a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            want.add(xxhash.xxh64_intdigest(w.encode(), toxicity.SEED) % toxicity.ROWS)
            want |= {xxhash.xxh64_intdigest(w[:n].encode(), toxicity.SEED + n) % toxicity.ROWS for n in toxicity.PREFIXES if len(w) > n}
        assert set(x[at[k] : at[k + 1]].tolist()) == want
    model = toxicity.Ordinal(x, at, np.array([3, 0, 0, 0, 1]))
    p = model.exceed(x, at)
    for k in range(len(texts)):
        s = sum(model.w[i] for i in x[at[k] : at[k + 1]])
        assert p[k] == pytest.approx([1 / (1 + math.exp(c - s)) for c in model.cut])
    assert (np.diff(model.cut) > 0).all()


def test_toxicity_of_repeated_ids_and_odd_texts(spark):
    rows = [(k, f"the house {'idiot' if k % 3 == 0 else 'river'} of green stones {k % 7}") for k in range(90)]
    odd = [(0, "quite another text of the id"), (500, ""), (501, None), (502, "idiot " * 50_000), (None, "river")]
    docs = spark.createDataFrame([(*r, 1) for r in rows + odd], "doc_id long, text string, `x.y` int")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(90)], "doc_id long, quality int, toxic int")
    a, b = (sorted((str(r.doc_id), r.severity) for r in toxicity.score(d, labels).collect()) for d in (docs, docs.repartition(7)))
    assert a == b and len(a) == 95
    a, b = (sorted((str(r.doc_id), r.score) for r in quality.classify(d, labels).collect()) for d in (docs, docs.repartition(7)))
    assert [x for x, _ in a] == [x for x, _ in b] and len(a) == 95
    assert [y for _, y in a] == pytest.approx([y for _, y in b], abs=1e-6)


def test_quality_features_and_scores():
    texts = ["the house of the green house", "menu | menu", "", None, "x y " * 200]
    context = np.random.default_rng(1).integers(-5, 5, (512, 8))
    vectors = quality.word_vectors(context)
    got = quality.pooled(pa.array(texts, pa.string()), vectors)
    for k, t in enumerate(texts):
        u = [xxhash.xxh64_intdigest(w.encode(), 42) % 512 for w in units(t or "")]
        if not u:
            assert not got[k].any()
            continue
        v = vectors[u].astype(float)
        n, pairs, triples = len(u), list(zip(u, u[1:], strict=False)), list(zip(u, u[1:], u[2:], strict=False))
        assert got[k][:16] == pytest.approx(v.mean(0), abs=1e-5)
        assert got[k][16:24] == pytest.approx(v[:, :8].std(0), abs=1e-4)
        assert got[k][24] == pytest.approx(math.log1p(n) / 8)
        assert got[k][25] == pytest.approx(len(set(u)) / n)
        assert got[k][26] == pytest.approx(len(set(pairs)) / n, abs=1.01 / n) and got[k][27] == pytest.approx(len(set(triples)) / n, abs=2.01 / n)
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (300, 6))
    y = (x[:, 0] > 0).astype(float)
    net = quality.Network(x, y, r.random(300) < 0.25)
    z = np.clip((x - net.mean) / net.scale, -8, 8)
    want = [1 / (1 + math.exp(-float(np.tanh(a @ net.w[0] + net.w[1]) @ net.w[2][:, 0] + net.w[3][0]) / net.temperature)) for a in z]
    assert net.score(x) == pytest.approx(want)
    assert np.mean((net.score(x) >= 0.5) == (y > 0)) > 0.85


def test_branches_agree_with_the_whole_tree():
    quotas = np.array([300, 0, 41, 7])
    dealt = mixing.split_quotas(quotas, 13, 5)
    upto = np.cumsum(dealt, axis=0)
    for k, n in enumerate(quotas):
        got = mixing.shards_of(quotas, 13, np.full(n, k), np.arange(n), 5)
        assert got.tolist() == [int(np.searchsorted(upto[:, k], d, side="right")) for d in range(n)]


def test_mix_word_by_word(spark, docs, rows):
    block, shard = 64, 4
    got = mixing.mix(docs, block=block, shard=shard).collect()
    h = {(r.doc_id, r.source): r.h for r in docs.select("doc_id", "source", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").alias("h")).collect()}
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    plan = mixing.recipe(sizes, block, shard)
    table = mixing.split_quotas(plan.quotas, plan.shards, plan.seed).cumsum(axis=0)
    for k, s in enumerate(plan.sources):
        own = sorted((r for r in got if r.source == s.name), key=lambda r: (h[r.doc_id, r.source] % 2**64, r.doc_id))  # ranges go by the unsigned hash
        words = [(n, x) for n, r in enumerate(own) for x in range(r.size)]
        taken, places = [0] * len(own), [set() for _ in own]
        blocks = -(-len(words) // block)
        for turn, (need, a, c, _, first) in enumerate(s.turns):
            for rank, b in enumerate(sorted(range(blocks), key=lambda b: (a * b + c) % blocks)):
                for n, x in words[b * block : (b + 1) * block][:need]:
                    taken[n] += 1
                    places[n].add((turn, b, int(np.searchsorted(table[:, k], first + rank, side="right"))))
                need -= min(need, len(words[b * block : (b + 1) * block]))
                if not need:
                    break
        by = {}
        for n, r in enumerate(own):
            by.setdefault(r.doc_id, []).append((taken[n], places[n]))
        for i, want in by.items():  # rows that repeat may come in either order
            found = [(r.taken, {(p.turn, p.block, p.shard) for p in r.pieces}) for r in own if r.doc_id == i]
            key = lambda x: (x[0], sorted(x[1]))
            assert sorted(found, key=key) == sorted(want, key=key) if len(want) == 1 else sum(x for x, _ in found) == sum(x for x, _ in want)


def test_kept_by_plain_medians(spark):
    r = np.random.default_rng(7)
    words = {"en": "the house of green river stones walks under morning light".split(), "fr": "la maison du fleuve vert et des pierres sous le matin".split(), None: "das Haus am grünen Fluss und die Steine".split()}
    rows = [(k * 1000 + i, " ".join(r.choice(own, 60 + int(n))) + (" &&&£ 1x" * int(i % 17 == 0) * 30), lang) for k, (lang, own) in enumerate(words.items()) for i, n in enumerate(r.integers(0, 90, 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    measured = {x.doc_id: x for x in fertility.measure(docs).collect()}
    least, measures = 8, ("chars_per_token", "byte_share", "entropy")
    octave = lambda x: int(math.floor(math.log2(max(1, x.n_words))))
    step = lambda x, m: math.floor(getattr(x, m) / fertility.STEP[m] + 0.5)
    ok = [x for x in measured.values() if not x.base_failed]
    keys = (lambda x: (x.lang, octave(x)), lambda x: (x.lang, "any"), lambda x: (x.script, "script"), lambda x: "all")
    want = {}
    for x in measured.values():
        band = next((g for f in keys if len(g := [y for y in ok if f(y) == f(x)]) >= (least if f(x) != "all" else 1)), None)
        away = {}
        for m in measures:
            v = np.array([step(y, m) for y in band])
            middle = np.median(v)
            away[m] = (getattr(x, m) - middle * fertility.STEP[m]) / max(1.4826 * np.median(np.abs(v - middle)) * fertility.STEP[m], fertility.FLOOR[m])
        inside = all(abs(a) <= fertility.WIDTH for a in away.values()) and not (away["chars_per_token"] < -fertility.JOINT and away["entropy"] < -fertility.JOINT)
        want[x.doc_id] = inside and not x.base_failed
    assert 0 < sum(want.values()) < len(want)
    for few in (fertility.FEW, 0):  # bands broadcast, and met by a join
        assert {x.doc_id: x.kept for x in fertility.judge(docs, least=least, few=few).collect()} == want


def test_block_rules():
    long = "It was the best of the times and it was the worst of times for all of them who had been there with us in the town. "
    code = "x = frobnicate(alpha, beta); " * 6
    inside = f"<article><h1>Head</h1><p>{long * 2}</p><pre>{code}</pre><p>Short.</p><ul><li><a href=x>{'ref ' * 30}</a></li></ul></article>"
    page = f"<nav><a href=a>Home</a></nav><div>Unnamed teaser</div>{inside}<footer>(c)</footer>"
    got = [(b.text[:5], *x) for b in [htmltext.blocks_of(page)] for b, x in zip(b, htmltext.decide(b), strict=True)]
    assert got == [
        ("Home", False, "boilerplate"), ("Unnam", False, "outside the article"), ("Head", True, "inherited: short"), ("It wa", True, "stop words"), ("x = f", True, "inherited: few stop words"),
        ("Short", True, "inherited: short"), ("ref r", True, "inherited: links in article"), ("(c)", False, "boilerplate"),
    ]
    # without an article the same rules decide all
    bare = [x for b in [htmltext.blocks_of(page.replace("article>", "div>"))] for x in htmltext.decide(b)]
    assert bare == [(False, "boilerplate"), (True, "inherited: short"), (True, "inherited: short"), (True, "stop words"), (False, "no stop words"), (False, "inherited: short"), (False, "links"), (False, "boilerplate")]
    # an article with less good text than the rest is not believed
    teaser = f"<article><p>{long}</p></article><div><p>{long * 3}</p><p>{long * 3}</p></div>"
    assert htmltext.main_text(teaser).count("worst") == 7
    # a language without known stop words
    other = "Здесь был старый дом у реки и люди жили спокойно каждый день очень долго вместе. " * 4
    assert htmltext.main_text(f"<div><a href=a>Меню</a></div><p>{other}</p><p>{other[:90]}</p>") == f"{other.strip()}\n\n{other[:90].strip()}"
    odd = "<article><p>a</p><math>m</math><svg><title>s</title></svg><noscript>n</noscript><button>b</button><p class='share-box'>keep</p><p>one <span class=ad>buy</span> two</p><div class=related><a href=x>more of it</a></div></article>"
    assert htmltext.main_text(odd) == "a\n\nm s n\n\nkeep\n\none two" or htmltext.main_text(odd) == "a\n\nmsn\n\nkeep\n\none two"


def test_second_pass_by_distance():
    r = np.random.default_rng(3)
    for _ in range(200):
        n = int(r.integers(1, 12))
        first = [[None, True, False][int(k)] for k in r.integers(0, 3, n)]
        heading = (r.random(n) < 0.3).tolist()
        alone = bool(r.random() < 0.5)
        want = []
        for i, x in enumerate(first):
            near = [j for j, y in enumerate(first) if y is not None]
            ahead = [j for j in near if j > i]
            if x is None and heading[i] and ahead:
                x = first[ahead[0]]
            elif x is None:
                x = first[min(near, key=lambda j: (abs(j - i), j))] if near else alone
            want.append(x)
        assert htmltext.second_pass(first, heading, alone) == want


def test_pages_of_any_kind(spark):
    began = time.time()
    assert htmltext.main_text("<article>" + "<span>" * 170_000 + "x") == "x"
    assert htmltext.main_text("<div>" * 50_000 + "</p>" * 50_000) == ""
    assert time.time() - began < 20
    pages = spark.createDataFrame([(1, "u", "<article>" + "<p>word and word</p>" * 20_000, "t", 1)], "page_id long, url string, html string, text string, `n.x` int")
    assert [(r.page_id, r.n_chars) for r in htmltext.extract(pages).collect()] == [(1, 13 * 20_000 + 2 * 19_999)]
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_links_through_rows_without_id(spark, monkeypatch):
    fps = {1: 0, None: 3, 2: 15}
    own = spark.createDataFrame([(i, f) for i, f in fps.items()], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a, **k: own)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(own).collect()}
    assert got == {1: 1, None: 1, 2: 1}


@pytest.mark.parametrize("hot", [common.HOT_LEAST, 1])
def test_groups_by_fingerprint(spark, rows, hot):
    texts = [r[1] for r in rows]
    data = [(k // 2 if k % 5 else None, t) for k, t in enumerate(texts)] + [(900, texts[0])] * 40  # ids repeat with other texts, and copies
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    comp = groups([(k, fingerprint(t)) for k, (_, t) in enumerate(data)])
    least = {}
    for k, (i, _) in enumerate(data):
        if i is not None:
            least[comp[k]] = min(least.get(comp[k], i), i)
    want = sorted((str(i), fingerprint(t), str(least.get(comp[k]))) for k, (i, t) in enumerate(data))
    got = sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in simhash.near_duplicates(docs, hot=hot).collect())
    assert got == want
    left = simhash.deduplicate(docs).collect()
    assert len(left) == len(set(comp.values()))
    place = {}
    for k, (i, t) in enumerate(data):
        place.setdefault((i, t), comp[k])
    assert len({place[r.doc_id, r.text] for r in left}) == len(left)
    assert all(r.doc_id == least.get(place[r.doc_id, r.text]) for r in left)


def test_pieces_with_one_hash_in_common():
    ph, pg, pid = np.array([7, 7, 7, 7, 7], np.uint64), np.array([1, 2, 1, 2, 1], np.uint64), np.array([3, 1, 1, 1, 3])
    order, cut = substrings.alike(pid, pg, ph)  # by ph and pg; pid only orders
    assert [sorted(x.tolist()) for x in np.split(order, cut[1:])] == [[0, 2, 4], [1, 3]]
    h = np.arange(40, dtype=np.uint64)
    a, b = (substrings._piece_hash(h, np.array([0, 5]), np.array([13, 20]), s) for s in (0, substrings.SECOND))
    assert len({*a.tolist(), *b.tolist()}) == 4


def test_many_rows_without_id(spark):
    text = " ".join(f"w{k}" for k in range(120))
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text")).union(spark.createDataFrame([(7, text), (8, "other words")], "doc_id long, text string"))
    began = time.time()
    got = {(r._n_words, r._n_removed): r["count"] for r in substrings.dedup(docs).groupBy("_n_words", "_n_removed").count().collect()}
    assert got == {(120, 120): 20_000, (120, 0): 1, (2, 0): 1}
    assert time.time() - began < 120


def test_texts_of_one_id(spark, rows):
    data = [(3, rows[0][1]), (3, rows[0][1]), (3, rows[1][1]), (4, rows[0][1] + " more"), (5, rows[1][1])]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((r.doc_id, r._n_words, r._n_removed) for r in substrings.dedup(docs).collect())
    first = brute_substrings([(3, rows[0][1]), (4, rows[0][1] + " more")])[4][1]
    n, m = len(rows[0][1].split()), len(rows[1][1].split())
    assert got == sorted([(3, n, 0), (3, n, 0), (3, m, 0), (4, n + 1, first), (5, m, m)])


def test_added_tokens(spark):
    from tokenizers import Tokenizer

    from tangle.llm.vocab import vocabulary_path

    plain = Tokenizer.from_file(vocabulary_path(packing.VOCABULARY))
    texts = ["a <|startoftext|> b <|endoftext|>", "x<|endoftext|>y", "<|STARTOFTEXT|> no", "plain text", "", None, "<|endoftext|>" * 5000, "É <|startoftext|>É's"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    got = sorted(tuple(r)[:5] for r in packing.pieces(docs).collect())
    want = []
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want.append((i, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    assert got == sorted(want)


def test_hosts_by_salts(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 9}.d{k % 4}.org/x/{k}") for k in range(300)] + [(400, None), (401, "http://" + "a." * 500 + "com/x/1")], "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    pages = pages.withColumn("host", F.lit("clash")).withColumn("a.b", F.lit(1))
    a, b = (sorted(map(str, urlrules.filter_urls(pages, labels, hot=hot).select("page_id", "host", "verdict", F.round("bad_mean", 9), F.round("bad_bound", 9)).collect())) for hot in (1, common.HOT_LEAST))
    assert a == b and len(a) == 302
    assert urlrules.filter_urls(pages.limit(0), labels).count() == 0
    assert urlrules.filter_urls(pages, labels.limit(0)).filter("verdict = 'allow'").count() == 302
    rules = (("block", "org", "/x/1"), ("allow", "org", "/x/2"), ("allow", "org", "/x/1"))  # equally long: the first
    got = {r.page_id: r.verdict for r in urlrules.filter_urls(pages, labels, rules=rules).collect()}
    assert got[1] == "block" and got[2] == "allow"


def test_intermediate_folders(spark, docs):
    import os

    before = common.written()
    out = corpus_pipeline.quality_rules(spark, docs, "")
    mine = common.written() - before
    assert mine and all(os.path.isdir("/" + p) for p in mine)
    again = common.durable(out)
    corpus_pipeline.near_duplicates(spark, again, "").count()
    assert not mine & common.written() and not any(os.path.isdir("/" + p) for p in mine)
    corpus_pipeline.near_duplicates(spark, out.sparkSession.createDataFrame([], docs.schema), "").count()
    assert again.count() > 0
    common.drop(again)
