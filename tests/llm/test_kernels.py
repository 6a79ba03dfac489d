"""Array kernels against plain versions."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from brute import base_counts, fingerprint, groups
from hypothesis import given, settings
from hypothesis import strategies as st

from tangle.llm import common, fertility, mixing, packing, simhash, substrings, topk, vocab

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\r\x0b#&|.,A'5日", max_size=60)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_hashes(texts):
    buf, offs = common.buffers(pa.array(texts, pa.string()))
    a, b, first = common.word_spans(buf, offs)
    want = [(t or "").encode().split() for t in texts]
    assert [buf[x:y].tobytes() for x, y in zip(a, b, strict=True)] == [w for x in want for w in x]
    assert np.diff(first).tolist() == [len(x) for x in want]
    assert common.xxh64_spans(buf, a, b).tolist() == [xxhash.xxh64_intdigest(w, 42) for x in want for w in x]
    joined, x, y = common.squeezed(buf, a, b, first)
    assert [joined[x[i] : y[j - 1]].tobytes() if j > i else b"" for i, j in zip(first, first[1:], strict=False)] == [b" ".join(w) for w in want]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_fingerprints_and_counts(texts):
    buf, offs = common.buffers(pa.array(texts, pa.string()))
    assert simhash.fingerprints_of(buf, offs).tolist() == [fingerprint(t) for t in texts]
    got = fertility.base_counts(buf, offs, *common.word_spans(buf, offs))
    rows = list(zip(*(got[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
    assert rows == [base_counts(t) for t in texts]


def test_xxh64_long_spans():
    raw = np.random.default_rng(0).integers(0, 256, 5000).astype(np.uint8)
    a = np.array([0, 1, 7, 100, 333, 0])
    b = a + np.array([31, 32, 33, 256, 257, 5000])
    assert common.xxh64_spans(raw, a, b, 7).tolist() == [xxhash.xxh64_intdigest(raw[x:y].tobytes(), 7) for x, y in zip(a, b, strict=True)]


def test_tokens_of_words_are_those_of_texts():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocab.vocabulary_path("word_bpe_49k.json"))
    texts = ["It's HERE, the “best”, É, naïve. İstanbul ok’s 5,6. K, é, (x). a?!", "the, the. THE! \xa0b c", ""]
    buf, offs = common.buffers(pa.array(texts))
    a, b, first = common.word_spans(buf, offs)
    ids, n = vocab.coder("word_bpe_49k.json").ids_of(buf, a, b)
    at = np.concatenate([[0], np.cumsum(n)])[first]
    assert [ids[x:y].tolist() for x, y in zip(at, at[1:], strict=False)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_wavelet_and_search():
    r = np.random.default_rng(2)
    seq = r.integers(0, 37, 700)
    m = substrings.WaveletMatrix(seq)
    c, i = r.integers(0, seq.max() + 1, 300), r.integers(0, 701, 300)
    assert m.rank(c, i).tolist() == [int((seq[:y] == x).sum()) for x, y in zip(c, i, strict=True)]
    words = r.integers(0, 4, 900).astype(np.uint64)
    size = np.array([13 + k % 16 for k in range(40)])
    size = size[np.cumsum(size) <= 900]
    words = words[: size.sum()]
    words[26:39] = words[:13]
    owner = r.permutation(len(size))
    at = np.cumsum(size) - size
    first = {}
    for p, (x, n) in enumerate(zip(at, size, strict=True)):
        for k in range(n - 12):
            w = tuple(words[x + k : x + k + 13])
            first[w] = min(first.get(w, 10**9), owner[p])
    got = {}
    for p, w, least in substrings.FMIndex(words, size, owner, 13).search():
        got |= {(a, b): c for a, b, c in zip(p, w, least, strict=True)}
    assert got == {(p, k): first[tuple(words[at[p] + k : at[p] + k + 13])] for p in range(len(size)) for k in range(size[p] - 12)}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=2), st.integers(3, 12))
def test_every_link_has_a_chain(a, bits, segments):
    ring = simhash.Ring(2, segments)
    x = sum(1 << b for b in bits)
    assert any(not x & ring.key[s] and ring.links(s, np.array([x], np.uint64))[0] for s in range(segments))


def test_dense_buckets(monkeypatch):
    ring = simhash.Ring(2, 7)
    r = np.random.default_rng(4)
    fp = np.unique(np.array([(1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(30, 64, (80, 2))], np.uint64))
    key = np.stack([np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64)], axis=1)
    ids = r.permutation(len(fp))

    monkeypatch.setattr(simhash, "DENSE", 5)
    a, b = (np.concatenate(x) for x in zip(*simhash._pairs(ring, key, fp, ids), strict=True))
    nodes, root = simhash.local_roots(a, b)
    got = dict(zip(nodes.tolist(), root.tolist(), strict=True))
    want = groups(list(zip(ids.tolist(), fp.tolist(), strict=True)))  # the whole bucket shares the key, so every link counts
    assert {i: got.get(i, i) for i in want} == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_best_fit_and_bound(sizes):
    length = np.array(sizes, np.int64)
    bins, place, left = packing.best_fit(length, 100)
    held = {}
    for b, p, n in sorted(zip(bins.tolist(), place.tolist(), sizes, strict=True)):
        assert p == held.get(b, 0)
        held[b] = p + n
    assert all(v <= 100 for v in held.values())
    assert [100 - held[b] for b in sorted(held)] == left.tolist()
    assert packing.lower_bound(length, 100) <= len(left)


def test_bounds_see_large_pieces():
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 9), 100) == 5


def test_quotas_add_up():
    q = np.array([1000, 0, 37, 5])
    dealt = mixing.split_quotas(q, 7)
    assert dealt.sum(axis=0).tolist() == q.tolist()
    assert np.ptp(dealt.sum(axis=1)) <= 2
    assert (dealt == mixing.split_quotas(q, 7)).all()


def test_targets_share_the_excess():
    got = mixing.targets({"b": 10, "a": 100, None: 100})
    assert got == {"b": 20, "a": pytest.approx(177), None: pytest.approx(118)}  # b is capped at twice its size


def test_least_keeps_ties_by_id():
    x = np.array([[0, 5, 9], [0, 3, 9], [0, 4, 8], [1, 1, 1], [0, 1, 9]])
    assert topk._least(x, 2).tolist() == [[0, 1, 9], [0, 3, 9], [1, 1, 1]]
