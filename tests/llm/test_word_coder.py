"""Words' ids against the plain tokeniser, with a memory that overflows again and again."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tangle.llm import common as C
from tangle.llm import vocab


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_forgetting(monkeypatch, name):
    monkeypatch.setattr(vocab, "MOST", 40)
    r = random.Random(5)
    words = ["".join(r.choice("abéßÉ日İ'.,!7#") for _ in range(r.randrange(1, 9))) for _ in range(400)]
    often = ["the", "of", "naïve,", "Don't", "日本", "x.", "12"]
    coder, plain = vocab.WordCoder(name), vocab.tokenizer(vocab.vocabulary_path(name))
    plain.encode_special_tokens = True
    for k in range(0, 400, 20):
        row = [w for pair in zip(words[k : k + 20], often * 3, strict=False) for w in pair]
        buf, offs = C.buffers(pa.array([" ".join(row), "", None]))
        st, en, _ = C.word_spans(buf, offs)
        ids, n = coder.ids_of(buf, st, en)
        each = np.split(ids, np.cumsum(n)[:-1])
        assert [x.tolist() for x in each] == [plain.encode(w, add_special_tokens=False).ids for w in row]
    assert len(coder.known) <= 40 + 80
    assert b"the" in coder.known  # met in every batch: never forgotten
