"""Public vocabularies applied word by word: each worker tokenises a word form once and remembers its ids.

In both vocabularies no token crosses white space, so a text's ids are its words' ids in a row. Files are read on the
workers from the installed package public_tokenizers, or from a path given as a parameter.

Strings of a vocabulary's added tokens (such as <|endoftext|>) are one id each, as the tokenizers library has it. They may
stand anywhere in a text, so that a text which holds one goes to the tokeniser whole.
"""

from __future__ import annotations

import json
import os
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common as C

#: Word forms that a worker remembers; beyond, it keeps those met most often, half as many at most. Bounds its memory, not its results.
MOST = 400_000


def vocabulary_path(name: str) -> str:
    """A file's path as given, or the place of a public vocabulary of that name."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _in_a_row(found: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids in a row, and how long each is."""
    n = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.int64, int(n.sum())), n


def _encoder(path: str, folds: bool):
    """A function of words: their ids in a row, and how many each word has."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda words: _in_a_row(model.encode(words, num_threads=1))
    model = tokenizer(path)
    model.encode_special_tokens = True  # words never hold them: see WordCoder.added
    plain = lambda words: _in_a_row([x.ids for x in model.encode_batch_fast(words, add_special_tokens=False)])
    if not folds:
        return plain
    tokens = model.get_vocab()
    ends = np.zeros(max(tokens.values()) + 1, bool)
    ends[[i for t, i in tokens.items() if t.endswith("</w>")]] = True
    del tokens

    def joined(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of lower-case letters are one token run each, closed by a word end: they are encoded as one text."""
        simple = np.fromiter((w.isalpha() and max(w) < "\u0250" and w == w.lower() for w in words), bool, len(words))
        ids = np.array(model.encode(" ".join(compress(words, simple)), add_special_tokens=False).ids, np.int64)
        cut = np.flatnonzero(ends[ids]) + 1 if len(ids) else ids
        if len(cut) != simple.sum():
            return plain(words)
        rest, m = plain(list(compress(words, ~simple)))
        n = np.zeros(len(words), np.int64)
        n[simple], n[~simple] = np.diff(cut, prepend=0), m
        out, own = np.empty(int(n.sum()), np.int64), np.repeat(simple, n)
        out[own], out[~own] = ids, rest
        return out, n

    return joined


def _folds(path: str) -> bool:
    """Whether a vocabulary lower-cases its text, parts letters from other characters and marks word ends."""
    if not path.endswith(".json"):
        return False
    with open(path) as f:
        own = json.load(f)
    return "Lowercase" in json.dumps(own["normalizer"]) and "[\\\\p{L}]+|[\\\\p{N}]|" in json.dumps(own["pre_tokenizer"]) and own["model"].get("end_of_word_suffix") == "</w>"


_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_TAIL, _SAFE = np.zeros(256, bool), np.zeros(256, bool)
_TAIL[list(b",.;:!?")] = True
_SAFE[48:58] = _SAFE[97:123] = True


class WordCoder:
    """Ids of words, remembered by word form."""

    def __init__(self, name: str):
        path = vocabulary_path(name)
        self.folds = _folds(path)
        self.encode = _encoder(path, self.folds)
        self.path, self.whole = path, None
        self.added: list[str] = []
        if path.endswith(".json"):
            with open(path) as f:
                self.added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.reset()

    def holds_added(self, col: pa.Array) -> np.ndarray:
        """Rows whose text holds the string of an added token."""
        hit = np.zeros(len(col), bool)
        for t in self.added:
            hit |= pc.fill_null(pc.match_substring(col, t), False).to_numpy(zero_copy_only=False)
        return np.flatnonzero(hit)

    def text_ids(self, text: str) -> np.ndarray:
        """The ids of a whole text, added tokens included."""
        if self.whole is None:
            self.whole = tokenizer(self.path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int64)

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.at, self.n, self.met = np.zeros(1 << 16, np.int32), *(np.zeros(1 << 14, np.int64) for _ in range(3))
        self.used = 0

    def _forget(self) -> None:
        """Keeps the forms met in most batches since the last time, MOST / 2 at most and none met but once."""
        met = self.met[: len(self.known)]
        least = max(2, int(np.partition(met, -(MOST // 2))[-(MOST // 2)]) + 1) if len(met) >= MOST // 2 else 2
        keep = np.flatnonzero(met >= least)
        words = list(compress(self.known, met >= least))
        n, at = self.n[keep], self.at[keep]
        end = np.cumsum(n)
        ids = self.ids[np.repeat(at - end + n, n) + np.arange(end[-1] if len(end) else 0)]
        self.reset()
        self._remember(words, ids, n)

    def _learn(self, words: list[bytes]) -> None:
        self._remember(words, *self.encode([w.decode("utf-8", "replace") for w in words]))

    def _remember(self, words: list[bytes], flat: np.ndarray, n: np.ndarray) -> None:
        k = len(self.known)
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.at) < k + len(words):
            self.at, self.n, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.n, self.met))
        self.ids[self.used : self.used + len(flat)] = flat
        self.n[k : k + len(words)] = n
        self.at[k : k + len(words)] = self.used + np.cumsum(n) - n
        self.used += len(flat)
        self.known.update(zip(words, range(k, k + len(words)), strict=True))

    def codes(self, buf: np.ndarray, st: np.ndarray, en: np.ndarray) -> np.ndarray:
        """The place in at and n of each word's ids; valid until the next call."""
        if not len(st):
            return np.zeros(0, np.int64)
        if len(self.known) > MOST:
            self._forget()
        n = en - st
        keep = np.zeros(len(buf) + 1, np.int8)
        keep[st] += 1
        keep[en] -= 1
        data = buf[np.cumsum(keep[:-1], dtype=np.int8).view(bool)]
        offs = np.concatenate([[0], np.cumsum(n)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(st), [None, pa.py_buffer(offs), pa.py_buffer(data)]).dictionary_encode()
        ends = np.frombuffer(words.dictionary.buffers()[1], np.int64, len(words.dictionary) + 1).tolist()
        raw = words.dictionary.buffers()[2].to_pybytes()
        forms = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        place = np.fromiter(map(self.known.get, forms, repeat(-1)), np.int64, len(forms))
        if len(new := np.flatnonzero(place < 0)):
            place[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn([forms[i] for i in new.tolist()])
        self.met[place] += 1
        return place[words.indices.to_numpy()]

    def ids_of(self, buf: np.ndarray, st: np.ndarray, en: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in a row, and how many each word has.

        Where the vocabulary allows, forms are lower-cased and a last punctuation mark after a letter or digit is a form
        of its own: the ids are the same, and the forms fewer.
        """
        if not self.folds or not len(st):
            return self.flat(self.codes(buf, st, en))
        buf = _LOW.take(buf)
        before = buf[np.maximum(en - 2, 0)]
        latin = (buf[np.maximum(en - 3, 0)] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (en - st > 2)
        tail = _TAIL[buf[en - 1]] & (en - st > 1) & (_SAFE[before] | latin)
        word = np.repeat(np.arange(len(st)), 1 + tail)
        own = np.cumsum(1 + tail) - 1 - tail  # each word's first form
        begin, end = st[word], en[word]
        end[own[tail]] -= 1
        begin[own[tail] + 1] = en[tail] - 1
        ids, n = self.flat(self.codes(buf, begin, end))
        return ids, np.add.reduceat(n, own)

    def flat(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in a row, and how many each has."""
        n = self.n[code]
        end = np.cumsum(n)
        return self.ids[np.repeat(self.at[code] - end + n, n) + np.arange(end[-1] if len(end) else 0)], n


def coder(name: str) -> WordCoder:
    """This worker's coder of a vocabulary; it holds one at a time, for as long as its tasks ask to keep it."""
    if name not in C.kept:
        C.kept.clear()
        C.trim()
        C.kept[name] = WordCoder(name)
        C.trim()
    return C.kept[name]
