"""Quality rules: word and line counts, and how a public vocabulary takes the text (tokeniser fertility).

Per document: characters per token, share of byte-fallback tokens, token entropy in bits. Bands around the median of each
(language, length octave), calibrated over all documents that pass the base rules, reject what the vocabulary finds odd.
Groups of too few documents take the band of their language, then of their script. Where the script has too few as well,
documents take the band of all if over half of all have their script, or if they have no letters; else none rejects them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common as C
from . import vocab

VOCABULARY = "piece_bpe_32k.model"
#: Ids of the vocabulary's 256 byte tokens.
BYTES = (3, 259)
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A measure is out of band this many deviations (1.4826 MAD, and at least FLOOR) from its group's median; characters per
#: token and entropy that are both low, JOINT deviations. Text that mixes languages is low in one of them only.
WIDTH, JOINT = 6.0, 2.25
FLOOR = {"chars_per_token": 0.03, "byte_share": 0.02, "entropy": 0.1}
#: Steps to which measures are rounded for the medians, so that a group's histogram stays small whatever its size.
STEP = {"chars_per_token": 0.01, "byte_share": 0.001, "entropy": 0.02}
LEAST_GROUP = 200
#: Bands that may be broadcast, some 100 bytes each.
FEW = 50_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
#: Scripts by blocks of 64 code points: first and last code point, coarse where a block holds two. Other letters: "other".
BLOCKS = (
    ("latin", 0xC0, 0x2BF), ("greek", 0x380, 0x3FF), ("cyrillic", 0x400, 0x53F), ("armenian", 0x540, 0x5BF), ("hebrew", 0x5C0, 0x5FF), ("arabic", 0x600, 0x6FF),
    ("syriac", 0x700, 0x73F), ("arabic", 0x740, 0x77F), ("thaana", 0x780, 0x7BF), ("other", 0x7C0, 0x8BF), ("arabic", 0x8C0, 0x8FF),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("oriya", 0xB00, 0xB7F), ("tamil", 0xB80, 0xBFF),
    ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("sinhala", 0xD80, 0xDFF), ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF),
    ("tibetan", 0xF00, 0xFFF), ("myanmar", 0x1000, 0x107F), ("georgian", 0x1080, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x13BF),
    ("other", 0x13C0, 0x177F), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18BF), ("other", 0x18C0, 0x1D7F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF),
    ("other", 0x2C00, 0x2DFF), ("kana", 0x3040, 0x30FF), ("other", 0x3100, 0x317F), ("han", 0x3400, 0x9FFF), ("other", 0xA000, 0xABFF), ("hangul", 0xAC00, 0xD7FF),
    ("han", 0xF900, 0xFAFF), ("kana", 0xFF40, 0xFFBF),
)
SCRIPTS = [*dict.fromkeys(b[0] for b in BLOCKS), "none"]
_BLOCK = np.full(1024, len(SCRIPTS) - 1)
for _name, _a, _z in BLOCKS:
    _BLOCK[_a >> 6 : (_z >> 6) + 1] = SCRIPTS.index(_name)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True

_MEASURES = ("chars_per_token", "byte_share", "entropy")
_SCHEMA = "doc_id long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_tokens long, chars_per_token double, byte_share double, entropy double"


def _per(count: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of count over each document's run."""
    return np.diff(np.concatenate([[0], np.cumsum(count, dtype=np.int64)])[at])


def _earlier(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item whether an earlier one, and whether any other one, of its document has its key."""
    order = np.lexsort((key, doc))  # keys meet those of their own document only
    s, d = key[order], doc[order]
    same = (s[1:] == s[:-1]) & (d[1:] == d[:-1])
    earlier, other = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order[1:]] = same
    other[order[1:]] = same
    other[order[:-1]] |= same
    return earlier, other


def scripts_of(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The script of most letters of each document, "none" without letters. Han beside kana, over one in ten, is kana."""
    n, none = len(offs) - 1, len(SCRIPTS) - 1
    lead = np.flatnonzero(buf >= 0xC0)
    b = buf[lead].astype(np.int64)
    up = buf[np.minimum(lead + 1, len(buf) - 1)].astype(np.int64) & 0x3F
    kind = _BLOCK[np.where(b < 0xE0, b & 0x1F, (b & 0xF) << 6 | up)]
    far = (b & 7) << 6 | up  # beyond the blocks, by 4096 code points: ideographs, symbols, other scripts
    kind = np.where(b < 0xF0, kind, np.where(far >= 0x20, SCRIPTS.index("han"), np.where(far == 0x1F, none, SCRIPTS.index("other"))))
    doc = np.searchsorted(offs, lead, side="right") - 1
    count = np.bincount(doc * len(SCRIPTS) + kind, minlength=n * len(SCRIPTS)).reshape(n, len(SCRIPTS))
    count[:, none] = 0
    count[:, SCRIPTS.index("latin")] += _per(_LETTER.take(buf), offs)
    kana, han = count[:, SCRIPTS.index("kana")], count[:, SCRIPTS.index("han")]
    kana += np.where(10 * kana > han, han, 0)
    return np.array(SCRIPTS)[np.where(count.max(axis=1) > 0, count.argmax(axis=1), none)]


def base_counts(buf: np.ndarray, offs: np.ndarray, st: np.ndarray, en: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of every document."""
    n = np.diff(first)
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80, dtype=np.int64)])
    out = {"n_words": n, "word_chars": _per(points[en] - points[st], first), "n_symbols": _per(_SYMBOL.take(buf), offs)}
    doc = np.repeat(np.arange(len(n)), n)
    # lines: they end at each \n and at each document's end
    breaks = np.flatnonzero(buf == 10)
    ends = np.sort(np.concatenate([breaks, offs[1:]]), kind="stable")
    begin = np.concatenate([[0], np.where(np.isin(ends[:-1], breaks), ends[:-1] + 1, ends[:-1])]) if len(ends) else ends
    worded = np.searchsorted(st, ends) > np.searchsorted(st, begin)
    begin, ends = begin[worded], ends[worded]
    own = np.searchsorted(offs, begin, side="right") - 1
    out["n_dup_lines"] = np.bincount(own[_earlier(C.xxh64_spans(buf, begin, ends), own)[0]], minlength=len(n))
    # words in 3-word windows found twice or more
    h = C.xxh64_spans(buf, st, en)
    last = first[1:][doc]
    at = np.flatnonzero(np.arange(len(h)) + 2 < last)
    with np.errstate(over="ignore"):
        key = (h[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + 1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[at + 2]
        key ^= key >> np.uint64(29)
    covered = np.zeros(len(h) + 2, bool)
    hit = at[_earlier(key, doc[at])[1]]
    for k in range(3):
        covered[hit + k] = True
    out["n_repeat_words"] = _per(covered[: len(h)], first)
    return out


def measure(docs: DataFrame, vocabulary: str = VOCABULARY, byte_ids: tuple[int, int] = BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: bool = False) -> DataFrame:
    """Counts and fertility of every row. Null or empty text: no word; its measures are 0. A null lang is a language of its
    own; very long texts are measured whole.

    carry: the whole row comes along as struct `row`, whatever the names of its columns.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocab.coder(vocabulary)
        for b in C.batches(it, C.BATCH_BYTES // 2, keep=True):
            buf, offs = C.buffers(b.column(1))
            st, en, first = C.word_spans(buf, offs)
            got = base_counts(buf, offs, st, en, first)
            n = got["n_words"]
            ids, size = words.ids_of(buf, st, en)
            upto = np.concatenate([[0], np.cumsum(size)])[first]
            tokens = np.diff(upto)
            byte = _per((ids >= byte_ids[0]) & (ids < byte_ids[1]), upto)
            runs = np.sort((np.repeat(np.arange(len(n), dtype=np.int64), tokens) << 32) | ids)
            cut = np.flatnonzero(np.diff(runs, prepend=-1))
            count = np.diff(np.append(cut, len(runs)))
            part = np.bincount(runs[cut] >> 32, count * np.log2(count), len(n))
            some = np.maximum(tokens, 1)
            script = scripts_of(buf, offs)
            failed = (n < LEAST_WORDS) | (100 * got["n_repeat_words"] > MOST_REPEATED * n)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(script.tolist(), pa.string()), *[pa.array(got[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                 pa.array(failed), pa.array(tokens), pa.array(got["word_chars"] / some), pa.array(byte / some), pa.array(np.log2(some) - part / some), *b.columns[3:]],
                names=names,
            )

    row = F.struct(*C.columns(docs)).alias("row")
    rows = docs.select(F.col(C.quoted(id_col)).cast("long").alias("doc_id"), F.col(C.quoted(text_col)).alias("text"), F.col(C.quoted(lang_col)).cast("string").alias("lang"), *[row] * carry)
    names = [x.split()[0] for x in _SCHEMA.split(", ")] + ["row"] * carry
    schema = StructType.fromDDL(_SCHEMA)
    return rows.mapInArrow(run, schema.add(rows.schema["row"]) if carry else schema)


def _octave() -> Column:
    return F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int")


def _middle(value: np.ndarray, count: np.ndarray) -> float:
    """The median of values that come count times each."""
    order = np.argsort(value, kind="stable")
    upto = np.cumsum(count[order])
    n = int(upto[-1])
    return float(value[order][np.searchsorted(upto, [(n - 1) // 2, n // 2], side="right")].mean())


_STATS = "level int, lang string, script string, octave int, measure string, n long, middle double, spread double"


def bands(measured: DataFrame, least: int = LEAST_GROUP) -> DataFrame:
    """(level, lang, script, octave, n and for each measure its middle and spread): one row a group, over all that passed.

    Levels: 0 language and octave, 1 language, 2 script, 3 all; the script of level 3 is the one that over half of all have,
    if any. Medians come from histograms of the rounded measures, so that each is exact for them and a group costs a bounded
    number of counts however many documents it has. All levels are added up from the finest counts in one go.
    """
    ok = measured.filter("not base_failed").withColumn("octave", _octave())
    steps = ok.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m) / STEP[m]).cast("long").alias("v")) for m in _MEASURES])), "lang", "script", "octave")
    fine = C.durable(steps.groupBy("lang", "script", "octave", "measure", "v").agg(F.count("*").alias("c")))  # everything below reads these
    none, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    levels = (("lang", none, "octave"), ("lang", none, number), (none, "script", number), (none, none, number))
    each = F.array(*[F.struct(F.lit(k).alias("level"), *[(F.col(x) if isinstance(x, str) else x).alias(c) for x, c in zip(by, ("lang", "script", "octave"), strict=True)]) for k, by in enumerate(levels)])
    group = ["level", "lang", "script", "octave"]
    counts = fine.select(F.explode(each).alias("to"), "measure", "v", "c").select("to.*", "measure", "v", "c").groupBy(*group, "measure", "v").agg(F.sum("c").alias("c"))

    def stats(g: pd.DataFrame) -> pd.DataFrame:
        v, c = g["v"].to_numpy(np.float64), g["c"].to_numpy(np.int64)
        middle = _middle(v, c)
        return g.iloc[:1][[*group, "measure"]].assign(n=int(c.sum()), middle=middle, spread=_middle(np.abs(v - middle), c))

    found = counts.groupBy(*group, "measure").applyInPandas(stats, _STATS).filter((F.col("n") >= least) | (F.col("level") == 3))
    wide = found.groupBy(*group).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}") for m in _MEASURES for c in ("middle", "spread")])
    scripts = {r["script"]: r["c"] for r in fine.filter(F.col("measure") == _MEASURES[0]).groupBy("script").agg(F.sum("c").alias("c")).collect()}  # a row for each of SCRIPTS
    main = next((k for k, c in scripts.items() if 2 * c > sum(scripts.values())), None)
    return wide.withColumn("script", F.when(F.col("level") == 3, F.lit(main).cast("string")).otherwise(F.col("script")))


def judge(docs: DataFrame, width: float = WIDTH, joint: float = JOINT, least: int = LEAST_GROUP, few: int = FEW, **how) -> DataFrame:
    """measure() of every row with kept: false if the base rules fail or any measure is out of its group's band.

    Repeated rows are judged alike; no rows give no rows. With no document that passes the base rules there is no band.
    Up to `few` bands of languages are broadcast; where languages are as many as that, rows meet them by a join instead,
    common ones by salts, with the same result.
    """
    own = C.durable(measure(docs, **how))
    columns = [f"{m}_{c}" for m in _MEASURES for c in ("middle", "spread")]
    given = C.durable(bands(own, least)).withColumns({f"{m}_{c}": F.col(f"{m}_{c}") * STEP[m] for m in _MEASURES for c in ("middle", "spread")})
    key = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))  # a null lang is a language
    rows = own.withColumns({"_lang": key, "_octave": _octave()})
    band = F.struct(*columns)
    small = given.count() <= few
    for k, keys in ((0, ["_lang", "_octave"]), (1, ["_lang"])):
        table = given.filter(f"level = {k}").select(key.alias("_lang"), *[F.col("octave").alias("_octave")] * (k == 0), "n", band.alias(f"_b{k}"))
        rows = rows.join(F.broadcast(table.drop("n")), keys, "left") if small else C.join_hot(rows, table, keys, "n", "left").drop("n")
    table = given.filter("level = 2").select(F.col("script").alias("_script2"), band.alias("_b2"))
    rows = rows.join(F.broadcast(table), F.col("script") == F.col("_script2"), "left")  # a row a script at most
    table = given.filter("level = 3").select(F.col("script").alias("_script3"), band.alias("_b3"))
    rows = rows.join(F.broadcast(table), (F.col("script") == F.col("_script3")) | (F.col("script") == "none"), "left")  # one row
    rows = rows.withColumn("_band", F.coalesce("_b0", "_b1", "_b2", "_b3"))
    inside = F.lit(True)
    away = {m: (F.col(m) - F.col(f"_band.{m}_middle")) / F.greatest(1.4826 * F.col(f"_band.{m}_spread"), F.lit(FLOOR[m])) for m in _MEASURES}
    for m in _MEASURES:
        inside &= F.abs(away[m]) <= width
    inside &= ~((away["chars_per_token"] < -joint) & (away["entropy"] < -joint))
    inside |= F.col("_band").isNull()
    kept = ~F.col("base_failed") & inside
    return rows.select(*own.columns, kept.alias("kept"))


def op4(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the fertility measures."""
    return judge(C.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "entropy")
