"""Scripts of texts, and small languages beside a large one."""

import numpy as np
import pyarrow as pa
import pytest

from tangle.llm import common, fertility

TEXTS = {
    "latin": "Ein schöner Tag, été, Łódź", "greek": "Καλημέρα σε όλους", "cyrillic": "Съешь ещё этих мягких булок", "armenian": "Բարեւ աշխարհ", "hebrew": "שלום לכולם",
    "arabic": "صباح الخير جميعا", "devanagari": "नमस्ते दुनिया कैसे हो", "bengali": "ওহে বিশ্ব", "tamil": "வணக்கம் உலகம்", "thai": "สวัสดีชาวโลก", "georgian": "გამარჯობა მსოფლიო",
    "ethiopic": "ሰላም ለዓለም", "khmer": "សួស្តីពិភពលោក", "hangul": "안녕하세요 여러분", "kana": "今日は良い天気ですね東京", "han": "今天天气很好，我们去公园", "none": "12 + 3 = 15 … — € 🙂", "other": "𐌰𐌱𐌲𐌳",
}


@pytest.mark.parametrize("mixed", ["", " 2024: — "])
def test_one_text_a_script(mixed):
    texts = [*(t + mixed for t in TEXTS.values()), None, ""]
    got = fertility.scripts_of(*common.buffers(pa.array(texts, pa.string())))
    assert got.tolist() == [*TEXTS, "none", "none"]


def test_small_languages_are_not_judged_by_another_script(spark):
    r = np.random.default_rng(5)
    words = {"en": "the house of green river stones walks under morning".split(), "ja": "今日は 良い 天気です ね 東京へ 行きます 私は 本を 読む".split(), "ru": "утро река дом зелёный камень идёт под старый мост".split()}
    rows = [(k * 1000 + i, " ".join(r.choice(words[lang], 70 + int(n))), lang) for k, (lang, m) in enumerate({"en": 60, "ja": 9, "ru": 9}.items()) for i, n in enumerate(r.integers(0, 40, m))]
    rows += [(5000 + i, " ".join("&&&" + w if k % 2 else "$$$" + w for k, w in enumerate(r.choice(words["en"], 80))), "xx") for i in range(3)]
    rows += [(6000, " ".join(f"{k * 7919 % 1000} $&|" for k in range(60)), "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clean = {i for i, _, lang in rows if lang in words}
    for least in (10, 65):  # en a group of its own; too few everywhere
        got = {x.doc_id: x for x in fertility.judge(docs, least=least).collect()}
        assert all(got[i].kept for i in clean if not got[i].base_failed)
        assert not any(got[i].base_failed for i in (1000, 2000, 5000))
        assert not any(got[i].kept for i in got if i >= 5000)  # junk takes the band of its script or of all
