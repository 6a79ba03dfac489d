import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"pass{k}age" for k in range(60))


def document_rows():
    """Copies, near copies, a shared passage, junk, nulls, empty, very long and repetitive texts, repeated rows."""
    base = [" ".join(f"w{(i * 37 + k * k * (i + 3)) % 997}" for k in range(40 + 7 * i)) for i in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(20 + i, t, "en", "s0", len(t)) for i, t in enumerate(base[:4])]
    rows += [(30, base[11] + " tail", "en", "s1", None), (31, base[10].upper(), "en", None, 1), (32, base[9].replace(" ", "\n\t"), None, "s2", 2)]
    rows += [(40 + i, f"{base[i][:90]} {PASSAGE} {base[i + 4][90:300]}", "en", "s1", 9) for i in range(5)]
    rows += [(50, "again " * 300, "en", "s0", 0), (51, "x\n\nx\nline one here\nline one here\r\n # * $ | <a>", "de", "s2", 0)]
    rows += [(60, None, None, None, None), (61, "", "en", "s0", 0), (62, " \t\n\x0b\x0c\r ", "en", "s0", 0), (63, "one", "en", "s0", 3), (64, "one two", "en", "s0", 3), (65, "É日本 語 \xa0 naïve… ’s don't 5,6.", "fr", "s0", 1)]
    rows += [(70, " ".join(f"long{k % 5003}" for k in range(30000)), "en", "s2", 0)]
    rows += [(80, base[2] + " extra", "en", "s0", 0)] * 2
    return rows


@pytest.fixture(scope="session")
def rows():
    return document_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def odd(spark, rows):
    """The same with a row without id and with columns whose names operators use themselves."""
    extra = spark.createDataFrame([(*r, 1, "a", "b", 2, 3, "c") for r in [*rows[:6], (None, rows[0][1], "en", "s0", 5), (None, None, None, None, None)]], DOCS + ", size long, row string, rest string, rk long, fp long, windows string")
    return extra


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
