"""Top-k over rows: repeated and missing ids, large components, clashing columns."""

import numpy as np
import pytest
from brute import topk as brute_topk

from tangle.llm import topk


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rows_not_ids(spark, tmp_path):
    r = np.random.default_rng(9)
    v = lambda: [float(x) for x in np.float32(r.normal(0, 0.4, 5))]
    rows = [(i, v()) for i in range(60)]
    rows += [(100, v()), (100, v()), (100, rows[3][1]), (100, rows[3][1])]  # one id, several vectors, and a row that repeats
    rows += [(None, rows[5][1]), (None, rows[60][1]), (None, rows[60][1])]
    rows += [(200, rows[60][1])] * 2
    df = spark.createDataFrame([(i, x, 0, 1, 2) for i, x in rows], "vec_id long, embedding array<float>, v int, `a.b` int, row int").repartition(5)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert rows_of(topk.op7(spark, str(tmp_path))) == sorted(brute_topk(rows), key=str)


@pytest.mark.parametrize("size", [3e4, 1e10, 3e37])
def test_large_components(spark, size):
    r = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x * size)) for x in r.normal(0, 1, 3)]) for i in range(40)]
    v = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = rows_of(topk.search(v, v.filter("vec_id % 10 = 0"), k=4))
    most = topk.MOST
    whole = {i: [max(-most, min(most, int(np.floor(1024 * float(x))))) for x in x] for i, x in rows}
    want = []
    for q in range(0, 40, 10):
        s = sorted((-max(1 - most, min(most - 1, sum(a * b for a, b in zip(whole[q], whole[i], strict=True)))), i) for i in whole if i != q)[:4]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert got == sorted(want, key=str)
