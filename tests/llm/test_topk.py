import math

import numpy as np
import pytest

from marketlens.llm import topk


def brute(rows, every=100, k=10):
    good = [(i, np.array([math.floor(1024 * float(np.float32(x))) for x in v], object)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in good if i % every == 0}.items():
        scores = sorted((-int(sum(x * y for x, y in zip(a, v))), i) for i, v in good if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_table(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    assert rows_of(topk.top_k(table)) == brute([(r.vec_id, r.embedding) for r in table.collect()])


@pytest.mark.parametrize("limit", [topk.QUERY_BYTES, 90])
def test_cases(spark, monkeypatch, limit):
    monkeypatch.setattr(topk, "QUERY_BYTES", limit)  # 90: a pass for every two queries
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(0, 600, 4)]
    rows += [(1, rows[0][1]), (3, rows[0][1]), (5, None), (7, [None] * 8), (9, [float("nan")] * 8), (11, [float("inf")] * 8), (13, [0.0] * 8), (15, [1.0, 2.0]), (None, rows[0][1])]
    assert rows_of(topk.top_k(frame(spark, rows))) == brute(rows)


def test_few_or_no_rows(spark):
    assert rows_of(topk.top_k(frame(spark, []))) == [] == rows_of(topk.top_k(frame(spark, [(1, [1.0])])))
    assert rows_of(topk.top_k(frame(spark, [(0, [1.0]), (2, [1.0]), (1, [1.0])]))) == [(0, 1, 1, 1024 * 1024), (0, 2, 2, 1024 * 1024)]
    assert rows_of(topk.top_k(frame(spark, [(0, [])]))) == []


def test_large_components(spark):
    largest, least = (1 << 63) - 1, -(1 << 63)
    rows = [(0, [4e6, 1.0]), (1, [4e6, 2.0]), (2, [-4e6, 0.5]), (3, [0.25, 8.0]), (4, [3e38, 0.0]), (100, [1.0, 1.0])]
    want = []
    for q, r, i, s in brute([(i, v) for i, v in rows if i != 4]):
        want.append((q, i, min(max(s, least), largest)))
    got = [(r.query_id, r.vec_id, r.score) for r in topk.top_k(frame(spark, rows)).collect()]
    assert sorted(x for x in got if x[1] != 4) == sorted(want)
    assert (0, 4, largest) in got  # a component beyond a long is held at its end, and so is the score


def test_rows_that_repeat_a_query(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 5.0])]
    one = rows_of(topk.top_k(frame(spark, rows)))
    assert one == rows_of(topk.top_k(frame(spark, rows[::-1]))) == [(0, 1, 2, 5 << 20), (0, 2, 1, 0)]


@pytest.mark.parametrize("large", [1, 1 << 14])
def test_bounds_save_evaluations(large):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 16)) * 4000
    x = (np.repeat(centers, 100, 0) + rng.normal(size=(2000, 16)) * 200).astype(np.int64) * large
    space = topk.Space(16, float((x.astype(float) ** 2).sum(1).max()), int(abs(x).max()), x[::100][:16])
    s = topk.Search(space, np.arange(10), x[:10], 10)
    s.add(np.arange(2000), x, space.distances(x, space.extra(x)))
    assert s.evaluated < 0.5 * 10 * 2000
    want = [sorted((-int(v @ x[q]), i) for i, v in enumerate(x) if i != q)[:10] for q in range(10)]
    assert [[(-a, b) for a, b in zip(sc.tolist(), ids.tolist())] for sc, ids in s.best] == want
