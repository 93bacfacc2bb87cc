import numpy as np
import pytest

from newsloom.llm import neighbours


def brute(rows, k=5):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    out = {}
    for at, i in enumerate(ids):
        if i % 50 == 0:
            s = (x * x[at]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[at] * x[at]).sum()))
            out[i] = sorted((-round(float(c), 12), j) for c, j in zip(s, ids) if j != i)[:k]
    return out


@pytest.mark.parametrize("block", [20_000, 40])
def test_recall_scores_and_order(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(1200, 16)).astype("float32")
    base[100:500] = base[50]  # a third of all rows are one vector
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in neighbours.search(df, "vec_id % 50 = 0").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows)
    assert got.keys() == want.keys()
    hit = 0
    vectors = dict(rows)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(a[2] >= b[2] and (a[2] > b[2] or a[1] < b[1]) for a, b in zip(found, found[1:]))
        for _, i, score in found:
            a, b = np.array(vectors[q]), np.array(vectors[i])
            assert abs(score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
        hit += len({f[1] for f in found} & {i for _, i in want[q]})
    assert hit / (5 * len(want)) >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0])]
    rows += [(7, [inf, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (50, [3.0, 0.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "2 AS cell")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in neighbours.search(df, "vec_id % 50 = 0").collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 50, 1.0), (0, 3, 2, 0.0), (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 2, 0.0)]
    assert neighbours.search(df.limit(0), "vec_id % 50 = 0").count() == 0
