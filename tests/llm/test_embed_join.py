"""Near-duplicate vectors against brute force."""

import numpy as np
import pytest

from chronofact.llm import embed_join
from chronofact.llm.embed_join import near_vectors


def brute(rows, cosine=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    width = max((len(v) for _, v in good), default=1)
    x = np.array([np.pad(v, (0, width - len(v))) for _, v in good]).reshape(-1, width)
    norm = np.sqrt((x * x).sum(1))
    hit = (x @ x.T) / np.outer(norm, norm) >= cosine
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(hit), strict=True):
        a, b = find(good[a][0]), find(good[b][0])
        root[max(a, b)] = min(a, b)
    number = {i: int(n) - 1 for (i, _), n in zip(good, hit.sum(1), strict=True)}
    return sorted(((i, number.get(i, 0), None if i is None else find(i), i is None or find(i) == i) for i, _ in rows), key=str)


def vectors(seed, n, dims):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    x = centres[rng.integers(0, 12, n)] + 0.25 * rng.normal(size=(n, dims))
    x[: n // 8] = x[0] + 0.05 * rng.normal(size=(n // 8, dims))
    x[n // 2 : n // 2 + 20] = x[1]
    x[n - 5 :] = 3 * x[2]
    return [(int(i), [float(np.float32(c)) for c in v]) for i, v in zip(rng.permutation(n) + 5, x, strict=True)]


@pytest.mark.parametrize("interval,fan,kind", [(2048, 16, "float"), (160, 2, "float"), (40, 3, "double"), (7, 3, "float")])
def test_against_brute_force(spark, monkeypatch, interval, fan, kind):
    monkeypatch.setattr(embed_join, "FAN", fan)
    odd = [(1, None), (2, []), (3, [0.0] * 10), (4, [1.0, None] * 5), (None, [1.0] * 10), (0, [float("nan")] * 10), (1000, [float("inf")] * 10), (1001, [1.0]), (1002, [2.0]), (1003, [1e-30] * 10), (1004, [1e30] * 10)]
    rows = vectors(3, 300, 10) + odd
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], f"vec_id long, embedding array<{kind}>, n int").repartition(3)
    assert sorted((tuple(r) for r in near_vectors(df, interval=interval).collect()), key=str) == brute(rows)


def test_nothing_to_link(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in near_vectors(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert near_vectors(df.limit(0)).count() == 0
