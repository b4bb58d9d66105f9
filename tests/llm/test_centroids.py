"""k-means on integers against Python's integers, ties and screening that single precision cannot settle."""

import hashlib
import math
import random

import numpy as np
import pytest

from chronofact.llm.centroids import FAR, SMALL, Centroids, _limbs, centroid_clusters


def brute(rows, k=8, dims=64, scale=1024, rounds=10):
    kept = [(i, [math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: "" if i is None else str(i)
    kept.sort(key=lambda r: hashlib.sha256(f"3:{name(r[0])}".encode()).hexdigest())
    centroids = [v for _, v in kept[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        groups = [[v for (_, v), c in zip(kept, own) if c == n] for n in range(len(centroids))]
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else old for g, old in zip(groups, centroids)]
    own = assign()
    d = [far(v, centroids[c]) for (_, v), c in zip(kept, own)]
    fit = lambda x: x if x < 2**63 else None
    total = [sum(x for x, c in zip(d, own) if c == n) for n in range(len(centroids))]
    out = [(i, c, fit(x), fit(total[c]), fit(sum(d)), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), c, x in zip(kept, own, d)]
    return sorted(out, key=repr)


def run(spark, rows, kind="double", **given):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int").repartition(3)
    return sorted(map(tuple, centroid_clusters(df, **given).collect()), key=repr)


def test_random_vectors_and_awkward_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 5, 1.0) for _ in range(64)]) for i in range(120)]
    rows += [(7, rows[7][1]), (500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 63 + [None]), (504, [1.0] * 63 + [float("nan")]), (505, [float("inf")] * 64), (506, [0.0] * 64), (507, [-0.0] * 64), (None, [0.5] * 64), (508, [1e-320] * 64), (509, [-1e-320] * 64)]
    assert run(spark, rows) == brute(rows)


def test_ties_go_to_the_smaller_number(spark):
    """Few distinct values: many equal distances, empty clusters and repeated centroids."""
    rng = random.Random(6)
    rows = [(i, [float(rng.choice([0, 1])) / 1024 if d < 3 else 0.0 for d in range(64)]) for i in range(90)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(i, [1.0] * 64) for i in range(20)]) == brute([(i, [1.0] * 64) for i in range(20)])


@pytest.mark.parametrize("size", [2.0**16, 2.0**17 - 1, 2.0**20, 1e9, 1e40, 1e305])
def test_great_components(spark, size):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) * (size if i % 4 == 0 else 1) for _ in range(64)]) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_few_vectors_and_empty_table(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == []


def test_other_parameters(spark):
    rng = random.Random(9)
    rows = [(i, [rng.random(), rng.random()]) for i in range(50)]
    assert run(spark, rows, "float", k=3, dims=2, scale=16, rounds=2) == brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 3, 2, 16, 2)


def test_screening_is_rigorous():
    """Where single precision can't tell centroids apart, integers do; where it can, they aren't asked."""
    rng = np.random.default_rng(1)
    for size in (3, 1000, 2**24, SMALL):
        x = rng.integers(-size, size + 1, (300, 64)).astype(np.int32)
        rows = rng.integers(-size, size + 1, (8, 64))
        rows[1] = rows[0]
        rows[2] = np.clip(rows[0] + rng.integers(-1, 2, 64), -SMALL, SMALL)
        model = Centroids([r.tolist() for r in rows])
        want = np.array([min(range(8), key=lambda k: (sum((int(a) - int(b)) ** 2 for a, b in zip(v, rows[k])), k)) for v in x])
        got, asked = model.nearest(x)
        assert (got == want).all()
        assert set(np.flatnonzero(want == 0)) <= set(asked)
    apart = Centroids([[0] * 64, [1000] * 64, [FAR] * 64])
    got, asked = apart.nearest(np.array([[1] * 64, [990] * 64], np.int32))
    assert got.tolist() == [0, 1] and not len(asked)
    assert Centroids([[SMALL + 1] * 64, [0] * 64, [FAR - 1] * 64]).nearest(np.array([[SMALL] * 64], np.int32))[0].tolist() == [0]


def test_limbs():
    for v in (0, 1, -1, 2**24, -(2**24), 2**24 - 1, 12345678901234567890, -98765432109876543210):
        assert sum(x << (24 * n) for n, x in _limbs(v)) == v and all(abs(x) <= 2**24 for _, x in _limbs(v))
