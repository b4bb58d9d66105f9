"""The TF-IDF encoder, its cosine search, and the choice of diverse candidates against plain Python."""

import math
import random
from collections import Counter

import pytest

from chronofact.operators import seeds
from chronofact.operators.seeds import Encoder, cosine_topk, diverse, similar_texts

TEXTS = ["Google ceo", "google CEO founded", "Twitter renamed", "Twitter formerly known as", "X Corp owner", "x", "", None, "Ärzte ohne Grenzen", "a bc def", "Google  ceo"]


def brute(texts):
    def grams(t):
        out = []
        for w in (t or "").lower().split():
            w = f" {w} "
            out += [w[i : i + 3] for i in range(max(1, len(w) - 2))]
        return Counter(out)

    all_ = [grams(t) for t in texts]
    df = Counter(g for c in all_ for g in c)
    out = []
    for c in all_:
        v = {g: n * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({g: x / norm for g, x in v.items()})
    return out


def dot(a, b):
    return sum(x * b.get(g, 0.0) for g, x in a.items())


def greedy(vectors, quality, budget):
    n = len(vectors)
    if n <= budget:
        return sorted(range(n), key=lambda i: (-quality[i], i))
    top = max(quality) + 1e-9
    q, near, out = [0.5 + 0.5 * x / top for x in quality], [0.0] * n, []
    while len(out) < budget:
        best = min((i for i in range(n) if i not in out), key=lambda i: (-round(q[i] * (1 - near[i]), 12), i))
        out.append(best)
        near = [max(a, dot(vectors[i], vectors[best])) for i, a in enumerate(near)]
    return out


def test_vectors_and_search(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, "Google", 0)], "id long, text string, w int")
    encoder = Encoder.fit(df.where("id is not null"))
    got = {}
    for r in encoder.vectors(df.unionByName(df)).collect():
        got.setdefault(r.id, {})[r.gram] = r.w
    want = brute(TEXTS)
    assert set(got) == {i for i, v in enumerate(want) if v}
    assert all(set(got[i]) == set(want[i]) and all(abs(got[i][g] - x) < 1e-12 for g, x in want[i].items()) for i in got)
    asked = encoder.vectors(spark.createDataFrame([(1, "google's ceo"), (2, "qqq"), (3, None)], "id long, text string")).withColumnRenamed("id", "query_id")
    best = cosine_topk(encoder.vectors(df), asked, 2, 9).orderBy("rank").collect()
    assert [(r.query_id, r.id) for r in best] == [(1, 0), (1, 10)] and best[0].score > 0.5
    assert Encoder.fit(df, features=3).idf.count() == 3


@pytest.mark.parametrize("batch", [2, 7, 1000])
def test_diverse_is_the_greedy_choice(spark, batch):
    rng = random.Random(batch)
    texts = [" ".join(rng.choices(["google", "ceo", "twitter", "owner", "founded", "renamed", "capital"], k=rng.choice([1, 2, 3]))) for _ in range(60)]
    quality = [rng.choice([0.2, 0.5, 1.0, 1.0]) for _ in texts]
    df = spark.createDataFrame([(i, t, q, "z") for i, (t, q) in enumerate(zip(texts, quality))], "id long, text string, quality double, gram string")
    got = diverse(df, Encoder.fit(df).vectors(df), 9, batch)
    assert [r.id for r in got.orderBy("place").collect()] == greedy(brute(texts), quality, 9)


def test_diverse_awkward(spark):
    df = spark.createDataFrame([(1, "a", 0.1), (2, None, 0.9), (2, None, 0.9), (None, "b", 5.0), (3, "a", None)], "id long, text string, quality double")
    vectors = Encoder.fit(df).vectors(df)
    assert [r.id for r in diverse(df, vectors, 9).orderBy("place").collect()] == [2, 1, 3]
    assert [r.id for r in diverse(df, vectors, 2).orderBy("place").collect()] == [2, 1]
    assert diverse(df.limit(0), vectors, 3).count() == 0


def test_equal_texts_are_compared_once(spark, monkeypatch):
    rng = random.Random(5)
    texts = [rng.choice(TEXTS) for _ in range(150)]
    rows = [*enumerate(texts), (3, texts[3]), (4, "renamed owner"), (None, "Google")]
    df = spark.createDataFrame(rows, "id long, text string")
    encoder = Encoder.fit(df)
    asked = df.where("id % 4 = 0 or id is null").withColumnRenamed("id", "query_id")
    pairs = []

    def counted(vectors, queries, *rest):
        pairs.append(vectors.select("id").distinct().count() * queries.select("query_id").distinct().count())
        return cosine_topk(vectors, queries, *rest)

    monkeypatch.setattr(seeds, "cosine_topk", counted)
    for k in (1, 3, 40):
        want = cosine_topk(encoder.vectors(df), encoder.vectors(asked, "query_id").withColumnRenamed("id", "query_id"), k, 9)
        got = similar_texts(encoder, df, asked, k, 9)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert max(pairs) <= 12 * 12 and len(pairs) == 3
