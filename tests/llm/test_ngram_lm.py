"""The bigram model against a plain one in Python, and its probabilities' sum."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofact.llm import ngram_lm as lm


def corpus(n=300):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        words, w = [], 0
        for _ in range(rng.randrange(30)):
            w = (w * 7 + rng.choice([1, 2, 3, 50])) % 200 if rng.random() < 0.8 else rng.randrange(200)
            words.append(vocabulary[w].upper() if rng.random() < 0.1 else vocabulary[w])
        rows.append((i, " ".join(words)))
    return rows + [(1000, None), (1001, ""), (1002, "neverseen neverseen w1"), (None, "w1 w2"), (1003, "w5 " * 30_000), (1003, "w5 " * 30_000)]


def plain(rows):
    """Interpolated modified Kneser-Ney by its definition."""
    split = {i: [*(t or "").lower().split(), "</s>"] for i, (_, t) in enumerate(rows)}
    train = [i for i, (d, _) in enumerate(rows) if d is None or zlib.crc32(str(d).encode()) % 10]
    c = Counter(w for i in train for w in split[i])
    pairs = Counter(p for i in train for p in zip(["<s>", *split[i]], split[i]))
    after = Counter(w for _, w in pairs)
    d2 = lm.discounts([sum(n == k for n in pairs.values()) for k in range(1, 5)])
    d1 = lm.discounts([sum(n == k for n in after.values()) for k in range(1, 5)])
    total, kinds = Counter(), Counter()
    for (v, _), n in pairs.items():
        total[v] += n
        kinds[v, min(n, 3)] += 1
    rest1 = sum(d1[min(n, 3) - 1] for n in after.values()) / len(pairs)
    size, tokens = len(c), sum(c.values())

    def p(v, w):
        n = after[w]
        low = (max(n - d1[min(n, 3) - 1], 0) if n else 0) / len(pairs) + rest1 / (size + 1)
        if not total[v]:
            return low
        n = pairs[v, w]
        return (max(n - d2[min(n, 3) - 1], 0) if n else 0) / total[v] + sum(d2[k - 1] * kinds[v, k] for k in (1, 2, 3)) / total[v] * low

    assert abs(sum(p("w1", w) for w in [*c, "never in any text"]) - 1) < 1e-9
    out = []
    for i, (d, _) in enumerate(rows):
        words = split[i]
        out.append((d, i not in train, len(words), sum(c[w] > 0 for w in words), tokens, sum(math.log10((c[w] + 0.1) / (tokens + 0.1 * (size + 1))) for w in words), sum(math.log10(p(v, w)) for v, w in zip(["<s>", *words], words))))
    return out


@pytest.mark.parametrize("bounds", [{}, {"gathered": 50, "very_common": 40, "bucket_bytes": (3000, 1000)}])
def test_against_definition(spark, bounds):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int").repartition(3).withColumn("held_out", lm.held_out())
    got = lm.score(df, lm.train(df.where("not held_out"), **bounds), columns=["doc_id", "held_out"]).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    for a, b in zip(sorted((tuple(r)[:7] for r in got), key=key), sorted(plain(rows), key=key), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9), (a, b)


def test_very_common_words_are_dealt_to_several_buckets(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    model = lm.train(df, very_common=40)
    assert len(model.common.words) > 3 and max(model.common.spread) > 1 and model.words.size in model.common.words
    assert sum(not sum(x) for x in model.common.stats) <= 1  # nothing follows the end
    pairs = (np.uint64(model.common.words[0]) << np.uint64(32)) | np.arange(500, dtype=np.uint64)
    assert len(set(model.common.bucket_of_pair(pairs, model.words.size, model.pair_buckets))) == model.common.spread[0]


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.score(df, lm.train(df.where(F.lit(False)))).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert all(abs(r.base_score) < 1e-9 and abs(r.score) < 1e-9 for r in got)
    assert lm.score(df.limit(0), lm.train(df)).count() == 0
