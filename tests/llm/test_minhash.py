"""Near-duplicates and components against brute force."""

import random

import numpy as np
import pytest

from chronofact.llm import minhash
from chronofact.llm.components import connected_components
from chronofact.llm.minhash import near_duplicates


def shingle_set(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, _) in enumerate(rows):
        for y in range(x):
            j = rows[y][0]
            if i is not None and j is not None and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def corpus(seed, groups, size, words=60):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(words)] = f"x{rng.randrange(9999)}"
            rows.append((len(rows) + 10, " ".join(own)))
    rng.shuffle(rows)
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long").repartition(3)
    return sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)


def test_against_brute_force(spark):
    rows = corpus(1, 40, 4) + [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One\ttwo"), (6, "one two three"), (7, "É a b c d e"), (8, "é a b c d e"), (None, "one two"), (9, "z " * 9000), (9, "z " * 9000)]
    assert run(spark, rows) == brute(rows)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 64)
    rows = corpus(2, 1, 300, 40) + [(i + 1000, t) for i, t in corpus(3, 30, 2)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "empty"])
def test_components(spark, shape):
    rng = np.random.default_rng(0)
    pairs = {"chain": [(i, i + 1) for i in range(300)], "star": [(500, i) for i in range(300)], "random": rng.integers(0, 400, (300, 2)).tolist(), "empty": []}[shape]
    root = {x: x for p in pairs for x in p}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    assert {x: got.get(x, x) for x in root} == {x: find(x) for x in root}


def test_real_pairs_hidden_in_a_template_family(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 128)
    template, rows = " ".join(f"t{i}" for i in range(200)), []
    for family in range(150):
        shared = " ".join(f"s{family}x{i}" for i in range(8))
        for twin in range(2):
            mine = shared if family < 25 else " ".join(f"s{family}x{twin}x{i}" for i in range(8))
            rows.append((len(rows), f"{template} {mine} " + " ".join(f"o{family}x{twin}x{i}" for i in range(34))))
    random.Random(4).shuffle(rows)
    want = brute(rows)
    assert sum(not kept for *_, kept in want) == 25
    assert run(spark, rows) == want


def test_region_of_similarities_about_the_threshold(spark):
    """One region of over 1000 sets, all of one text, whose similarities to each other lie on both sides of 0.75."""
    rng = random.Random(6)
    base, rows = [f"w{i}" for i in range(300)], []
    for i in range(1300):
        own = list(base)
        for _ in range(rng.randrange(3, 10)):
            own[rng.randrange(300)] = f"x{i}y{rng.randrange(9999)}"
        rows.append((i, " ".join(own)))
    want = brute_fast(rows)
    assert 50 < sum(kept for *_, kept in want) < 1250
    assert run(spark, rows) == want


def brute_fast(rows, k=5):
    number = {}
    sets = [{number.setdefault(g, len(number)) for g in shingle_set(t, k)} for _, t in rows]
    x = np.zeros((len(rows), len(number)), np.float32)
    for i, s in enumerate(sets):
        x[i, list(s)] = 1
    both, size = x @ x.T, x.sum(1)
    hit = 100 * both >= 75 * (size[:, None] + size - both)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(hit), strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return sorted(((i, int(n), find(i), find(i) == i) for (i, _), n in zip(rows, size, strict=True)), key=str)


@pytest.mark.parametrize("leaf", [2, 32])
def test_parts_follow_the_longest_prefixes(monkeypatch, leaf):
    monkeypatch.setattr(minhash, "LEAF", leaf)
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 3, (500, minhash.VALUES)).astype(np.uint8)
    labels[:, : minhash.DEPTH] = 0
    labels[100:150] = labels[100]
    labels = labels[np.lexsort(labels.T[::-1])]
    cut = np.flatnonzero(minhash._parts(labels, np.arange(500) == 0))
    for a, b in zip(cut, [*cut[1:], 500], strict=True):
        assert b - a <= leaf or (labels[a] == labels[b - 1]).all()
