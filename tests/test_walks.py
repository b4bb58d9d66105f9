"""Walks by doubling against a walk step by step, on random renamings with circles and forks."""

import random
from datetime import datetime

import pytest

from chronofact.operators.chains import rename_walk


def brute(edges, start, depth):
    out, seen, here = [], [start], start
    for step in range(1, depth + 2):
        ways = sorted((e for e in edges if e[1] == here), key=lambda e: (e[4], e[0]))
        if not ways:
            break
        closes, ambiguous = ways[0][3] in seen, len(ways) > 1
        out.append((start, step, ways[0][0], closes, ambiguous))
        if closes or ambiguous:
            break
        here = ways[0][3]
        seen.append(here)
    return [(*s, len(out) > depth) for s in out[:depth]]


@pytest.mark.parametrize("depth", [1, 2, 5, 10, 13])
def test_walks(spark, depth):
    rng = random.Random(depth)
    edges, n = [], 60
    for i in range(n):
        for _ in range(rng.choice([0, 1, 1, 1, 1, 1, 1, 2]) if i % 12 else 1):
            edges.append((f"e{len(edges):03}", f"N{i}", "renamedTo", f"N{rng.choice([i + 1, i + 1, i + 1, i, max(0, i - 3), rng.randrange(n)])}", datetime(2000, 1, 1 + rng.randrange(9)), None, "active", "global"))
    df = spark.createDataFrame(edges, "id string, subject string, predicate string, object string, validity_start timestamp, validity_end timestamp, status string, scope string")
    starts = spark.createDataFrame([(f"N{i}",) for i in range(n)] + [("N1",), (None,), ("unknown",)], "start string")
    got = sorted((r.start, r.step, r.id, r.closes, r.ambiguous, r.truncated) for r in rename_walk(df, starts, ["renamedTo"], max_depth=depth).collect())
    assert got == sorted(s for i in range(n) for s in brute(edges, f"N{i}", depth))
