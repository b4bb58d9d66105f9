"""Containment of items in texts against the plain comparison of each pair."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronofact.functions.texts import contains_expected
from chronofact.operators.containment import containing


def plain(docs, items):
    return docs.join(items, contains_expected(F.col("text"), F.col("expected"))).select("item_id", "doc_id")


@pytest.mark.parametrize("block", [40, 50_000])
def test_containment_is_that_of_each_pair(spark, block):
    rng = random.Random(3)
    vocabulary = ["red", "Reds", "red-hot", "the", "a", "bolt", "bolts", "ñandú", "x", "  ", "of", "off", "\n", "it's"]
    said = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 9, 60]))) for _ in range(80)]
    pieces = [t[i : i + rng.choice([1, 2, 4, 9, 20, 70])] for t in said for i in [rng.randrange(len(t) + 1)]]
    docs = spark.createDataFrame([*enumerate(said), (3, said[9]), (3, said[9]), (None, said[8]), (99, None), (98, "red " * 500 + "bolt of")], "doc_id long, text string")
    items = spark.createDataFrame([*enumerate(pieces), (5, "d bolt o"), (5, "red red red red red bol"), (None, "ed b"), (77, None), (78, "the"), (79, "never in any of them")], "item_id long, expected string")
    got, want = (Counter(map(tuple, f.collect())) for f in (containing(docs, items, block), plain(docs, items)))
    assert got == want and len(want) > 500
    assert containing(docs, items.where("item_id = 78")).count() == 0


def test_no_pair_of_all_is_compared(spark):
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    for expected in ("wo three four fi", "hree", "o thr"):
        found = containing(docs, spark.createDataFrame([(1, expected)], "item_id long, expected string"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and found.count() == 1
