"""Named queries on small tables against brute force."""

import string
from collections import Counter
from datetime import datetime

from chronofact.plans import queries


def words(text):
    return [w for w in "".join(c for c in text.lower() if c not in string.punctuation).split() if w not in ("a", "an", "the")]


def test_answer_f1_of_whole_texts(spark, tmp_path):
    said = ["one two " * 40 + "three four", "one two " * 40 + "five six seven", "Eight. " * 60 + "nine", "nine " * 70]
    spark.createDataFrame([(1, t, text) for t, text in enumerate(said)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for turn, (a, b) in enumerate(zip(said[:-1], said[1:], strict=True)):
        a, b = words(a), words(b)
        want[turn] = round(2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b)), 6)
    assert {r.turn: r.f1 for r in queries.answer_f1(spark, str(tmp_path)).collect()} == want


def test_rename_walks_of_every_customer(spark, tmp_path):
    rows = [(10 * c + i, c, datetime(2000, 1, 1 + (i + c) % 4)) for c in range(1, 8) for i in range(4)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    ahead, back = set(), set()
    for c in range(1, 8):
        chain = [k for _, k in sorted((day, k) for k, own, day in rows if own == c)]
        at = chain.index(min(chain))
        ahead |= {(f"O{min(chain)}", i + 1, f"e{k}", False) for i, k in enumerate(chain[at:-1])}
        back |= {(f"O{min(chain)}", i + 1, f"e{k}", False) for i, k in enumerate(reversed(chain[:at]))}
    rows_of = lambda f: sorted(tuple(r) for r in f(spark, str(tmp_path)).collect())
    assert rows_of(queries.rename_walk) == sorted(ahead)
    assert rows_of(queries.rename_walk_backward) == sorted(back)


def test_passages_of_all_hits(spark, tmp_path):
    def lines(path, late=None):
        rows = [(2 if part == late else 1, part, 3, datetime(2000, 1, 1)) for part in range(600)]
        spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_shipdate timestamp_ntz").write.parquet(f"{path}/lineitem.parquet")
        return str(path)

    last = max(queries.facts_ship(spark, lines(tmp_path / "a")).select("id", "subject").collect())
    d = lines(tmp_path / "b", int(last.subject.removeprefix("Part#")))
    assert {r.source_id: r["rank"] for r in queries.passages_of_hits(spark, d).collect()} == {"S1": 1, "S2": 600}
