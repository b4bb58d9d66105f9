"""Postings in blocks: the same rows as the plain search, fewer blocks read, segments that changes add."""

import random

import pytest
from pyspark.sql import functions as F

from chronofact.functions.analysis import terms
from chronofact.operators import block_index, search
from chronofact.operators.block_index import BlockIndex

WORDS = "alpha beta gamma delta running runner ran cars car écoles ecole naïve 42 zeta".split()
SCHEMA = "id long, text string"


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS, weights=range(1, 15), k=rng.choice([1, 3, 9, 30, 120])))) for i in range(n)]


def ranks(df):
    return sorted(((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect()), key=repr)


def plain(spark, rows, asked, **options):
    texts = spark.createDataFrame(rows, SCHEMA)
    index = search.postings(texts, "id", "text")
    return ranks(search.bm25(index, search.statistics_of(index, texts), asked, **options))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "alpha"), (2, "zeta cars"), (3, "Running, naive écoles"), (4, "nothing"), (5, ""), (6, None)], "query_id long, query string")


def test_postings_as_analysed(spark):
    """Stemming distinct words gives what stemming every text gives, marks alone included, whatever is broadcast."""
    rows = corpus(60) + [(100, "́ alone ́̂ x"), (101, None), (102, "..."), (None, "alpha Alpha"), (7, "repeated row"), (7, "repeated row")]
    df = spark.createDataFrame(rows, SCHEMA)
    key = lambda df: sorted(map(tuple, df.select("term", "id", "tf", "length").collect()), key=repr)
    want = key(search.postings(df, "id", "text", lambda c: terms(c)))
    assert key(search.postings(df, "id", "text")) == want


def test_postings_with_few_broadcast_words(spark, monkeypatch):
    df = spark.createDataFrame(corpus(60), SCHEMA)
    key = lambda df: sorted(map(tuple, df.select("term", "id", "tf", "length").collect()), key=repr)
    want = key(search.postings(df, "id", "text"))
    monkeypatch.setattr(search, "BROADCAST_WORDS", 3)
    assert key(search.postings(df, "id", "text")) == want


def test_same_rows_and_fewer_blocks(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(block_index, "BLOCK", 8)
    monkeypatch.setattr(block_index, "FIRST", 2)
    rows = corpus(900)
    index = BlockIndex(spark, f"{tmp_path}/i", "bigint").change(spark.createDataFrame(rows, SCHEMA))
    for k in (1, 7, None):
        assert ranks(index.bm25(asked, top_k=k, digits=9)) == plain(spark, rows, asked, top_k=k, digits=9)
    assert ranks(index.bm25(asked, top_k=7)) == plain(spark, rows, asked, top_k=7)
    scored, run = [], BlockIndex._scored
    monkeypatch.setattr(BlockIndex, "_scored", lambda self, wanted, *a: (scored.append(wanted.where("query_id = 1").count()), run(self, wanted, *a))[1])
    index.bm25(asked, top_k=3)
    all_blocks = index.blocks().where(F.col("term") == "alpha").count()
    assert 0 < sum(scored) < all_blocks / 3, (scored, all_blocks)
    some = spark.createDataFrame([(i,) for i in range(0, 900, 9)], "id long")
    assert ranks(index.bm25(asked, some, 5, 9)) == plain(spark, rows, asked, candidates=some, top_k=5, digits=9)


def test_segments_of_changes(spark, tmp_path, asked, monkeypatch):
    """Texts that come, go and change; bounds and frequencies follow, and a merged index gives the same."""
    monkeypatch.setattr(block_index, "BLOCK", 16)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    first, more = corpus(200), [(1000 + i, t) for i, t in corpus(80, 2)]
    index = BlockIndex(spark, f"{tmp_path}/i", "bigint").change(frame(first), label="1")
    changed = [(i, "alpha zeta cars " + t) for i, t in first[:30]]
    index.change(frame(more + changed), frame(first[:60]), "2").change(frame(first[30:40]), frame(more[:5]), "3")
    now = changed + first[30:40] + first[60:] + more[5:]
    want = plain(spark, now, asked, top_k=9, digits=9)
    assert ranks(index.bm25(asked, top_k=9, digits=9)) == want and index.label() == "3" and index.segments() == [1, 2, 3]
    assert ranks(index.rebuilt(frame(now), "4").bm25(asked, top_k=9, digits=9)) == want and index.segments() == [4]
    index.change(frame([(5000, "zeta cars")]), label="5")
    assert ranks(index.bm25(asked, top_k=9, digits=9)) == plain(spark, now + [(5000, "zeta cars")], asked, top_k=9, digits=9)


def test_empty_index(spark, tmp_path, asked):
    index = BlockIndex(spark, f"{tmp_path}/i", "bigint")
    assert index.bm25(asked).count() == 0 and index.label() is None
    assert index.change(spark.createDataFrame([], SCHEMA)).bm25(asked).count() == 0
    assert index.bm25(asked.limit(0)).count() == 0
