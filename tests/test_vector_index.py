"""The inverted file of vectors: recall and pruning measured, exact results, awkward vectors."""

import random

import numpy as np
import pytest

from chronofact.operators import search
from chronofact.operators.vector_index import VectorIndex
from chronofact.plans.store import FactStore


def blobs(n, dims=8, centres=30, seed=1, spread=0.15):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    return [(i, (middle[i % centres] + spread * rng.normal(size=dims)).tolist()) for i in range(n)]


def rows(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())


def files_read(df):
    """Files that the scan of a plan opened."""
    df._jdf.collectToPython() if hasattr(df._jdf, "collectToPython") else df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


@pytest.mark.parametrize("metric", ["dot", "cosine", "l2"])
def test_exact_recall_and_files(spark, tmp_path, metric):
    df = spark.createDataFrame(blobs(1200), "id long, vector array<double>")
    asked = df.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    index = VectorIndex.build(df, f"{tmp_path}/{metric}", metric, cells=30)
    want = rows(search.dense(df, asked, 10, metric, digits=9))
    assert rows(index.search(asked, 10, probes=3, exact=True, digits=9)) == want
    near = rows(VectorIndex.open(spark, index.path).search(asked, 10, probes=6))
    recall = len({(q, i) for q, _, i, _ in near} & {(q, i) for q, _, i, _ in want}) / len(want)
    assert recall >= 0.9, recall
    # One query: the folders of its two cells are read, not the others'.
    middle, bound = index._bounds(np.array([blobs(1)[0][1]]))
    cells = np.argsort(-middle[0])[:2].tolist()
    assert 0 < files_read(index._vectors(cells)) < files_read(index._vectors()) / 5
    assert (bound >= middle).all()


def test_recall_on_given_embeddings(spark, tmp_path):
    """Unlike the blobs, these have no cells of their own: the table's 2000 vectors, default cells and probes."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    asked = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    want = {(q, i) for q, _, i, _ in rows(search.dense(v, asked, 10))}
    got = {(q, i) for q, _, i, _ in rows(VectorIndex.build(v, f"{tmp_path}/v").search(asked, 10))}
    assert len(got & want) >= 0.9 * len(want), len(got & want) / len(want)


def test_awkward_vectors(spark, tmp_path):
    data = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [0.5, 0.5]), (7, [0.0, 0.0]), (8, [-1.0, 0.0]), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in data], "id long, vector array<double>, cell int")
    asked = spark.createDataFrame([(1, [1.0, 0.5]), (2, None), (3, [1.0]), (None, [0.0, 1.0])], "query_id long, vector array<double>")
    index = VectorIndex.build(df, f"{tmp_path}/i", "dot", cells=2)
    key = lambda df: sorted(((r.query_id, r["rank"], r.id, r.score) for r in df.collect()), key=repr)
    good = df.where("id IS NULL OR id IN (1, 7, 8)").select("id", "vector")
    for k in (1, 3, 20):
        assert key(index.search(asked, k, probes=1, exact=True)) == key(search.dense(good, asked.where("query_id IS NULL OR query_id = 1"), k))
    empty = VectorIndex.build(df.limit(0), f"{tmp_path}/e")
    assert empty.search(asked, 5).count() == 0 and empty.search(asked, 5, exact=True).count() == 0
    assert index.search(asked.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        VectorIndex.build(df, f"{tmp_path}/x", "other")


def test_more_vectors_a_hot_cell_and_candidates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("chronofact.operators.vector_index.FILE_ROWS", 50)
    first, later = blobs(200, centres=4), [(1000 + i, [3.0 + i / 1000] * 8) for i in range(300)]
    schema = "id long, vector array<double>"
    index = VectorIndex.build(spark.createDataFrame(first, schema), f"{tmp_path}/i", "l2", cells=4).add(spark.createDataFrame(later, schema))
    everything = spark.createDataFrame(first + later, schema)
    asked = spark.createDataFrame([(1, [3.1] * 8), (2, first[7][1])], "query_id long, vector array<double>")
    assert rows(index.search(asked, 7, probes=1, exact=True)) == rows(search.dense(everything, asked, 7, "l2"))
    hot = max((f for f in index._vectors().inputFiles()), key=lambda f: sum(f.split("/")[-2] in g for g in index._vectors().inputFiles()))
    assert sum(hot.split("/")[-2] in g for g in index._vectors().inputFiles()) >= 2
    some = everything.where("id % 3 = 0").select("id")
    assert rows(index.search(asked, 7, probes=1, exact=True, candidates=some)) == rows(search.dense(everything.join(some, "id", "left_semi"), asked, 7, "l2"))


def test_index_of_a_store(spark, tmp_path):
    store = FactStore(spark, f"{tmp_path}/s")
    rng = random.Random(1)
    store.put_vectors(spark.createDataFrame([(str(i), [rng.random(), rng.random()]) for i in range(30)], "id string, vector array<double>"))
    index = store.vector_index(cells=3)
    assert store.vector_index().path == index.path
    store.put_vectors(spark.createDataFrame([("new", [9.0, 9.0])], "id string, vector array<double>"))
    asked = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, vector array<double>")
    assert store.vector_index().search(asked, 1).first().id == "new" and store.vector_index().path != index.path
