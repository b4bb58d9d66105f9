"""Readers, corpora and streams."""

import json
from datetime import UTC, datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from chronofact.functions.extraction import cached_extract, trigger_extractor
from chronofact.functions.vocabulary import Vocabulary
from chronofact.operators import catalog
from chronofact.operators.conflicts import resolve_conflicts
from chronofact.sources import corpora, readers, stores
from chronofact.streaming.ingest import event_windows, stream_conflicts, upsert_sink


def test_jsonl(spark, tmp_path):
    lines = ['{"source_id": "a", "text": "x", "source_date": "2020-01-02T03:04:05Z"}', "", "{broken", '{"text": "no id"}', '{"source_id": "b", "text": "y", "uri": "u", "source_date": "soon"}']
    path = tmp_path / "docs.jsonl"
    path.write_text("\n".join(lines))
    rows = sorted(readers.documents_jsonl(spark, str(path)).collect())
    assert [(r.source_id, r.uri, r.source_date) for r in rows] == [("a", None, datetime(2020, 1, 2, 3, 4, 5)), ("b", "u", None)]
    with pytest.raises(Exception, match="bad document row"):
        readers.documents_jsonl(spark, str(path), strict=True).collect()


def test_folder_and_passages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("a.txt", "one"), ("sub/b.md", "two\n\nthree\n \nfour"), ("c.csv", "no"), ("d.txt", "  ")):
        (tmp_path / name).write_text(text)
    assert sorted(r.source_id for r in readers.documents_folder(spark, str(tmp_path)).collect()) == ["a.txt", "sub/b.md"]
    assert [(r.position, r.text) for r in readers.passages_text(spark, str(tmp_path / "sub/b.md")).collect()] == [(0, "two"), (1, "three"), (2, "four")]
    batch = tmp_path / "q.jsonl"
    batch.write_text(json.dumps({"query": "q", "passages": ["p", "r"]}))
    assert [tuple(r) for r in readers.audit_batches(spark, str(batch)).collect()] == [("q", 0, "p"), ("q", 1, "r")]


def test_corpora(spark):
    docs = readers.documents(spark, [{"source_id": f"d{i}", "text": "a recipe for soup" if i % 3 == 0 else "stock market news"} for i in range(30)])
    corpus = corpora.TableCorpus(docs)
    assert {r.text for r in corpus.search("recipe", 5).collect()} == {"a recipe for soup"}
    assert {r.text for r in corpus.search("recipe unheard", 5).collect()} == {"a recipe for soup"}  # any word will do
    assert corpus.search("absent", 3).count() == 3
    assert corpus.sample("topic_diverse", 4).count() <= 4 and corpus.sample("uniform", 5).count() == 5
    with pytest.raises(ValueError):
        corpus.sample("odd", 1)
    with pytest.raises(ValueError):
        readers.documents(spark, spark.range(1))
    assert readers.benchmark(spark).count() == 5


def test_remote_corpus(spark):
    def fetch(query, offset, limit):
        return [(f"r{i}", f"{query}", None, None) for i in range(offset, min(offset + limit, 12))]

    corpus = corpora.RemoteCorpus(spark, "some_store", fetch, total=20, page=5)
    assert corpus.search("hello", 7).count() == 7
    assert corpus.sample("uniform", 6).count() == 6


class Client:
    """Stands for the clients of several stores: twelve documents, every third with a date."""

    def __init__(self):
        self.all = [{"text": f"<hi>word{i}</hi><sep/>x" if i else "", "uri": f"u{i}", "source_date": "2020-01-02" if i % 3 == 0 else "soon"} for i in range(12)]

    def search(self, index, body):
        assert index == "i" and ("match" in body["query"]) != ("function_score" in body["query"])
        return {"hits": {"hits": [{"_id": i, "_source": self.all[i]} for i in range(12)][body["from"] : body["from"] + body["size"]]}}

    def query_points(self, collection_name, query, limit, offset, with_payload):
        assert len(query) == 4 and with_payload
        return SimpleNamespace(points=[SimpleNamespace(id=i, payload=self.all[i]) for i in range(12)][offset : offset + limit])

    def query(self, vector=None, top_k=None, include_metadata=None, body=None):
        if body:
            return SimpleNamespace(hits=[{"id": f"doc::{i}", "fields": self.all[i]} for i in range(12)][body["offset"] : body["offset"] + body["hits"]])
        return {"matches": [{"id": str(i), "metadata": self.all[i]} for i in range(12)][:top_k]}


def test_fetches_of_stores(spark):
    made = {
        "elasticsearch": stores.elasticsearch(Client, "i"), "qdrant": stores.qdrant(Client, "c", 4), "vespa": stores.vespa(Client, "docs"),
        "pinecone": stores.pinecone(Client, 4, lambda text: [len(text), 0.0, 0.0, 1.0]),
    }
    for name, fetch in made.items():
        rows = fetch("word", 0, 5) + fetch(None, 5, 20)
        assert [r[2] for r in rows] == [f"u{i}" for i in range(1, 12)], name  # the one without a text is no document
        assert rows[2][3] == datetime(2020, 1, 2, tzinfo=UTC) and rows[0][3] is None
    assert made["vespa"]("q", 1, 1)[0][:2] == ("doc::1", "word1 x")
    corpus = corpora.RemoteCorpus(spark, "vespa_like", made["vespa"], total=12, page=5)
    assert corpus.search("word", 12).count() == 11
    meta = SimpleNamespace(id="a", content="x", meta={"uri": "u"})
    assert [tuple(r)[:3] for r in stores.documents_held(spark, SimpleNamespace(filter_documents=lambda: [meta])).collect()] == [("a", "x", "u")]
    node = SimpleNamespace(text="y", metadata={})
    assert [tuple(r)[:2] for r in stores.documents_held(spark, SimpleNamespace(docstore=SimpleNamespace(docs={"n": node}))).collect()] == [("n", "y")]


def test_logs_and_caches(spark, tmp_path):
    for i in range(2):
        catalog.append_log(spark.createDataFrame([(i, f"r{i}")], "n int, rationale string"), str(tmp_path / "log"))
    assert sorted(r.n for r in spark.read.json(str(tmp_path / "log")).collect()) == [0, 1]
    cache = spark.createDataFrame([(str(i), i) for i in range(20)], "cache_key string, last_used int")
    assert sorted(r.last_used for r in catalog.trimmed_cache(cache, 3).collect()) == [17, 18, 19]
    docs = spark.createDataFrame([("a", "Ann Lee became CEO of Acme", None), ("b", "Ann Lee became CEO of Acme", None), ("c", "Bo Kim became CEO of Bolt", None)], "source_id string, text string, source_date timestamp")
    first, fresh = cached_extract(docs.where("source_id <> 'c'"), None, "trigger")
    assert first.count() == 2 and fresh.count() == 1
    again, more = cached_extract(docs, fresh, "trigger", trigger_extractor)
    assert sorted((r.source_id, r.subject) for r in again.collect()) == [("a", "Acme"), ("b", "Acme"), ("c", "Bolt")] and more.count() == 1
    other, _ = cached_extract(docs, fresh, "trigger", lambda text: [("none", "p", "none at all", text, 1.0)])
    assert sorted({r.subject for r in other.collect()}) == ["Acme", "none"]  # what is cached is not extracted again


FACT = "id string, subject string, predicate string, object string, scope string, validity_start timestamp, validity_end timestamp, status string, evidence int, ingest_seq long"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"f{i}", f"S{i % 3}", "parentCompany", f"object {'abcdefghij'[i % 10] * 6}", "global", datetime(2000 + (i * 7) % 20, 1, 1), None, "active", 1 + i % 3, i) for i in range(30)]
    for part in range(3):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], FACT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FACT).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    out = stream_conflicts(stream, Vocabulary.default()).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(upsert_sink(str(tmp_path / "out"))).trigger(availableNow=True).start()
    out.awaitTermination()
    last = max(int(p.name[1:]) for p in (tmp_path / "out").iterdir())
    got = {(r.id, r.status, r.validity_end) for r in spark.read.parquet(str(tmp_path / "out" / f"v{last}")).collect()}
    want = {(r.id, r.status, r.validity_end) for r in resolve_conflicts(spark.createDataFrame(rows, FACT), Vocabulary.default()).collect()}
    assert got == want


def test_event_windows(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 1, 0, m), float(m)) for m in (1, 59)] + [(datetime(2024, 1, 1, 1, 0), 5.0)], "ts timestamp, value double")
    assert sorted((r.n, r.total) for r in event_windows(rows).collect()) == [(1, 5.0), (2, 60.0)]
    assert event_windows(rows, slide="30 minutes").count() > 2
    assert rows.select(F.lit(1)).count() == 3
