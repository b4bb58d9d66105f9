"""The store from documents to answers, and its commands."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronofact import cli
from chronofact.functions.extraction import trigger_extractor
from chronofact.functions.vocabulary import Vocabulary
from chronofact.plans.store import FactStore, audit, scan_corpus
from chronofact.sources.corpora import TableCorpus

DOCS = [
    ("d1", "Larry Page became CEO of Google. That was since 2011.", datetime(2011, 4, 5)),
    ("d2", "Sundar Pichai became CEO of Google. That was since 2015.", datetime(2015, 10, 3)),
    ("d3", "Twitter Inc. was renamed to X Corp", datetime(2023, 4, 12)),
    ("d4", "Microsoft is headquartered in Redmond", datetime(2016, 6, 14)),
    ("d5", "Microsoft is headquartered in Seattle", datetime(2016, 6, 14)),
    ("d6", "The sky is blue.", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(s, t, None, d) for s, t, d in DOCS], "source_id string, text string, uri string, source_date timestamp")


@pytest.fixture(scope="module")
def store(spark, docs, tmp_path_factory):
    out = FactStore(spark, str(tmp_path_factory.mktemp("store")))
    assert out.ingest(docs)["added"] == 5
    return out


def test_ingest_again_adds_nothing(store, docs):
    assert store.ingest(docs.where("source_id = 'd3'"))["added"] == 0
    assert store.passages.count() == 6 and store.facts.count() == 5


def test_contested_headquarters(store):
    rows = {r.object: r.status for r in store.facts.where("predicate = 'headquarteredIn'").collect()}
    assert set(rows.values()) == {"contested"} and len(rows) == 2


def test_reads(spark, store):
    assert [r.object for r in store.renames("Twitter Inc.").collect()] == ["X Corp"]
    asked = spark.createDataFrame([(1, "Microsoft Redmond")], "query_id long, query string")
    assert [r.object for r in store.retrieve(asked, F.lit("2020-01-01").cast("timestamp"), "all").collect()] == ["Redmond"]
    ids = {r.object: r.id for r in store.facts.collect()}
    store.put_vectors(spark.createDataFrame([(ids["Seattle"], [0.0, 0.0]), (ids["Redmond"], [1.0, 0.0])], "id string, vector array<double>"))
    store.put_vectors(spark.createDataFrame([(ids["Seattle"], [2.0, 0.0])], "id string, vector array<double>"))
    near = spark.createDataFrame([(1, "no such word", [1.0, 0.0])], "query_id long, query string, vector array<double>")
    now = F.lit("2020-01-01").cast("timestamp")
    assert [(r.object, r.dense_rank) for r in store.retrieve(near, now, "all").orderBy("rank").collect()] == [("Seattle", 1), ("Redmond", 2)]
    store.delete_vectors(spark.createDataFrame([(ids["Seattle"],)], "id string"))
    assert [r.object for r in store.retrieve(near, now, "all").collect()] == ["Redmond"]
    store.delete_vectors(spark.createDataFrame([(ids["Redmond"],)], "id string"))
    block = store.answer_context(spark.createDataFrame([(1, "Where is Microsoft headquarters in 2020?"), (2, "hello")], "query_id long, query string"), F.current_timestamp())
    assert block.count() <= 1
    assert store.stats()["n_facts"] == 5


def test_audit_and_scan(docs):
    row = audit(docs, Vocabulary.default(), F.lit("2024-01-01").cast("timestamp")).first()
    assert row.n_facts == 5 and row.n_conflicts >= 1
    scan = scan_corpus(docs, Vocabulary.default()).first()
    assert (scan.n_docs, scan.n_rename, scan.n_depth) == (6, 1, 2) and scan.conflict > 0
    assert scan.depth == pytest.approx(100 / 3) and scan.depth_low < scan.depth < scan.depth_high
    assert scan.n_drift == 0 and any("Redmond \u2194 Seattle" in x for x in scan.conflict_examples) and len(scan.rename_examples) == 1


def test_scan_of_drift(spark):
    texts = ["Acme is headquartered in Berlin, as of 1999-05-01.", "Acme is headquartered in Madrid, in March 2014.", "Bolt is headquartered in Rome since 2001", "Bolt is headquartered in Oslo since 2001", "plain"]
    docs = spark.createDataFrame([(f"d{i}", t, None, None) for i, t in enumerate(texts)], "source_id string, text string, uri string, source_date timestamp")
    scan = scan_corpus(docs, Vocabulary.default(), by="none").first()
    assert (scan.n_clusters, scan.n_drift, scan.n_conflict, scan.n_depth, scan.verdict) == (2, 1, 2, 4, "high") and scan.drift_examples == ["Acme / headquarteredIn"]
    assert scan.drift == 50 and scan.conflict == 100 and scan.depth == 80 and scan.rename == 0
    assert scan_corpus(docs.limit(0), Vocabulary.default(), by="none").first().n_docs == 0


def test_arrival_order_decides(spark, tmp_path):
    rows = [("z", "Acme is headquartered in Berlin", datetime(2001, 1, 1)), ("a", "Acme is headquartered in Madrid", datetime(2002, 1, 1))]
    docs = spark.createDataFrame([(s, t, None, d) for s, t, d in rows], "source_id string, text string, uri string, source_date timestamp")
    found = FactStore(spark, str(tmp_path / "s")).candidates(docs).orderBy("ingest_seq").collect()
    assert [r.object for r in found] == ["Berlin", "Madrid"]


def test_types_turn_facts_round(spark, tmp_path, docs):
    tagger = lambda x: [(x, "PERSON")] if x in ("Larry Page", "Sundar Pichai") else [(x, "ORG")] if x == "Google" else []
    swapped = lambda text: [("Larry Page", "ceo", "Google", "x", 0.9)] if "Larry" in text else [("Sundar Pichai", "ceo", "Larry Page", "x", 0.9)] if "Sundar" in text else []
    rows = FactStore(spark, str(tmp_path / "s")).candidates(docs, swapped, tagger=tagger).collect()
    assert [(r.subject, r.predicate, r.object, r.subject_type) for r in rows] == [("Google", "chiefExecutiveOfficer", "Larry Page", "ORG")]


def test_answered_with_passages(spark, store):
    asked = spark.createDataFrame([(1, "Where is Microsoft headquartered in 2020?"), (2, "hello"), (3, "Who was CEO of Acme in 2019?"), (4, "nothing found")], "query_id long, query string")
    hits = spark.createDataFrame([(2, "p2", "some text", None, 2), (2, "p1", "better text", None, 1), (3, "p3", "Ann Lee became CEO of Acme in 2018.", datetime(2018, 5, 5), 1)], "query_id long, source_id string, text string, source_date timestamp, rank int")
    got = {r.query_id: (r.mode, r.context) for r in store.answered(asked, hits, F.current_timestamp()).collect()}
    assert got[2] == ("passages", "[p1] better text\n[p2] some text") and got[4] == (None, None)
    assert got[3][0] == "just_in_time" and "Ann Lee" in got[3][1]
    stale = {r.query_id: r.mode for r in store.answered(asked, hits, F.lit("2099-01-01").cast("timestamp"), fresh_days=30).collect()}
    assert "facts" not in stale.values()


def test_freshness_is_that_of_the_answers_key(spark, store):
    """A young fact about something else makes no answer fresh; a stale answer keeps its facts and gets new ones."""
    asked = spark.createDataFrame([(1, "Where is Microsoft headquartered in 2020?"), (2, "Who was CEO of Acme in 2019?")], "query_id long, query string")
    none = spark.createDataFrame([], "query_id long, source_id string, text string, source_date timestamp, rank int")
    soon = F.current_timestamp()
    late = F.lit("2099-01-01").cast("timestamp")
    pool = spark.createDataFrame([("w1", "Microsoft is headquartered in Paris.", datetime(2019, 1, 1)), ("w2", "Ann Lee became CEO of Acme in 2018.", datetime(2018, 5, 5)), *((f"n{i}", f"Plain words {i}", None) for i in range(6))], "source_id string, text string, source_date timestamp")
    modes = lambda at, **o: {r.query_id: (r.mode, r.context or "") for r in store.answered(asked, none, at, **o).collect()}
    assert modes(soon, fresh_days=30)[1][0] == "facts" and modes(late, fresh_days=30)[1][0] == "stale_facts"
    got = modes(late, fresh_days=30, fallback=TableCorpus(pool).hits)
    assert got[1][0] == "refreshed" and "Paris" in got[1][1] and "Redmond" in got[1][1]
    assert got[2][0] == "just_in_time" and "Ann Lee" in got[2][1]


def test_failing_texts_are_kept_apart(spark, tmp_path, docs):
    def fragile(text):
        if "Microsoft" in text:
            raise RuntimeError("no answer")
        return trigger_extractor(text)

    store = FactStore(spark, str(tmp_path / "s"))
    counts = store.ingest(docs, fragile)
    assert counts["failed"] == store.failures.count() > 0 and counts["added"] > 0
    assert {r.error for r in store.failures.collect()} == {"RuntimeError: no answer"}
    assert store.facts.where("subject = 'Microsoft'").count() == 0
    assert store.ingest(docs)["failed"] == 0 and store.failures.count() == 0 and store.facts.where("subject = 'Microsoft'").count() > 0


def test_passages_are_extracted_once(spark, tmp_path):
    """The second batch calls the extractor for new texts only; the cache keeps the texts used last."""
    log = tmp_path / "calls"

    def counting(text):
        with open(log, "a") as f:
            f.write(text + "\n")
        if "fails" in text:
            raise RuntimeError
        return trigger_extractor(text)

    frame = lambda rows: spark.createDataFrame(rows, "source_id string, text string, source_date timestamp")
    store, day = FactStore(spark, str(tmp_path / "s")), datetime(2018, 5, 5)
    one = [("a", "Ann Lee became CEO of Acme in 2018.", day), ("b", "Ann Lee became CEO of Acme in 2018.", day), ("c", "plain", None), ("d", "fails", None), ("e", None, None)]
    first = sorted(r.source_id for r in store.extracted_once(frame(one), counting, "x").collect())
    again = sorted(r.source_id for r in store.extracted_once(frame([*one, ("f", "Bob Ray became CEO of Bolt in 2019.", day)]), counting, "x", 2).collect())
    assert first == ["a", "b"] and again == ["a", "b", "f"]
    assert sorted(log.read_text().splitlines()) == sorted(["Ann Lee became CEO of Acme in 2018.", "plain", "fails", "fails", "Bob Ray became CEO of Bolt in 2019."])
    assert store._table("extractions").select("cache_key").distinct().count() == 2
    asked = spark.createDataFrame([(1, "Who was CEO of Acme in 2019?")], "query_id long, query string")
    hits = spark.createDataFrame([(1, "a", one[0][1], day, 1)], "query_id long, source_id string, text string, source_date timestamp, rank int")
    assert store.answered(asked, hits, F.current_timestamp(), extractor=trigger_extractor, extractor_id="y").first().mode == "just_in_time"


def test_encoder_and_judge_in_ingest(spark, tmp_path):
    texts = [("a", "Acme is headquartered in Berlin", datetime(2001, 1, 1)), ("b", "Acme is headquartered in Berlin City", datetime(2002, 1, 1)), ("c", "Acme is headquartered in Madrid", datetime(2003, 1, 1))]
    docs = spark.createDataFrame([(s, t, None, d) for s, t, d in texts], "source_id string, text string, uri string, source_date timestamp")
    encoder = lambda objects: [[1.0, 0.0] if "Berlin" in o else [0.0, 1.0] for o in objects]
    store = FactStore(spark, str(tmp_path / "s"))
    store.ingest(docs, encoder=encoder, judge=lambda new, old: "new")
    assert {(r.object, r.status) for r in store.facts.collect()} == {("Berlin", "deprecated"), ("Madrid", "active")}


def test_versions(spark, tmp_path, docs):
    store = FactStore(spark, str(tmp_path / "s"))
    for i in range(1, 5):
        store.put_vectors(spark.createDataFrame([(f"v{i}", [1.0])], "id string, vector array<double>"))
    (tmp_path / "s" / "vectors" / "v5").mkdir()  # a change that broke off
    assert store.vectors.count() == 4
    store.put_vectors(spark.createDataFrame([("v6", [1.0])], "id string, vector array<double>"))
    assert store._versions("vectors") == [1, 2, 3, 4, 6] and store.vectors.count() == 5
    assert store.vacuum() == 3 and store._versions("vectors", complete=False) == [4, 5, 6]
    assert store.vacuum(1) == 2 and store._versions("vectors", complete=False) == [6] and store.vectors.count() == 5


def test_commands(spark, tmp_path, capsys):
    source = tmp_path / "docs.jsonl"
    source.write_text("\n".join(json.dumps({"source_id": s, "text": t, "source_date": d and d.isoformat()}) for s, t, d in DOCS))
    run = lambda *args: json.loads(cli.main(["--store", str(tmp_path / "s"), *args, "--json"], spark))
    report = run("auto", str(source))[0]
    assert json.loads(report["ingest"])["added"] == 5 and json.loads(report["second"]) is None
    assert run("inspect")[0]["n_facts"] == 5 and run("contested")[0]["n"] == 2
    assert run("renames", "Twitter Inc.")[0]["object"] == "X Corp"
    assert run("query", "Microsoft Seattle", "--at", "2020-01-01", "--view", "all")[0]["object"] == "Seattle"
    assert run("estimate-cost", str(source))[0]["n_sampled"] == 6
    disputed = run("contested")[0]
    winner = FactStore(spark, str(tmp_path / "s")).facts.where("status = 'contested' and object = 'Seattle'").first()
    assert run("resolve", winner.subject, winner.predicate, winner.id) == [{"active": 1, "deprecated": 1}] and disputed["n"] == 2
    assert run("failures") == [] and run("query", "Microsoft Seattle", "--at", "2020-01-01")[0]["object"] == "Seattle"
    assert {r["kind"] for r in run("seeds", str(source))} and isinstance(run("schema", str(source)), list)
    assert "| n_facts |" in cli.main(["--store", str(tmp_path / "s"), "inspect"], spark)
