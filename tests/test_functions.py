"""Scalar functions, intervals, vocabulary, hashes and time cues."""

import hashlib
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from chronofact.functions import intervals, texts
from chronofact.functions.extraction import extract, infer_validity, parse_date, scan, triples
from chronofact.functions.vocabulary import Predicate, Vocabulary, canonicalize
from chronofact.model import FACTS, fact_id, valid_facts


def value(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in row.items())).select(column.alias("v")).first().v


def test_vocabulary(spark):
    v = Vocabulary.default()
    kinds = [p.cardinality for p in v.predicates.values()]
    assert (len(kinds), kinds.count("functional"), kinds.count("multi_valued"), kinds.count("event_log")) == (64, 37, 19, 8)
    assert v.renaming() == v.renaming(strict=True) == ["corporateName", "formerlyKnownAs", "renamedTo"]
    assert [v.canonical(x) for x in ("CEO", "partOf", "language", "succeededBy", "nothing")] == ["chiefExecutiveOfficer", "partOf", "language", "succeededBy", "nothing"]
    assert v.cardinality("nothing") == "multi_valued" and v.cardinality("Says") == "event_log"
    more = v.merged([Predicate("ceo"), Predicate("priceOf"), Predicate("skipped")], {"ceo", "priceOf"})
    assert set(more.predicates) - set(v.predicates) == {"priceOf"}
    df = spark.createDataFrame([(" Google ", "CEO"), ("X", "odd thing")], "subject string, predicate string")
    assert sorted(map(tuple, canonicalize(df, v).collect())) == [("Google", "chiefExecutiveOfficer"), ("X", "odd thing")]


def test_vocabulary_from_yaml():
    pytest.importorskip("yaml")
    v = Vocabulary.from_yaml("predicates:\n  a: {functional: true, cardinality: event_log, aliases: [b]}\n  c: {functional: true}\n  d:\n")
    assert [v.cardinality(x) for x in "bcd"] == ["event_log", "functional", "multi_valued"]
    for bad in ("x: 1", "predicates: {a: [1]}", "predicates: {a: {cardinality: odd}}"):
        with pytest.raises(ValueError):
            Vocabulary.from_yaml(bad)


def test_fact_id(spark):
    df = spark.createDataFrame([("s", "p", "o", datetime(2020, 1, 2, 3, 4, 5), "global"), ("s", "p", "o", datetime(2020, 1, 2, 3, 4, 5, 60), "global")], "subject string, predicate string, object string, validity_start timestamp, scope string")
    want = [hashlib.sha256(f"s|p|o|2020-01-02T03:04:05{x}+00:00|global".encode()).hexdigest()[:16] for x in ("", ".000060")]
    assert sorted(r.i for r in df.select(fact_id().alias("i")).collect()) == sorted(want)


def test_valid_facts(spark):
    good = {"id": "1", "subject": "s", "predicate": "p", "object": "o", "text": "t", "scope": "global", "status": "active", "rank": "normal", "confidence": 0.5, "validity_start": datetime(2020, 1, 1)}
    bad = [{"subject": ""}, {"object": None}, {"status": "odd"}, {"confidence": 1.5}, {"validity_end": datetime(2019, 1, 1)}, {"scope": "x"}]
    rows = [good, *({**good, **b} for b in bad)]
    names = [c.split()[0] for c in FACTS.replace("array<struct<source_id:string,evidence_span:string,char_start:int,char_end:int,created_at:timestamp>>", "X").split(", ")]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], FACTS)
    assert valid_facts(df).count() == 1


@pytest.mark.parametrize("at,want", [("2011-04-01", ["Page"]), ("2030-01-01", ["Pichai"]), ("2000-01-01", [])])
def test_half_open(spark, at, want):
    df = spark.sql("SELECT * FROM VALUES ('Schmidt', TIMESTAMP '2001-01-01', TIMESTAMP '2011-04-01'), ('Page', TIMESTAMP '2011-04-01', TIMESTAMP '2015-10-01'), ('Pichai', TIMESTAMP '2015-10-01', NULL) AS t(o, validity_start, validity_end)")
    assert [r.o for r in df.where(intervals.contains(F.lit(at).cast("timestamp"))).collect()] == want


def test_texts(spark):
    c = F.col("x")
    cases = [
        (texts.alias_key(c), {"Space X Inc.": "spacex", "SpaceX": "spacex", "Acme Holdings Group LLC": "acme", "Inc.": "inc", "A-B Co.": "ab"}),
        (texts.entity_name(c), {"Twitter  Inc.": "Twitter", "Foo, LLC": "Foo", "Incorrect": "Incorrect"}),
        (texts.qa_normal(c), {"The  Larry-Page, a b!": "larrypage b", "An": ""}),
        (texts.keyword_query(c), {"Who was the CEO of Google in 2015?": "CEO Google", "the who": "the who", "Apple's boss as of last May": "Apple boss"}),
        (texts.camel_case(c), {"chief executive officer": "chiefExecutiveOfficer", "alreadyCamel": "alreadyCamel", "Head_of Things!": "headOfThings"}),
        (texts.natural_predicate(c), {"chiefExecutiveOfficer": "CEO", "boardMember": "board member"}),
        (texts.object_problem(c), {"a": "too_short", "$26.2B": "bare_numeric", "--/": "no_letters", "really?": "interrogative", "Page": None}),
        (texts.script_language(c), {"  hello": "en", "привет": "ru", "你好": "zh", "مرحبا": "ar", "": "unk", "☃": "unk"}),
        (texts.domain(c), {"https://A.com:8/x": "a.com:8", "nonsense": "unknown_domain"}),
        (texts.without_highlights(c), {"a <hi>b</hi><sep />c": "a b c"}),
        (texts.shortened(c), {"x" * 81: "x" * 79 + "…", "y" * 80: "y" * 80}),
        (texts.is_event_verb(c), {"Says": True, "acquired": False, "noting": True}),
        (texts.is_uncertain(c), {"It may be.": True, "Some sources say so": True, "Mayor": False}),
    ]
    for column, wanted in cases:
        for x, want in wanted.items():
            assert value(spark, column, x=x) == want, (x, want)
    assert value(spark, F.to_json(texts.claims(c)), x="One. Two!\nThree") == '["One.","Two!","Three"]'


def test_scores(spark):
    f1 = texts.token_f1(F.col("a"), F.col("b"))
    assert [round(value(spark, f1, a=a, b=b), 4) for a, b in (("x x y", "x y z"), ("", ""), ("the", "x"), ("p q", "q p"))] == [0.6667, 1.0, 0.0, 1.0]
    grams = texts.jaccard(texts.char_grams(F.col("a")), texts.char_grams(F.col("b")))
    assert [round(value(spark, grams, a=a, b=b), 4) for a, b in (("", ""), ("ab", "AB"), ("abcd", "abce"), ("", "abc"))] == [1.0, 1.0, 0.3333, 0.0]
    low, high = texts.wilson(F.col("k"), F.col("n"))
    assert value(spark, low, k=0, n=0) == value(spark, high, k=0, n=0) == 0.0
    assert round(value(spark, low, k=5, n=10), 2) == 23.66 and round(value(spark, high, k=5, n=10), 2) == 76.34


SOURCE = datetime(2022, 5, 1, tzinfo=UTC)


@pytest.mark.parametrize(
    "text,start,end,known,confidence",
    [
        ("led it from 2011 to 2015.", 2011, 2015, True, 1.0), ("in office 2009-2013", 2009, 2013, True, 1.0), ("until 2030.", 2022, 2030, True, 1.0), ("until 2015", 2014, 2015, True, 1.0),
        ("since March 2018, it was", 2018, None, True, 1.0), ("became chief in 2015", 2015, None, True, 1.0), ("Pichai in 2019", 2019, None, True, 1.0), ("the 2017 report", 2022, None, False, 0.75), ("nothing", 2022, None, False, 1.0),
    ],
)
def test_time_cues(text, start, end, known, confidence):
    s, e, k, c = infer_validity(text, SOURCE)
    assert (s.year, e and e.year, k, c) == (start, end, known, confidence)


def test_prior_and_dates():
    prior = (datetime(2001, 1, 1, tzinfo=UTC), None)
    assert infer_validity("nothing", SOURCE, prior)[0].year == 2001 and infer_validity("the 2017 report", SOURCE, prior)[3] == 0.75
    assert infer_validity("until 2024-02-29", datetime(2025, 1, 1, tzinfo=UTC))[0].day == 28
    assert [parse_date(x) and parse_date(x).date().isoformat() for x in ("2 March 2019", "March 2nd, 2019", "2019", "2019-03-02T10:00:00Z", "soon")] == ["2019-03-02", "2019-03-02", "2019-01-01", "2019-03-02", None]


def test_triggers():
    assert triples("Larry Page became CEO of Google in 2011.")[0][1:4] == ("Google in 2011.", "chiefExecutiveOfficer", "Larry Page")
    assert [(k, p, s, o) for k, p, s, o, *_ in scan("Twitter Inc. was renamed to X Corp. in 2023.")] == [("entity_rename", "renamedTo", "Twitter Inc.", "X Corp. in 2023.")]
    assert scan("Microsoft is headquartered in Redmond")[0][1:4] == ("headquarteredIn", "Microsoft", "Redmond")
    assert scan("The sky is blue.") == [] == scan("")
    assert len(scan("A was renamed to B merged into C")) == 1


def test_extract(spark):
    docs = spark.createDataFrame([("d1", "Sundar Pichai became CEO of Google, since 2015.", SOURCE), ("d2", None, None), ("d3", "Acme is headquartered in Redmond", None)], "source_id string, text string, source_date timestamp")
    rows = {r.source_id: r for r in extract(docs).collect()}
    assert set(rows) == {"d1", "d3"} and rows["d1"].validity_start.year == 2015 and rows["d1"].predicate == "chiefExecutiveOfficer"
    assert rows["d3"].validity_start is None and not rows["d3"].validity_known
    own = extract(docs, lambda text: [("s", "p", "o", text, 0.9)] if "Acme" in text else [])
    assert [(r.source_id, r.extraction_confidence) for r in own.collect()] == [("d3", 0.9)]
