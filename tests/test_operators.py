"""Chains, conflicts, catalog, search, sampling, governance and evaluation on small hand-made facts."""

import itertools
import random
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronofact.functions.vocabulary import Vocabulary
from chronofact.operators import catalog, chains, conflicts, evaluation, governance, reports, sampling, search, views

CHAIN = [
    ("Google", "chiefExecutiveOfficer", "Schmidt", 2001, 2011), ("Google", "chiefExecutiveOfficer", "Page", 2011, 2015), ("Google", "chiefExecutiveOfficer", "Pichai", 2015, None),
    ("Twitter Inc", "renamedTo", "X Corp", 2023, None), ("Twitter Inc", "chiefExecutiveOfficer", "Dorsey", 2006, 2015), ("Twitter Inc", "chiefExecutiveOfficer", "Agrawal", 2021, 2022),
    ("X Corp", "chiefExecutiveOfficer", "Musk", 2022, 2023), ("X Corp", "chiefExecutiveOfficer", "Yaccarino", 2023, None), ("Google", "parentCompany", "Alphabet", 2015, None),
    ("Alphabet", "chiefExecutiveOfficer", "Page", 2015, 2019), ("Alphabet", "chiefExecutiveOfficer", "Pichai", 2019, None),
]
SCHEMA = "id string, subject string, predicate string, object string, scope string, validity_start timestamp, validity_end timestamp, status string, text string"


def day(year):
    return year and datetime(year, 1, 1)


def frame(spark, rows, status="active"):
    return spark.createDataFrame([(f"f{i:02}", s, p, o, "global", day(a), day(b), status, f"{s} {p} {o}") for i, (s, p, o, a, b) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def facts(spark):
    return frame(spark, CHAIN)


def at(year):
    return F.lit(day(year))


def starts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "start string")


def test_succession(facts):
    rows = chains.succession(facts).where("subject = 'Google' and predicate = 'chiefExecutiveOfficer'").orderBy("position").collect()
    assert [(r.object, r.gap_seconds, r.truncated) for r in rows] == [("Schmidt", None, False), ("Page", 0, False), ("Pichai", 0, False)]
    assert chains.succession(facts, at(2013)).where("subject = 'Google' and predicate = 'chiefExecutiveOfficer'").count() == 2
    short = chains.succession(facts, max_depth=2).where("subject = 'Google' and predicate = 'chiefExecutiveOfficer'").collect()
    assert len(short) == 2 and all(r.truncated for r in short)
    gap = chains.succession(facts).where("object = 'Agrawal'").first().gap_seconds
    assert gap == (day(2021) - day(2015)).total_seconds()
    assert [r.object for r in chains.chain_at(chains.succession(facts), at(2012)).where("subject = 'Google'").collect()] == ["Page"]


def test_rename(spark, facts):
    forward = chains.rename_walk(facts, starts(spark, "Twitter Inc", "Google"), ["renamedTo"]).collect()
    assert [(r.start, r.object, r.truncated) for r in forward] == [("Twitter Inc", "X Corp", False)]
    back = chains.rename_walk(facts, starts(spark, "X Corp"), ["renamedTo"], direction="backward").collect()
    assert [r.subject for r in back] == ["Twitter Inc"]
    assert chains.rename_walk(facts, starts(spark, "X Corp"), ["renamedTo"], direction="both").count() == 1
    assert chains.rename_walk(facts, starts(spark, "Twitter Inc"), ["renamedTo"], at(2020)).count() == 0


def test_rename_circle_truncation_and_ambiguity(spark):
    circle = frame(spark, [("A", "renamedTo", "B", 2001, None), ("B", "renamedTo", "C", 2002, None), ("C", "renamedTo", "A", 2003, None)])
    walk = chains.rename_walk(circle, starts(spark, "A"), ["renamedTo"]).orderBy("step").collect()
    assert [(r.object, r.closes) for r in walk] == [("B", False), ("C", False), ("A", True)]
    assert all(r.truncated for r in chains.rename_walk(circle, starts(spark, "A"), ["renamedTo"], max_depth=2).collect())
    fork = frame(spark, [("A", "renamedTo", "B", 2001, None), ("A", "renamedTo", "C", 2002, None)])
    both = chains.rename_walk(fork.union(frame(spark, [("P", "renamedTo", "Q", 2001, None)])), starts(spark, "A", "P"), ["renamedTo"])
    assert sorted((r.start, r.object, r.ambiguous) for r in both.collect()) == [("A", "B", True), ("P", "Q", False)]
    with pytest.raises(chains.AmbiguousChain):
        chains.unambiguous(both)
    last = lambda ways: max(w["id"] for w in ways)
    assert [(r.object, r.ambiguous) for r in chains.rename_walk(fork, starts(spark, "A"), ["renamedTo"], resolver=last).collect()] == [("C", False)]
    assert [r.ambiguous for r in chains.rename_walk(fork, starts(spark, "A"), ["renamedTo"], resolver=lambda ways: None).collect()] == [True]
    assert [r.object for r in chains.rename_walk(fork, starts(spark, "A"), ["renamedTo"], strict=False).collect()] == ["B"]


def test_join_chain(spark, facts):
    rows = chains.join_chain(facts, starts(spark, "Google"), ["parentCompany", "chiefExecutiveOfficer"], at(2020)).collect()
    assert [tuple(r) for r in rows] == [("Google", "Alphabet", "Pichai", False)]
    hops = ["parentCompany", "chiefExecutiveOfficer"]
    open_ = chains.join_chain(facts, starts(spark, "Google", "X Corp"), hops)
    assert [tuple(r) for r in open_.collect()] == [("Google", "Alphabet", None, True)]
    assert chains.join_chain(facts, starts(spark, "Google"), hops, strict=False).count() == 0
    with pytest.raises(chains.AmbiguousChain):
        chains.unambiguous(open_)
    chosen = chains.join_chain(facts, starts(spark, "Google"), hops, resolver=lambda ways: ways[-1]["id"])
    assert [tuple(r) for r in chosen.collect()] == [("Google", "Alphabet", "Pichai", False)]
    mixed = facts.union(facts.where("subject = 'Alphabet'").withColumn("scope", F.lit("user")).withColumn("object", F.lit("Nobody")))
    assert [tuple(r) for r in chains.join_chain(mixed, starts(spark, "Google"), hops, at(2020)).collect()] == [("Google", "Alphabet", "Pichai", False)]
    assert chains.join_chain(mixed, starts(spark, "Google").withColumn("scope", F.lit("user")), hops, at(2020)).count() == 0
    with pytest.raises(ValueError):
        chains.join_chain(facts, starts(spark, "Google"), ["a"] * 5)


def entry(name, year, evidence, end=None, obj=None):
    return conflicts.Entry(name, obj or f"object {name}{name}{name}", day(year), day(end), evidence)


def statuses(*entries):
    conflicts.fold(list(entries), True, dedup=None)
    return {e.id: e.status for e in entries}


def test_order_matters_for_three():
    make = lambda: (entry("A", 2001, 2), entry("B", 2003, 1), entry("C", 2005, 2))
    a, b, c = make()
    assert statuses(a, b, c) == {"A": "contested", "B": "deprecated", "C": "contested"}
    a, b, c = make()
    assert statuses(c, b, a) == {"A": "contested", "B": "contested", "C": "contested"}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(2000, 2020), st.integers(1, 4)), min_size=2, max_size=2, unique_by=lambda x: x[0]))
def test_pairs_commute(pair):
    one = statuses(*(entry(n, *x) for n, x in zip("AB", pair, strict=True)))
    two = statuses(*(entry(n, *x) for n, x in reversed(list(zip("AB", pair, strict=True)))))
    assert one == two


def test_branches_and_ends():
    old, new = entry("A", 2001, 1), entry("B", 2005, 2)
    assert statuses(old, new) == {"A": "deprecated", "B": "active"} and old.end == day(2005)
    assert statuses(entry("A", 2001, 2), entry("B", 2001, 1)) == {"A": "contested", "B": "contested"}
    assert statuses(entry("A", 2001, 1, 2003), entry("B", 2003, 1)) == {"A": "active", "B": "active"}
    many = [entry("A", 2001, 1), entry("B", 2002, 1)]
    conflicts.fold(many, False)
    assert [e.status for e in many] == ["active", "active"]


def test_duplicates_and_judge():
    twice = [entry("A", 2001, 1, obj="Larry Page"), entry("B", 2009, 1, obj="larry page")]
    conflicts.fold(twice, True, merge_evidence=True)
    assert twice[1].duplicate_of == "A" and twice[0].evidence == 2
    pair = [entry("A", 2001, 1), entry("B", 2005, 1)]
    conflicts.fold(pair, True, dedup=None, judge=lambda new, old: "new")
    assert [(e.status, e.end) for e in pair] == [("deprecated", day(2005)), ("active", None)]
    pair = [entry("A", 2001, 1), entry("B", 2005, 1)]
    conflicts.fold(pair, True, dedup=None, judge=lambda new, old: "who knows")
    assert {e.status for e in pair} == {"contested"}


def test_resolve_conflicts_frame(spark, facts):
    df = facts.withColumns({"evidence": F.when(F.col("object") == "Pichai", 2).otherwise(1), "ingest_seq": F.col("id")})
    df = df.withColumn("validity_end", F.when(F.col("object") == "Page", None).otherwise(F.col("validity_end")))
    got = {(r.subject, r.object): (r.status, r.validity_end) for r in conflicts.resolve_conflicts(df, Vocabulary.default()).collect()}
    assert got["Google", "Page"] == ("deprecated", day(2015)) and got["Google", "Pichai"] == ("active", None) and got["Google", "Schmidt"][0] == "active"


def test_pairs_match_fold_for_two(spark):
    for (a, na), (b, nb) in itertools.product(itertools.product((2001, 2005), (1, 2)), repeat=2):
        df = frame(spark, [("S", "parentCompany", "aaaa", a, None), ("S", "parentCompany", "zzzz", b, None)]).withColumn("evidence", F.when(F.col("id") == "f00", na).otherwise(nb))
        branch = conflicts.conflict_pairs(df).where("new_id = 'f01'").first().branch
        want = statuses(entry("f00", a, na), entry("f01", b, nb))
        assert {"contested": ("contested", "contested"), "deprecate_old": ("deprecated", "active"), "deprecate_new": ("active", "deprecated")}[branch] == (want["f00"], want["f01"])


def test_catalog(spark, facts):
    marked = facts.withColumn("rank", F.lit("normal"))
    assert catalog.mark_preferred(marked, "f01").where("rank = 'preferred' and status = 'active'").count() == 1
    assert catalog.suppress(marked, "f01").where("rank = 'deprecated' and status = 'deprecated'").count() == 1
    for change in (catalog.mark_preferred, catalog.suppress):
        with pytest.raises(KeyError):
            change(marked, "none")
    decisions = spark.createDataFrame([("Google", "chiefExecutiveOfficer", "global", "winner", "f02"), ("X Corp", "chiefExecutiveOfficer", "global", "all_wrong", None), ("Alphabet", "chiefExecutiveOfficer", "global", "skip", None)], "subject string, predicate string, scope string, action string, winner_id string")
    got = {r.id: (r.status, r.rank) for r in catalog.resolve(marked, decisions).collect()}
    assert got["f02"] == ("active", "preferred") and got["f00"] == got["f06"] == ("deprecated", "deprecated") and got["f09"] == ("active", "normal")
    table, new = (spark.createDataFrame(x, "k int, v int, seq int") for x in ([(1, 1, 0)], [(1, 2, 1), (1, 3, 2), (2, 4, 1)]))
    assert sorted(tuple(r)[:2] for r in catalog.upsert(table, new, ["k"], "seq").collect()) == [(1, 3), (2, 4)]
    assert sorted(tuple(r)[:2] for r in catalog.write_policy(table, new, ["k"], "SKIP", "seq").collect()) == [(1, 1), (2, 4)]
    with pytest.raises(ValueError):
        catalog.write_policy(table, new, ["k"], "FAIL", "seq")


def test_views(spark, facts):
    assert views.as_of(facts, at(2012), "all", {"subject": "Google"}).count() == 1
    with pytest.raises(ValueError):
        views.as_of(facts, at(2012), filters={"text": "x"})
    triples = spark.createDataFrame([("Page", "ceo", "Google", "PERSON", "ORG"), ("Rome", "ceo", "Oslo", "GPE", "GPE"), ("a", "x", "b", "ORG", "ORG")], "subject string, predicate string, object string, subject_type string, object_type string")
    checked = views.direction(triples, Vocabulary.default().dimension(spark))
    assert sorted((r.subject, r.direction) for r in checked.collect()) == [("Page", "flip"), ("Rome", "reject"), ("a", "ok")]
    assert sorted(r.subject for r in views.flipped(checked).collect()) == ["Google", "a"]
    with pytest.raises(ValueError):
        views.gate(facts, 0.5, 0.6)


def test_fusion(spark):
    rows = [("s", 0, "a", 1), ("s", 0, "b", 2), ("s", 1, "b", 1), ("s", 1, "a", 2), ("s", 1, "d", 3)]
    fused = search.rrf(spark.createDataFrame(rows, "query_id string, list int, id string, rank int")).orderBy("rank").collect()
    assert [r.id for r in fused] == ["a", "b", "d"] and abs(fused[0].score - (1 / 61 + 1 / 62)) < 1e-12
    one = spark.createDataFrame([("s", "a", 0.5), ("s", "b", 0.5)], "query_id string, id string, score double")
    two = spark.createDataFrame([("s", "b", 2.0), ("s", "c", 1.0)], "query_id string, id string, score double")
    assert {r.id: round(r.score, 6) for r in search.weighted_minmax(one, two).collect()} == {"a": 0.4, "b": 0.9, "c": 0.0}


def test_sampling(spark):
    docs = spark.createDataFrame([(f"d{i}", "x", "k" if i % 10 else "rare") for i in range(100)], "source_id string, text string, stratum string")
    got = sampling.stratified(docs, 20).collect()
    assert len(got) == 20 and sum(r.stratum == "rare" for r in got) == 10
    assert sampling.stratified(docs, 0).count() == 0 and sampling.stratified(docs, 500).count() == 100
    assert sampling.reservoir(docs, 7).count() == 7
    with pytest.raises(ValueError):
        sampling.strata(docs, "odd")
    base = " ".join(f"w{i}" for i in range(200))
    rows = spark.createDataFrame([(1, base), (2, base), (3, base + " extra"), (4, "other words here"), (5, None)], "id long, text string").withColumn("simhash", sampling.simhash("text"))
    hashes = {r.id: r.simhash for r in rows.collect()}
    assert hashes[5] == 0 and hashes[1] == hashes[2]
    near = {(r.left_id, r.right_id) for r in sampling.near_duplicate_pairs(rows).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(hashes), 2) if bin((hashes[a] ^ hashes[b]) & (2**64 - 1)).count("1") <= 3}
    assert {p for p in want if p[0] == 1 or p == (1, 2)} <= near | {(2, 3)} and all(p in want for p in near)


def test_near_duplicates_one_after_another(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(8)]
    data = [(i, rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(12), rng.choice([0, 1, 2, 2, 3])))) for i in range(120)]
    kept = []
    for i, h in data:
        if all(bin(h ^ data[k][1]).count("1") > 3 for k in kept):
            kept.append(i)
    rows = [(i, h - 2**64 if h >= 2**63 else h) for i, h in data] + [(None, 5), (900, None)]
    df = spark.createDataFrame(rows, "id long, simhash long").repartition(3)
    assert sorted(r.id for r in sampling.without_near_duplicates(df).collect()) == kept
    assert sampling.without_near_duplicates(df.limit(0)).count() == 0


def test_governance(spark):
    passages = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("d", "w")], "source_id string, text string")
    evidence = spark.createDataFrame([("a", "deprecated"), ("b", "deprecated"), ("b", "contested"), ("c", "active")], "source_id string, status string")
    assert sorted(tuple(r) for r in governance.govern(passages, evidence).collect()) == [("b", "[DISPUTED] y"), ("c", "z"), ("d", "w")]
    questions = spark.createDataFrame([("Who was CEO of Google in 2015?",), ("before 2010 the chief executive officer",), ("ceoing around",), ("As of now",), ("since 2001",)], "query string")
    rows = [(r.query_time and r.query_time.year, r.keyword, r.use_facts) for r in governance.route(questions, Vocabulary.default(), at(2024)).collect()]
    assert rows == [(2015, "ceo", True), (2009, "chief executive officer", True), (None, None, False), (2024, None, True), (2024, None, True)]


def test_evaluation(spark, facts):
    one = facts.where("subject = 'Google' and predicate = 'chiefExecutiveOfficer'").withColumn("row", F.lit(1))
    for answer, want in (("First Schmidt, then Page, then Pichai.", 1.0), ("Page, Schmidt, Pichai", 0.0), ("Schmidt", 1.0), ("Schmidt then Pichai", 0.0)):
        rows = spark.createDataFrame([(1, answer)], "row int, answer string")
        assert evaluation.chain_completeness(rows, one, "row", "answer").first().completeness == want, answer
    rows = spark.createDataFrame([(1, "Schmidt ran Google. Nothing matches zzzz.", day(2005)), (2, "", day(2005))], "row int, answer string, at timestamp")
    scores = {r.row: r.faithfulness for r in evaluation.faithfulness(rows, one, "row", "answer", "at").collect()}
    assert scores == {1: 0.5, 2: 1.0}
    never = lambda premises, claimed: ["zzzz" in c and "schmidt" in p for p, c in zip(premises, claimed, strict=True)]
    assert {r.row: r.faithfulness for r in evaluation.faithfulness(rows, one, "row", "answer", "at", never).collect()} == {1: 0.5, 2: 1.0}
    asked = spark.createDataFrame([("q", "c"), ("r", None)], "query string, context string")
    both = asked.select(evaluation.answered_by(lambda qs, cs: [q + c for q, c in zip(qs, cs, strict=True)], F.col("query"), F.col("context")).alias("a"))
    assert [r.a for r in both.collect()] == ["qc", "r"]


def test_reports(spark, facts):
    extracted = spark.createDataFrame([("S", "announces", "x"), ("S", "announced", "y"), ("T", "announced", "z"), ("A", "price of", "1"), ("B", "price of", "2"), ("B", "price of", "2"), ("C", "rare", "1")], "subject string, predicate string, object string")
    got = {r["name"]: (r.frequency, r.cardinality, r.aliases) for r in reports.discover_predicates(extracted, Vocabulary.default().dimension(spark)).collect()}
    assert got == {"announced": (3, "event_log", "announces"), "priceOf": (3, "functional", "price of")}
    cost = reports.ingest_cost(spark.createDataFrame([("x" * 400,)], "text string"), n_total=10, hit_rate=0.5).first()
    assert (cost.total_in, cost.total_out) == (1000, 400) and abs(cost.gross_usd - (0.00015 + 0.4 * 0.0006)) < 1e-9 and abs(cost.net_usd - cost.gross_usd / 2) < 1e-12
    entities = spark.createDataFrame([("Acme", 4, 1)], "entity string, n long, rank int")
    seeds = reports.seed_queries(entities, spark.createDataFrame([("chiefExecutiveOfficer",)], "predicate string"), spark.createDataFrame([("Acme", 4)], "entity string, n long"), spark.createDataFrame([("Acme", "chiefExecutiveOfficer", 4)], "entity string, predicate string, n long"))
    assert {r.query: r.kind for r in seeds.collect()} == {"Acme CEO": "functional", "Acme renamed": "rename", "Acme formerly known as": "rename", "Acme": "entity_coverage"}


def test_similar_names(spark):
    names = ["International Business Machines", "Internatonal Business Machines", "Business", "International Business Machine", "Deutsche Bank", "Deutsche Banks", "a", "a b", "Zed"]
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "mention string, ingest_seq long")
    pairs = {(r.a, r.b): r.cosine for r in conflicts.similar_names(rows.select(F.col("mention").alias("name")), 0.7).collect()}

    def grams(name):
        out = []
        for w in name.lower().split():
            w = f" {w} "
            out += [w[i : i + n] for n in (3, 4) for i in range(max(1, len(w) - n + 1))] if len(w) > 3 else [w]
        return out

    count = {n: {g: grams(n).count(g) for g in grams(n)} for n in names}
    idf = lambda g: np.log((1 + len(names)) / (1 + sum(g in c for c in count.values()))) + 1
    vector = {n: {g: k * idf(g) for g, k in c.items()} for n, c in count.items()}
    norm = {n: np.sqrt(sum(w * w for w in v.values())) for n, v in vector.items()}
    want = {(a, b): sum(w * vector[b].get(g, 0) for g, w in vector[a].items()) / norm[a] / norm[b] for a in names for b in names if a != b and min(len(a), len(b)) >= 0.5 * max(len(a), len(b))}
    want = {k: v for k, v in want.items() if v >= 0.7}
    assert len(want) >= 4 and set(pairs) == set(want) and all(abs(pairs[k] - v) < 1e-9 for k, v in want.items())
    got = {r.mention: (r.canonical, r.stage) for r in conflicts.resolve_aliases(rows, similar=0.7).collect()}
    assert got["International Business Machine"] == (names[0], "string_sim") and got["Deutsche Banks"] == ("Deutsche Bank", "string_sim")
    assert got["Zed"] == ("Zed", "new") and conflicts.resolve_aliases(rows.limit(0), similar=0.7).count() == 0


def test_cosine_duplicates(spark, facts):
    df = facts.where("subject = 'Google' and predicate = 'chiefExecutiveOfficer'").withColumns({"evidence": F.lit(1), "ingest_seq": F.col("id")})
    encoder = lambda texts: [[1.0, 0.0] if t in ("Page", "Pichai") else [0.0, 1.0] for t in texts]
    assert sorted(r.object for r in conflicts.resolve_conflicts(df, Vocabulary.default(), encoder=encoder).collect()) == ["Page", "Schmidt"]


def test_sample_without_near_duplicates(spark):
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    texts = [words(0)] * 60 + [words(0) + " more"] * 10 + [words(i) for i in range(1, 31)]
    docs = spark.createDataFrame([(f"d{i}", t, "s") for i, t in enumerate(texts)], "source_id string, text string, stratum string")
    got = sampling.stratified(docs, 25, distance=3).collect()
    hashes = [sampling.simhash_of(r.text) & (2**64 - 1) for r in got]
    assert len(got) == 25 and all(bin(a ^ b).count("1") > 3 for a, b in itertools.combinations(hashes, 2))
    every = sampling.stratified(docs, 90, distance=3).collect()
    assert 30 <= len(every) <= 32 and {r.text for r in every} >= {words(i) for i in range(1, 31)}


def test_dense_search(spark):
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(300, 5)), rng.normal(size=(7, 5))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "id long, vector array<double>").repartition(4)
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "query_id string, vector array<double>")
    scores = {"dot": q @ x.T, "cosine": (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1), "l2": -np.linalg.norm(q[:, None] - x, axis=2)}
    for metric, want in scores.items():
        for block in (3, 4096):
            search.QUERY_BLOCK, saved = block, search.QUERY_BLOCK
            got = search.dense(vectors, queries, 5, metric).collect()
            search.QUERY_BLOCK = saved
            assert {(r.query_id, r.rank): r.id for r in got} == {(f"q{i}", k + 1): int(j) for i in range(7) for k, j in enumerate(np.argsort(-want[i], kind="stable")[:5])}
    assert search.dense(vectors, queries, None).count() == 7 * 300 and search.dense(vectors, queries.limit(0), 5).count() == 0
    assert search.dense(vectors.limit(0), queries, 5).count() == 0


def test_words_of_any_script(spark):
    docs = spark.createDataFrame([(1, "Für die Häuser: \u041f\u0440\u0438\u0432\u0435\u0442, \u4e2d\u6587!"), (2, "Running runners RAN"), (3, None), (4, "")], "id long, text string")
    index = search.postings(docs, "id", "text")
    assert {r.term for r in index.where("id = 1").collect()} == {"fur", "die", "hauser", "\u043f\u0440\u0438\u0432\u0435\u0442", "\u4e2d\u6587"}
    assert {r.term: r.tf for r in index.where("id = 2").collect()} == {"run": 1, "runner": 1, "ran": 1}
    stats = search.statistics_of(index, docs).first()
    assert (stats.n_texts, stats.mean_length) == (4, 8 / 4) and search.statistics(docs, "text").first() == stats
    asked = spark.createDataFrame([(1, "f\u00dcR"), (2, "runs"), (3, "\u041f\u0420\u0418\u0412\u0415\u0422 hauser")], "query_id long, query string")
    assert sorted((r.query_id, r.id) for r in search.bm25(index, stats and search.statistics_of(index, docs), asked).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_hooks(spark):
    from chronofact.functions.extraction import encoded, probed, time_expressions

    assert [s for s, _ in time_expressions("On 3 May 2001 and in 1999, by 2004-02-03, March 2010.")] == ["3 May 2001", "1999", "2004-02-03", "March 2010"]
    mentions = spark.createDataFrame([("Acme",), ("CEO of Acme",), ("",), ("x",)], "mention string")
    tagger = lambda x: [("Acme", "ORG")] if "Acme" in x else []
    assert [r.entity_type for r in probed(mentions, tagger).collect()] == ["ORG", "COMPOUND", "NONE", "NONE"]
    assert {r.entity_type for r in probed(mentions, None).collect()} == {"UNAVAILABLE"}
    texts = spark.createDataFrame([("ab",), (None,)], "text string")
    assert [r.vector for r in encoded(texts, lambda xs: [[len(x), 1] for x in xs]).collect()] == [[2.0, 1.0], [0.0, 1.0]]
    lines = spark.createDataFrame([('{"decision": "a", "rationale": "r1", "timestamp": "2"}',), ("{bad",), ('{"rationale": "r2", "timestamp": "3"}',)], "value string")
    assert [(r.decision, r.rationale) for r in reports.last_rationales(lines, 2).collect()] == [("UNKNOWN", "r2"), ("a", "r1")]
