"""Named queries over the driver tables, one for an operator, each beside its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofact.durable import saved, shared_folder
from chronofact.functions import intervals, texts
from chronofact.functions.analysis import stem
from chronofact.functions.extraction import scan_documents
from chronofact.functions.vocabulary import Vocabulary, canonicalize
from chronofact.model import KEY, fact_id
from chronofact.operators import catalog, chains, conflicts, evaluation, governance, reports, sampling, search, seeds, views
from chronofact.operators.block_index import BlockIndex
from chronofact.operators.containment import containing
from chronofact.operators.vector_index import VectorIndex
from chronofact.plans.facts import EDGES, EVENT, ORDER, SHIP, edges_rename, facts_event, facts_geo, facts_order, facts_ship, instant, table, with_provenance
from chronofact.streaming.ingest import event_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
AT = "1998-06-15"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


HOLDS = f"validity_start <= TIMESTAMP '{AT}' AND (validity_end IS NULL OR validity_end > TIMESTAMP '{AT}')"


# --- filters, views, lookups -------------------------------------------------------------------------------------------
@query(f"WITH {SHIP} SELECT subject, count(*) AS n FROM ship WHERE {HOLDS} AND status = 'active' GROUP BY subject")
def asof_active_count(spark, d):
    return views.as_of(facts_ship(spark, d), instant(AT)).groupBy("subject").agg(F.count("*").alias("n"))


@query(f"WITH {SHIP} SELECT id, subject, object, status FROM ship WHERE {HOLDS} AND status IN ('active', 'contested') AND object = 'Supplier#7'")
def asof_view_filtered(spark, d):
    return views.as_of(facts_ship(spark, d), instant(AT), "active_contested", {"object": "Supplier#7"}).select("id", "subject", "object", "status")


@query(f"WITH {SHIP} SELECT status, count(*) AS n FROM ship WHERE {HOLDS} GROUP BY status")
def asof_all_by_status(spark, d):
    return reports.count_by_status(views.as_of(facts_ship(spark, d), instant(AT), "all"))


@query(f"WITH {ORDER} SELECT o.subject, o.id, e.event_id FROM ord o JOIN (SELECT event_id, 'Customer#' || user_id AS subject, ts - INTERVAL 26 YEAR AS at FROM events) e ON e.subject = o.subject AND o.validity_start <= e.at AND (o.validity_end IS NULL OR o.validity_end > e.at)")
def asof_join_orders_events(spark, d):
    asked = table(spark, d, "events").select("event_id", F.concat(F.lit("Customer#"), "user_id").alias("subject"), (F.col("ts") - F.expr("INTERVAL 26 YEARS")).alias("at"))
    return views.as_of_join(facts_order(spark, d), asked, ["subject"], "at").select("q.subject", "f.id", "q.event_id")


@query(f"WITH {SHIP} SELECT DISTINCT subject, predicate, scope FROM ship WHERE subject ILIKE '%part#12%' ORDER BY ALL LIMIT 20")
def candidate_keys(spark, d):
    return views.candidate_keys(facts_ship(spark, d), "PART#12", limit=20)


@query(f"WITH {SHIP} SELECT id, object, evidence FROM ship WHERE subject = 'Part#3' AND predicate = 'supplier' AND scope = 'global'")
def key_lookup(spark, d):
    return views.by_key(facts_ship(spark, d), "Part#3", "supplier").select("id", "object", "evidence")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def passages_listed(spark, d):
    listed = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return views.among(table(spark, d, "documents").select("doc_id", "n_chars"), listed, "doc_id")


@query("SELECT md5(text) AS h, count(*) AS n FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id < 100) GROUP BY 1")
def passages_new_by_hash(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    fresh = views.not_among(docs, docs.where("doc_id < 100"), "h").select("h")
    return docs.join(fresh, "h").groupBy("h").agg(F.count("*").alias("n"))


@query(f"WITH {SHIP} SELECT id, object FROM ship WHERE source % 50 = 7")
def facts_of_source(spark, d):
    return views.from_source(with_provenance(facts_ship(spark, d)), "S7").select("id", "object")


@query(f"WITH {SHIP} SELECT id, validity_start AS first_seen, coalesce(validity_end, validity_start) AS last_seen FROM ship")
def evidence_span(spark, d):
    return views.evidence_span(with_provenance(facts_ship(spark, d))).select("id", "first_seen", "last_seen")


@query(f"WITH {SHIP} SELECT id, validity_end IS NULL AND validity_start < TIMESTAMP '{AT}' - INTERVAL 180 DAY AS stale FROM ship")
def stale_flags(spark, d):
    return with_provenance(facts_ship(spark, d)).select("id", views.is_stale(instant(AT)).alias("stale"))


@query(f"WITH {SHIP} SELECT subject, predicate, scope, max(validity_start) AS latest, epoch(TIMESTAMP '{AT}' - max(validity_start))::BIGINT AS age_seconds, epoch(TIMESTAMP '{AT}' - max(validity_start)) <= 90 * 86400 AS fresh FROM ship GROUP BY ALL")
def freshness(spark, d):
    return views.freshness(with_provenance(facts_ship(spark, d)), instant(AT))


@query("SELECT o_orderkey, CASE WHEN c >= 0.85 THEN 'accepted' WHEN c >= 0.6 THEN 'deferred' ELSE 'rejected' END AS decision FROM (SELECT o_orderkey, (o_orderkey % 100) / 100 AS c FROM orders)")
def gate_partition(spark, d):
    return views.gate(table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") % 100) / 100).alias("confidence"))).select("o_orderkey", "decision")


_OBJECTS = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN ' $' || p_size || '.5 million ' WHEN 2 THEN 'x' WHEN 3 THEN '#/#' WHEN 4 THEN p_name || '? ' ELSE p_size::VARCHAR END AS o FROM part"


@query(f"SELECT p_partkey, CASE WHEN length(trim(o)) < 2 THEN 'too_short' WHEN regexp_full_match(trim(o), '(?i)[\\d.,$€£¥%\\-+]+\\s*(billion|million|thousand|b|m|k)?') THEN 'bare_numeric' WHEN NOT regexp_matches(o, '[a-zA-Z]') THEN 'no_letters' WHEN regexp_matches(trim(o), '[?？]$') THEN 'interrogative' END AS problem FROM ({_OBJECTS})")
def object_problems(spark, d):
    name, size, k = F.col("p_name"), F.col("p_size").cast("string"), F.col("p_partkey") % 6
    o = F.when(k == 0, name).when(k == 1, F.concat(F.lit(" $"), size, F.lit(".5 million "))).when(k == 2, "x").when(k == 3, "#/#").when(k == 4, F.concat(name, F.lit("? "))).otherwise(size)
    return table(spark, d, "part").select("p_partkey", texts.object_problem(o).alias("problem"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'ok' WHEN s = 'ORG' AND o = 'PERSON' THEN 'ok' WHEN s = 'PERSON' AND o = 'ORG' THEN 'flip' WHEN s IS NULL OR o IS NULL THEN 'ok' ELSE 'reject' END AS direction FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'ORG' WHEN 1 THEN 'PERSON' END AS s, CASE o_orderkey % 5 WHEN 0 THEN 'ORG' WHEN 1 THEN 'PERSON' WHEN 2 THEN 'GPE' END AS o FROM orders)")
def direction_check(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", F.when(k % 4 == 0, "unheard of").otherwise("CEO").alias("predicate"), F.when(k % 3 == 0, "ORG").when(k % 3 == 1, "PERSON").alias("subject_type"), F.when(k % 5 == 0, "ORG").when(k % 5 == 1, "PERSON").when(k % 5 == 2, "GPE").alias("object_type"))
    return views.direction(rows, Vocabulary.default().dimension(spark)).select("o_orderkey", "direction")


@query(f"WITH {SHIP} SELECT count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM ship")
def fact_hashes(spark, d):
    return facts_ship(spark, d).withColumn("id", fact_id()).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("SELECT p_partkey, trim(p_name) AS subject, CASE p_partkey % 4 WHEN 0 THEN 'chiefExecutiveOfficer' WHEN 1 THEN 'language' WHEN 2 THEN 'headquarteredIn' ELSE 'Unknown Thing' END AS predicate FROM part")
def canonical_predicates(spark, d):
    k = F.col("p_partkey") % 4
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit("  ")).alias("subject"), F.when(k == 0, "Chief Executive Officer").when(k == 1, "Language").when(k == 2, "HQ").otherwise("Unknown Thing").alias("predicate"))
    return canonicalize(rows, Vocabulary.default())


@query(f"WITH {SHIP} SELECT id, subject, predicate, scope, object, status, strftime(validity_start, '%Y-%m-%d') AS valid_from, coalesce(strftime(validity_end, '%Y-%m-%d'), 'ongoing') AS valid_until FROM ship")
def payload(spark, d):
    return views.payload(facts_ship(spark, d))


@query(f"WITH {SHIP} SELECT count(*) AS n FROM ship WHERE status <> 'deprecated' AND {HOLDS}")
def join_eligible(spark, d):
    return views.join_eligible(facts_ship(spark, d), instant(AT)).agg(F.count("*").alias("n"))


# --- changes to tables --------------------------------------------------------------------------------------------------
@query(f"WITH {SHIP} SELECT change, count(*) AS n, min(id) AS first_id FROM (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.status <> b.status THEN 'status_changed' END AS change FROM (SELECT id, status FROM ship WHERE source % 3 <> 0) a FULL JOIN (SELECT id, CASE WHEN evidence > 2 THEN 'active' ELSE status END AS status FROM ship WHERE source % 4 <> 0) b ON a.id = b.id) WHERE change IS NOT NULL GROUP BY change")
def snapshot_diff(spark, d):
    f = facts_ship(spark, d)
    new = f.where("source % 4 <> 0").withColumn("status", F.when(F.col("evidence") > 2, "active").otherwise(F.col("status")))
    return catalog.snapshot_diff(f.where("source % 3 <> 0"), new).groupBy("change").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"WITH {SHIP} SELECT id FROM ship WHERE source % 50 NOT IN (7, 8)")
def delete_by_source(spark, d):
    sources = spark.createDataFrame([("S7",), ("S8",)], "source_id string")
    facts = with_provenance(facts_ship(spark, d))
    passages = views.evidence(facts).select("source_id").distinct()
    return catalog.delete_sources(facts, passages, sources)[0].select("id")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_upsert(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    base = o.groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("r")).select("o_custkey", "r.*")
    return catalog.upsert(base, o, ["o_custkey"], "o_orderkey")


@query("SELECT c_custkey AS k, c_custkey NOT IN (SELECT o_custkey FROM orders) AS created FROM customer")
def upsert_created(spark, d):
    have = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return catalog.upsert_report(have, table(spark, d, "customer").select(F.col("c_custkey").alias("k")), ["k"])


@query(f"WITH {SHIP}, won AS (SELECT subject, min(id) AS winner FROM ship WHERE status = 'contested' GROUP BY subject) SELECT id, CASE WHEN winner IS NULL THEN status WHEN id = winner THEN 'active' ELSE 'deprecated' END AS status FROM ship LEFT JOIN won USING (subject)")
def resolve_keys(spark, d):
    f = facts_ship(spark, d).withColumn("rank", F.lit("normal"))
    decisions = f.where("status = 'contested'").groupBy(*KEY).agg(F.min("id").alias("winner_id")).withColumn("action", F.lit("winner"))
    return catalog.resolve(f, decisions).select("id", "status")


@query("SELECT doc_id, source FROM documents WHERE source = 'src1' UNION ALL SELECT doc_id, 'new' FROM documents WHERE source <> 'src1' AND lang = 'de'")
def write_skip(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    new = docs.where("lang = 'de'").select("doc_id", F.lit("new").alias("source"))
    return catalog.write_policy(docs.where("source = 'src1'").select("doc_id", "source"), new, ["doc_id"], "SKIP", "source")


@query("SELECT doc_id, sha256(text || '|trigger') AS cache_key FROM documents WHERE doc_id % 3 <> 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)")
def cache_misses(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    cache = docs.where("doc_id % 3 = 0").select(catalog.cache_key(F.col("text"), "trigger").alias("cache_key")).distinct()
    return catalog.split_by_cache(docs, cache, "trigger")[1].select("doc_id", "cache_key")


# --- counts and reports -------------------------------------------------------------------------------------------------
@query(f"WITH {SHIP} SELECT subject, predicate, scope, count(*) AS n FROM ship WHERE status = 'contested' GROUP BY ALL")
def contested_keys(spark, d):
    return reports.contested_keys(facts_ship(spark, d))


@query(f"WITH {SHIP} SELECT count(*) AS n_facts, count_if(status = 'active') AS n_active, count_if(status = 'deprecated') AS n_deprecated, count_if(status = 'contested') AS n_contested, count(DISTINCT subject) AS n_subjects, count(DISTINCT predicate) AS n_predicates, 0::BIGINT AS n_renames FROM ship")
def store_stats(spark, d):
    return reports.store_stats(facts_ship(spark, d), Vocabulary.default().renaming())


@query(f"WITH {ORDER} SELECT count(DISTINCT subject) AS n_keys, min(validity_start) AS first_start, max(validity_start) AS last_start FROM ord")
def inspect_keys(spark, d):
    return reports.inspect(facts_order(spark, d))


@query(f"WITH {EVENT} SELECT predicate, count(*) AS n FROM ev GROUP BY predicate ORDER BY n DESC, predicate LIMIT 3")
def top_predicates(spark, d):
    return reports.top(facts_event(spark, d), "predicate", 3)


@query(f"WITH {EDGES} SELECT count(*) AS n FROM edges")
def rename_edge_count(spark, d):
    return reports.rename_edges(edges_rename(spark, d).withColumn("provenance", F.array(F.col("id"))), ["renamedTo"])


@query(f"WITH {SHIP} SELECT status AS extractor, CASE WHEN confidence < 0.5 THEN '<0.5' WHEN confidence < 0.7 THEN '0.5-0.7' WHEN confidence < 0.85 THEN '0.7-0.85' ELSE '>=0.85' END AS bucket, count(*) AS n FROM ship GROUP BY ALL")
def confidence_histogram(spark, d):
    return reports.review_histogram(facts_ship(spark, d), extractor="status")


@query("SELECT CASE WHEN event_id % 5 = 1 THEN 'UNKNOWN' ELSE event_type END AS decision, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY ALL")
def decision_histogram(spark, d):
    k = F.col("event_id") % 5
    line = F.when(k == 0, "{broken").when(k == 1, '{"a": 1}').otherwise(F.to_json(F.struct(F.col("event_type").alias("decision"))))
    return reports.decision_histogram(table(spark, d, "events").select(line.alias("value")))


@query(f"WITH {SHIP} SELECT subject, predicate, count(*) AS n, string_agg(object || ': ' || left(text, 140), ' | ' ORDER BY validity_start, id) AS claims FROM ship WHERE status = 'contested' GROUP BY ALL")
def disputes_by_key(spark, d):
    return reports.disputes(facts_ship(spark, d))


_WILSON = "round(greatest(0, 100 * ((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) {} 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n))), 6)"


@query(f"SELECT lang, k, n, round(100.0 * k / n, 6) AS percent, {_WILSON.format('-')} AS low, {_WILSON.format('+')} AS high FROM (SELECT lang, count_if(quality = 1) AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang)")
def wilson_by_language(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return reports.share(rows, F.col("quality") == 1, ["lang"]).withColumns({c: F.round(c, 6) for c in ("percent", "low", "high")})


@query(f"""WITH {SHIP}, keys AS (SELECT subject, count(DISTINCT object) AS objects, count_if(validity_known) AS known, bool_or(status = 'contested') AS contested, date_diff('day', min(CASE WHEN validity_known THEN validity_start END), max(CASE WHEN validity_known THEN validity_start END)) AS span FROM ship GROUP BY subject),
k AS (SELECT count(*) AS n_keys, count_if(objects >= 2 AND known >= 2 AND span > 365) AS n_drift, count(*) AS n_functional, count_if(contested) AS n_conflict FROM keys), f AS (SELECT count(*) AS n_facts, count_if(validity_known) AS n_known FROM ship)
SELECT n_keys, n_drift, n_conflict, n_known, round(100.0 * n_drift / n_keys, 6) AS drift, round(100.0 * n_conflict / n_functional, 6) AS conflict, CASE WHEN 100.0 * n_drift / n_keys + 100.0 * n_conflict / n_functional >= 5 THEN 'high' WHEN n_drift + n_conflict + n_known > 0 THEN 'medium' ELSE 'low' END AS verdict FROM k, f""")
def deep_scan(spark, d):
    return reports.drift_and_conflict(facts_ship(spark, d), ["supplier"], []).select("n_keys", "n_drift", "n_conflict", "n_known", F.round("drift", 6).alias("drift"), F.round("conflict", 6).alias("conflict"), "verdict")


@query("SELECT name, frequency, CASE WHEN name IN ('announced') THEN 'event_log' WHEN objects = 1 THEN 'functional' ELSE 'multi_valued' END AS cardinality, CASE name WHEN 'announced' THEN 'announces' ELSE '' END AS aliases FROM (SELECT name, sum(n)::BIGINT AS frequency, max(objects) AS objects FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'orderStatus' WHEN 1 THEN 'announced' ELSE 'customerOf' END AS name, CASE o_orderkey % 3 WHEN 2 THEN o_orderkey ELSE o_custkey END AS s, count(*) AS n, count(DISTINCT o_orderstatus) AS objects FROM orders GROUP BY ALL) GROUP BY name)")
def schema_discovery(spark, d):
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, "Order status").when(k == 1, "announces").otherwise("customerOf")
    facts = table(spark, d, "orders").select(raw.alias("predicate"), F.when(k == 2, F.col("o_orderkey")).otherwise(F.col("o_custkey")).cast("string").alias("subject"), F.col("o_orderstatus").alias("object"))
    found = reports.discover_predicates(facts, Vocabulary.default().dimension(spark))
    return found.select("name", "frequency", "cardinality", F.when(F.col("name") == "announced", F.col("aliases")).otherwise("").alias("aliases"))


@query("SELECT entity, n, n_predicates, n_langs, round(n * (1 + n_predicates) * (1 + 0.2 * n_langs), 6)::DOUBLE AS score, row_number() OVER (ORDER BY n * (1 + n_predicates) * (1 + 0.2 * n_langs) DESC, n DESC, entity DESC) AS rank FROM (SELECT 'User#' || user_id AS entity, count(*) AS n, count(DISTINCT event_type) AS n_predicates, 1 AS n_langs FROM events GROUP BY user_id) WHERE n >= 3 QUALIFY rank <= 40")
def seed_scores(spark, d):
    mentions = table(spark, d, "events").select(F.concat(F.lit("User#"), "user_id", F.lit(" Corp.")).alias("entity"), F.col("event_type").alias("predicate"), F.lit("en").alias("lang"))
    return reports.seed_entities(mentions, budget=10).withColumn("score", F.round("score", 6))


@query("SELECT count(*) AS n_sampled, round(avg(greatest(1, length(text) // 4)), 6) AS mean_in, round(avg(greatest(1, least(800, length(text) // 10))), 6) AS mean_out, round(avg(greatest(1, length(text) // 4)) * 10 * count(*))::BIGINT AS total_in FROM documents")
def cost_estimate(spark, d):
    docs = table(spark, d, "documents").select("text")
    return reports.ingest_cost(docs, n_total=10 * docs.count()).select("n_sampled", F.round("mean_in", 6).alias("mean_in"), F.round("mean_out", 6).alias("mean_out"), "total_in")


@query(f"WITH {SHIP}, m AS (SELECT *, validity_end IS NULL AND validity_start < TIMESTAMP '{AT}' - INTERVAL 180 DAY AS stale, bool_or(status = 'contested') OVER (PARTITION BY subject) AS conflict FROM ship) SELECT count(*) AS n_facts, count(DISTINCT CASE WHEN conflict THEN subject END) AS n_conflicts, count_if(stale) AS n_stale, count_if(NOT stale AND NOT conflict) AS n_consistent FROM m")
def audit_counts(spark, d):
    return governance.audit_counts(with_provenance(facts_ship(spark, d)), views.is_stale(instant(AT)))


# --- chains -------------------------------------------------------------------------------------------------------------
@query(f"WITH {ORDER}, c AS (SELECT subject, id, validity_start, lag(validity_end) OVER w AS e, row_number() OVER w AS position FROM ord WHERE status = 'active' WINDOW w AS (PARTITION BY subject ORDER BY validity_start, id)) SELECT subject, id, position, CASE WHEN validity_start >= e THEN date_diff('second', e, validity_start) END AS gap_seconds FROM c WHERE position <= 50")
def succession_gap(spark, d):
    return chains.succession(facts_order(spark, d)).select("subject", "id", F.col("position").cast("long").alias("position"), "gap_seconds")


@query(f"WITH {ORDER}, c AS (SELECT subject, id, row_number() OVER (PARTITION BY subject ORDER BY validity_start, id) AS position, count(*) OVER (PARTITION BY subject) > 5 AS truncated FROM ord WHERE validity_start <= TIMESTAMP '{AT}') SELECT subject, id, position, truncated FROM c WHERE position <= 5")
def succession_truncated(spark, d):
    return chains.succession(facts_order(spark, d), instant(AT), include_contested=True, max_depth=5).select("subject", "id", F.col("position").cast("long").alias("position"), "truncated")


@query(f"WITH {ORDER}, c AS (SELECT subject, id, validity_start, validity_end, row_number() OVER (PARTITION BY subject ORDER BY validity_start, id) AS position FROM ord) SELECT subject, arg_min(id, position) AS id FROM c WHERE {HOLDS} GROUP BY subject")
def chain_at(spark, d):
    return chains.chain_at(chains.succession(facts_order(spark, d), include_contested=True), instant(AT)).select("subject", "id")


@query(f"WITH {ORDER} SELECT object, next_object, count(*) AS n FROM (SELECT object, lead(object) OVER (PARTITION BY subject ORDER BY validity_start, id) AS next_object FROM ord) WHERE next_object IS NOT NULL GROUP BY ALL")
def chain_pairs(spark, d):
    return chains.chain_pairs(chains.succession(facts_order(spark, d), include_contested=True)).groupBy("object", "next_object").agg(F.count("*").alias("n"))


def _walk_sql(here: str, there: str) -> str:
    return f"""WITH RECURSIVE {EDGES}, starts AS (SELECT 'O' || min(o_orderkey) AS start FROM orders GROUP BY o_custkey),
walk(start, step, id, nxt) AS (SELECT start, 1, id, {there} FROM starts JOIN edges ON {here} = start UNION ALL SELECT start, step + 1, edges.id, {there} FROM walk JOIN edges ON {here} = nxt WHERE step < 11)
SELECT start, step, id, max(step) OVER (PARTITION BY start) > 10 AS truncated FROM walk QUALIFY step <= 10"""


def _starts(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.concat(F.lit("O"), F.min("o_orderkey")).alias("start")).select("start")


@query(_walk_sql("subject", "object"))
def rename_walk(spark, d):
    return chains.rename_walk(edges_rename(spark, d), _starts(spark, d), ["renamedTo"]).select("start", "step", "id", "truncated")


@query(_walk_sql("object", "subject"))
def rename_walk_backward(spark, d):
    return chains.rename_walk(edges_rename(spark, d), _starts(spark, d), ["renamedTo"], direction="backward").select("start", "step", "id", "truncated")


@query("SELECT c_name AS start, n_name AS hop_1, r_name AS hop_2, false AS ambiguous FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_chain_geo(spark, d):
    starts = table(spark, d, "customer").select(F.col("c_name").alias("start"))
    return chains.join_chain(facts_geo(spark, d), starts, ["locatedNation", "inRegion"], instant(AT))


# --- conflicts, duplicates ----------------------------------------------------------------------------------------------
@query(f"""WITH {SHIP}, p AS (SELECT a.evidence AS ne, b.evidence AS oe, a.validity_start AS ns, b.validity_start AS os FROM ship a JOIN ship b ON a.subject = b.subject AND a.id <> b.id AND (b.validity_end IS NULL OR a.validity_start < b.validity_end) AND (a.validity_end IS NULL OR b.validity_start < a.validity_end))
SELECT CASE WHEN ne >= 2 AND oe < 2 AND ns > os THEN 'deprecate_old' WHEN oe >= 2 AND ne < 2 AND os > ns THEN 'deprecate_new' ELSE 'contested' END AS branch, count(*) AS n FROM p GROUP BY 1""")
def conflict_branches(spark, d):
    return conflicts.conflict_pairs(facts_ship(spark, d)).groupBy("branch").agg(F.count("*").alias("n"))


_MEETS = "((p.e IS NULL OR f.s < p.e) AND (f.e IS NULL OR p.s < f.e))"
_NEW_WINS, _OLD_WINS = "(f.ev >= 2 AND p.ev < 2 AND f.s > p.s)", "(p.ev >= 2 AND f.ev < 2 AND p.s > f.s)"


@query(f"""WITH RECURSIVE {SHIP}, f AS (SELECT subject, id, validity_start AS s, validity_end AS e, evidence AS ev, row_number() OVER (PARTITION BY subject ORDER BY source, id) AS n FROM ship),
w AS (SELECT subject, 1::BIGINT AS n, [{{'id': id, 's': s, 'e': e, 'ev': ev, 'st': 'active'}}] AS l FROM f WHERE n = 1 UNION ALL
 SELECT w.subject, w.n + 1, list_append(list_transform(l, lambda p: CASE WHEN NOT {_MEETS} OR {_OLD_WINS} THEN p WHEN {_NEW_WINS} THEN {{'id': p.id, 's': p.s, 'e': CASE WHEN p.e IS NULL OR f.s < p.e THEN f.s ELSE p.e END, 'ev': p.ev, 'st': 'deprecated'}} ELSE {{'id': p.id, 's': p.s, 'e': p.e, 'ev': p.ev, 'st': 'contested'}} END),
  {{'id': f.id, 's': f.s, 'e': f.e, 'ev': f.ev, 'st': coalesce(list_extract(list_filter(list_transform(l, lambda p: CASE WHEN NOT {_MEETS} OR {_NEW_WINS} THEN NULL WHEN {_OLD_WINS} THEN 'deprecated' ELSE 'contested' END), lambda x: x IS NOT NULL), -1), 'active')}})
 FROM w JOIN f ON f.subject = w.subject AND f.n = w.n + 1)
SELECT x.id AS id, x.st AS status, x.e AS validity_end FROM (SELECT unnest(l) AS x FROM (SELECT arg_max(l, n) AS l FROM w GROUP BY subject))""")
def conflict_fold(spark, d):
    facts = facts_ship(spark, d).withColumns({"ingest_seq": F.col("source"), "predicate": F.lit("parentCompany"), "validity_start": F.col("validity_start").cast("timestamp"), "validity_end": F.col("validity_end").cast("timestamp"), "status": F.lit("active")})
    return conflicts.resolve_conflicts(facts, Vocabulary.default(), dedup=None).select("id", "status", F.col("validity_end").cast("timestamp_ntz").alias("validity_end"))


@query("""WITH g AS (SELECT p_partkey, p_brand, list_distinct(list_transform(range(1, greatest(length(p_name) - 2, 1) + 1), lambda i: substr(lower(p_name), i, 3))) AS s FROM part)
SELECT a.p_brand, a.p_partkey AS left_id, b.p_partkey AS right_id, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS similarity FROM g a JOIN g b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey WHERE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) >= 0.85""")
def jaccard_duplicates(spark, d):
    return conflicts.duplicates(table(spark, d, "part"), key=("p_brand",), object_="p_name", order="p_partkey").withColumn("similarity", F.round("similarity", 6))


@query("SELECT mention, first_value(mention) OVER (PARTITION BY p ORDER BY seq, mention) AS canonical FROM (SELECT mention, p, min(k) AS seq FROM (SELECT p_partkey AS k, p_name AS p, p_name || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' Inc.' ELSE ', LTD' END AS mention FROM part) GROUP BY ALL)")
def alias_resolution(spark, d):
    k = F.col("p_partkey") % 3
    mentions = table(spark, d, "part").select(F.concat("p_name", F.when(k == 0, "").when(k == 1, " Inc.").otherwise(", LTD")).alias("mention"), F.col("p_partkey").alias("ingest_seq"))
    return conflicts.resolve_aliases(mentions).select("mention", "canonical")


@query(f"WITH {SHIP} SELECT id, CASE WHEN least(validity_end, TIMESTAMP '{AT}') > validity_start THEN least(validity_end, TIMESTAMP '{AT}') ELSE validity_end END AS validity_end FROM ship")
def tightened_ends(spark, d):
    return facts_ship(spark, d).select("id", intervals.tightened_end(F.col("validity_end"), F.col("validity_start"), instant(AT)).alias("validity_end"))


@query(f"WITH {SHIP} SELECT DISTINCT e AS entity FROM (SELECT subject AS e FROM ship UNION SELECT object FROM ship) WHERE e <> ''")
def entity_union(spark, d):
    f = facts_ship(spark, d)
    return f.select(F.col("subject").alias("entity")).union(f.select("object")).distinct().where("entity <> ''")


# --- retrieval ----------------------------------------------------------------------------------------------------------
#: Queries by their stems; words of those stems are told to SQL, as DuckDB has no stemmer here.
_STEMS = {1: ("the", "of", "thing"), 2: ("ciento",), 3: ("der", "die")}
_ENDINGS = ("", "s", "es", "e", "ed", "ing", "ings", "edly", "ness", "nesses", "ful", "fulness", "ation", "er", "ers", "ly", "'s")
_Q_ROWS = ", ".join(f"({q}, '{x}', '{x}{e}', {len(stems)})" for q, stems in _STEMS.items() for x in stems for e in _ENDINGS if stem(x + e) == x)
_BM25 = f"""tok AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
st AS (SELECT count(*) AS nt, avg(len(w)) AS ml FROM tok), post AS (SELECT id, len(w) AS l, unnest(w) AS word FROM tok),
q(query_id, term, word, wanted) AS (VALUES {_Q_ROWS}), forms AS (SELECT DISTINCT term, word FROM q),
tf AS (SELECT id, l, term, count(*) AS tf FROM post JOIN forms USING (word) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, id, sum(greatest(ln((nt - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / ml))) AS score FROM tf JOIN (SELECT DISTINCT query_id, term, wanted FROM q) USING (term) JOIN df USING (term), st GROUP BY query_id, id, wanted HAVING count(*) = wanted)"""
_QUERIES = [(1, "The things, of the"), (2, "Cientos"), (3, "DER dïe")]


def _index(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = saved(search.postings(docs, "doc_id", "text"))  # read for hits, frequencies and lengths
    return index, search.statistics_of(index, docs), spark.createDataFrame(_QUERIES, "query_id long, query string")


@query(f"WITH {_BM25} SELECT query_id::BIGINT AS query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc QUALIFY rank <= 20")
def bm25_topk(spark, d):
    hits = search.bm25(*_index(spark, d), top_k=20, digits=9)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BM25} SELECT query_id::BIGINT AS query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc QUALIFY rank <= 20")
def block_index_topk(spark, d):
    """The index in two segments: half of the texts come with the first, half with the second, which also takes away and
    brings anew some of the first."""
    texts_ = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    early = texts_.where(half | (F.col("id") % 10 == 0)).withColumn("text", F.when(half, F.col("text")).otherwise(F.concat(F.lit("the der cientos "), "text")))
    index = BlockIndex(spark, f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}", "bigint").change(early).change(texts_.where(~half), early.where(~half))
    hits = index.bm25(spark.createDataFrame(_QUERIES, "query_id long, query string"), top_k=20, digits=9)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_ANY = """tok AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents), st AS (SELECT count(*) AS nt, avg(len(w)) AS ml FROM tok),
tf AS (SELECT id, l, term, count(*) AS tf FROM (SELECT id, len(w) AS l, unnest(w) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, ln((nt - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY term, nt),
q(query_id, term) AS (VALUES (0, 'the'), (0, 'festival'), (1, 'vaccine'), (1, 'und'), (1, 'ciento')),
sc AS (SELECT query_id, id, sum(CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM df) ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / ml))) AS score FROM tf JOIN q USING (term) JOIN df USING (term), st GROUP BY query_id, id)"""


@query(f"WITH {_ANY} SELECT query_id::BIGINT AS query_id, id, round(score, 6) AS score FROM sc WHERE score > 0")
def any_term_search(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    asked = spark.createDataFrame([(0, "The festival!"), (1, "vaccine und ciento")], "query_id long, query string")
    index = saved(search.postings(docs, "doc_id", "text", search.plain_terms))
    hits = search.any_term(index, search.statistics_of(index, docs), asked, None)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"))


_DENSE = "SELECT q.vec_id AS query_id, v.vec_id AS id, list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0"


@query(f"SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM ({_DENSE}) QUALIFY rank <= 10")
def dense_topk(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    hits = search.dense(v, v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 10, digits=9)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _vector_index(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return VectorIndex.build(v, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"), v.where("id % 20 = 0").withColumnRenamed("id", "query_id")


@query(f"SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM ({_DENSE}) QUALIFY rank <= 10")
def vector_index_topk(spark, d):
    index, asked = _vector_index(spark, d)
    return index.search(asked, 10, exact=True, digits=9).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()  # as many cells answer as the index found to do; the tests measure its recall
def vector_index_probe(spark, d):
    index, asked = _vector_index(spark, d)
    return index.search(asked, 10, digits=9)


@query("""WITH w AS (SELECT p_partkey AS id, ' ' || unnest(list_filter(regexp_split_to_array(lower(p_name), '\\s+'), lambda x: x <> '')) || ' ' AS w FROM part),
g AS (SELECT id, unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))) AS gram FROM w), tf AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY ALL),
df AS (SELECT gram, ln((1.0 + (SELECT count(*) FROM part)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY gram), x AS (SELECT id, gram, tf * idf AS w FROM tf JOIN df USING (gram)),
v AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM x), s AS (SELECT q.id AS query_id, v.id, round(sum(q.w * v.w), 9) AS score FROM v q JOIN v USING (gram) WHERE q.id % 20 = 0 GROUP BY ALL)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5""")
def tfidf_topk(spark, d):
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    hits = seeds.similar_texts(seeds.Encoder.fit(names), names, names.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 5, digits=9)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()  # a choice of one after another; the tests hold it against plain Python
def diverse_parts(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.col("p_retailprice").alias("quality"))
    return seeds.diverse(parts, seeds.Encoder.fit(parts).vectors(parts), 25)


def _lists(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("query_id"), F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderdate")
    first = search.ranked(o.select("query_id", "id", F.col("o_totalprice").alias("score")), 10)
    second = search.ranked(o.select("query_id", "id", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double").alias("score")), 10)
    return first, second


_LISTS = """a AS (SELECT o_custkey % 50 AS query_id, o_orderkey AS id, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 10),
b AS (SELECT o_custkey % 50 AS query_id, o_orderkey AS id, epoch(o_orderdate) AS score, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 10)"""


@query(f"WITH {_LISTS} SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY sum(1.0 / (60 + rank)) DESC, min(l * 1000 + rank), id) AS rank FROM (SELECT *, 0 AS l FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY query_id, id")
def rrf_fusion(spark, d):
    a, b = _lists(spark, d)
    fused = search.rrf(a.withColumn("list", F.lit(0)).unionByName(b.withColumn("list", F.lit(1))))
    return fused.select("query_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_LISTS}, sa AS (SELECT query_id, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM a WINDOW w AS (PARTITION BY query_id)), sb AS (SELECT query_id, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM b WINDOW w AS (PARTITION BY query_id)) SELECT query_id, id, round(0.4 * coalesce(sa.s, 0) + 0.5 * coalesce(sb.s, 0), 6) AS score FROM sa FULL JOIN sb USING (query_id, id)")
def minmax_fusion(spark, d):
    a, b = _lists(spark, d)
    return search.weighted_minmax(a, b).select("query_id", "id", F.round("score", 6).alias("score"))


_ASKED = [(1, "Part 3 supplier 7", [0.5, 1.0, -0.25]), (2, "parts 12", [-1.0, 0.0, 2.0]), (3, "nothing here", [1.0, 1.0, 1.0])]
_HYBRID = f"""{SHIP}, v AS (SELECT * FROM ship WHERE {HOLDS} AND status = 'active'), st AS (SELECT count(*) AS nt, 5.0 AS ml FROM ship),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(['part', split_part(subject, '#', 2), 'come', 'from', 'supplier', split_part(object, '#', 2)]) AS term FROM ship) GROUP BY ALL),
q(query_id, term, wanted, x, y, z) AS (VALUES (1, 'part', 4, 0.5, 1.0, -0.25), (1, '3', 4, 0.5, 1.0, -0.25), (1, 'supplier', 4, 0.5, 1.0, -0.25), (1, '7', 4, 0.5, 1.0, -0.25), (2, 'part', 2, -1.0, 0.0, 2.0), (2, '12', 2, -1.0, 0.0, 2.0), (3, 'noth', 2, 1.0, 1.0, 1.0)),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sp AS (SELECT query_id, id, sum(greatest(ln((nt - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2)) AS score FROM tf JOIN q USING (term) JOIN df USING (term), st WHERE id IN (SELECT id FROM v) GROUP BY query_id, id, wanted HAVING count(*) = wanted),
de AS (SELECT query_id, id, x * evidence + y * (source % 7) + z * (source % 11) AS score FROM v, (SELECT DISTINCT query_id, x, y, z FROM q)),
rs AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM sp QUALIFY r <= 15), rd AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM de QUALIFY r <= 15),
f AS (SELECT query_id, id, rs.r AS sparse_rank, rd.r AS dense_rank, coalesce(1.0 / (60 + rs.r), 0) + coalesce(1.0 / (60 + rd.r), 0) AS score FROM rs FULL JOIN rd USING (query_id, id))"""


@query(f"WITH {_HYBRID} SELECT query_id::BIGINT AS query_id, id, object, round(score, 6) AS score, sparse_rank, dense_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sparse_rank IS NULL, coalesce(sparse_rank, dense_rank), id) AS rank FROM f) JOIN (SELECT id, object FROM v) USING (id) WHERE rank <= 5")
def hybrid_retrieval(spark, d):
    facts = facts_ship(spark, d).select("id", "text", *KEY, "object", "validity_start", "validity_end", "status", F.array(F.col("evidence").cast("double"), (F.col("source") % 7).cast("double"), (F.col("source") % 11).cast("double")).alias("vector"))
    asked = spark.createDataFrame(_ASKED, "query_id long, query string, vector array<double>")
    view = views.as_of(facts, instant(AT))
    index = saved(search.postings(facts, "id", "text"))
    found = search.hybrid(view.drop("vector"), index, search.statistics_of(index, facts), asked, facts.select("id", "vector"), top_k=5, digits=9)
    return found.select("query_id", "id", "object", F.round("score", 6).alias("score"), F.col("sparse_rank").cast("long").alias("sparse_rank"), F.col("dense_rank").cast("long").alias("dense_rank"))


@query(f"WITH {_HYBRID}, h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sparse_rank IS NULL, coalesce(sparse_rank, dense_rank), id) AS rank FROM f QUALIFY rank <= 15) SELECT query_id::BIGINT AS query_id, 'S' || (source % 50) AS source_id, min(rank) AS rank FROM h JOIN (SELECT id, source FROM ship) USING (id) GROUP BY ALL")
def passages_of_search(spark, d):
    facts = with_provenance(facts_ship(spark, d)).withColumn("vector", F.array(F.col("evidence").cast("double"), (F.col("source") % 7).cast("double"), (F.col("source") % 11).cast("double")))
    asked = spark.createDataFrame(_ASKED, "query_id long, query string, vector array<double>")
    index = saved(search.postings(facts, "id", "text"))
    hits = search.hybrid(views.as_of(facts, instant(AT)).select("id"), index, search.statistics_of(index, facts), asked, facts.select("id", "vector"), top_k=15, digits=9, pool=15)
    return search.passages_of(hits, views.evidence(facts)).select("query_id", "source_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {SHIP}, h AS (SELECT id, source % 50 AS s, row_number() OVER (ORDER BY id) AS rank FROM ship) SELECT 1::BIGINT AS query_id, 'S' || s AS source_id, min(rank) AS rank FROM h GROUP BY s")
def passages_of_hits(spark, d):
    facts = with_provenance(facts_ship(spark, d))
    ranked, _ = sampling.global_rank(facts.select("id"), ["id"])
    hits = ranked.select(F.lit(1).cast("long").alias("query_id"), "id", (F.col("__rank") + 1).cast("long").alias("rank")).withColumn("score", 1.0 / F.col("rank"))
    return search.passages_of(hits, views.evidence(facts)).select("query_id", "source_id", "rank")


# --- sampling -----------------------------------------------------------------------------------------------------------
@query("SELECT CASE WHEN regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) = '' THEN 'unknown_domain' ELSE lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) END AS domain, count(*) AS n FROM pages GROUP BY 1")
def domain_buckets(spark, d):
    return table(spark, d, "pages").groupBy(texts.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query("SELECT decile::INT AS decile, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT o_orderkey, least(9, floor((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) * 10 / count(*) OVER ())) AS decile FROM orders) GROUP BY 1")
def decile_buckets(spark, d):
    return sampling.deciles(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).groupBy("decile").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("WITH t AS (SELECT doc_id, lang, md5('0|' || doc_id) AS h, row_number() OVER (PARTITION BY lang ORDER BY md5('0|' || doc_id)) AS turn FROM documents) SELECT doc_id, lang FROM t ORDER BY (turn > (SELECT ceil(100 / count(DISTINCT lang)) FROM t))::INT, h LIMIT 100")
def strata_quota(spark, d):
    return sampling.stratified(table(spark, d, "documents").select("doc_id", "lang"), 100, stratum="lang", id_col="doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 50")
def reservoir_sample(spark, d):
    return sampling.reservoir(table(spark, d, "documents").select("doc_id"), 50, 7, "doc_id")


@query("SELECT CASE WHEN c BETWEEN 19968 AND 40959 OR c BETWEEN 13312 AND 19903 THEN 'zh' WHEN c BETWEEN 1024 AND 1327 THEN 'ru' WHEN c BETWEEN 1536 AND 1791 OR c BETWEEN 1872 AND 1919 THEN 'ar' WHEN c BETWEEN 32 AND 591 THEN 'en' ELSE 'unk' END AS lang_block, count(*) AS n FROM (SELECT unicode(ltrim(left(text, 500), chr(10) || chr(9) || ' ')) AS c FROM documents) GROUP BY 1")
def language_blocks(spark, d):
    return reports.mention_languages(table(spark, d, "documents").select("text")).groupBy("lang_block").agg(F.count("*").alias("n"))


_SPACES = "[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


@query(f"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '{_SPACES}'), lambda x: x <> '')) AS word FROM documents),
n AS (SELECT doc_id, h, count(*) AS n FROM (SELECT doc_id, ('0x' || substr(md5(word), 17, 16))::UBIGINT AS h FROM w) GROUP BY ALL),
b AS (SELECT doc_id, k, sum(CASE WHEN (h >> k) & 1 = 1 THEN n ELSE -n END) AS s FROM n, (SELECT unnest(range(64)) AS k) GROUP BY ALL),
f AS (SELECT doc_id AS id, coalesce(bit_or(CASE WHEN s > 0 THEN 1::UBIGINT << k::UBIGINT ELSE 0::UBIGINT END), 0::UBIGINT) AS h FROM documents LEFT JOIN b USING (doc_id) GROUP BY doc_id),
d AS (SELECT h, min(id) AS id FROM f GROUP BY h)
SELECT x.id AS left_id, y.id AS right_id, bit_count(xor(x.h, y.h))::INT AS bits FROM d x JOIN d y ON x.id < y.id AND bit_count(xor(x.h, y.h)) <= 3 UNION ALL SELECT d.id, f.id, 0 FROM f JOIN d USING (h) WHERE f.id <> d.id""")
def simhash_pairs(spark, d):
    hashed = table(spark, d, "documents").select(F.col("doc_id").alias("id"), sampling.simhash(F.col("text")).alias("simhash"))
    return sampling.near_duplicate_pairs(hashed)


@query()  # texts one after another; the tests hold it against plain Python
def near_duplicates_filtered(spark, d):
    hashed = table(spark, d, "documents").select(F.col("doc_id").alias("id"), sampling.simhash(F.col("text")).alias("simhash"))
    return sampling.without_near_duplicates(hashed)


# --- questions, answers, evaluation -------------------------------------------------------------------------------------
_NORMAL = "array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g'), ' '), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ')"


@query(f"WITH b AS (SELECT item_id, {_NORMAL.format('text')} AS e FROM benchmark), d AS (SELECT doc_id, {_NORMAL.format('text')} AS c FROM documents) SELECT item_id, doc_id FROM b JOIN d ON contains(c, e)")
def contains_benchmark(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("expected"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    return containing(docs, items)


_LEFT, _RIGHT = (f"string_split({_NORMAL.format(c)}, ' ')" for c in ("a.text", "b.text"))


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, list_filter({_LEFT}, lambda x: x <> '') AS l, list_filter({_RIGHT}, lambda x: x <> '') AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN len(l) = 0 AND len(r) = 0 THEN 1 WHEN len(l) = 0 OR len(r) = 0 THEN 0 ELSE 2.0 * list_sum(list_transform(list_distinct(l), lambda w: least(len(list_filter(l, lambda x: x = w)), len(list_filter(r, lambda x: x = w))))) / (len(l) + len(r)) END, 6) AS f1 FROM p""")
def answer_f1(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(texts.token_f1(F.col("text"), F.col("answer")), 6).alias("f1"))


@query("SELECT count(*) AS n, avg((k % 3 = 0)::INT) AS em_baseline, avg((k % 2 = 0)::INT) AS em_governed, count_if(k % 3 <> 0 AND k % 2 = 0) AS n_fixed, count_if(k % 3 = 0 AND k % 2 <> 0) AS n_broken FROM (SELECT p_partkey AS k FROM part)")
def run_comparison(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.concat(F.lit("The "), "p_name").alias("e"), F.when(k % 3 == 0, F.upper("p_name")).otherwise("x").alias("b"), F.when(k % 2 == 0, F.concat("p_name", F.lit("!"))).otherwise("y").alias("g"))
    return evaluation.run_report(evaluation.compare_runs(rows, "e", "b", "g")).select("n", "em_baseline", "em_governed", "n_fixed", "n_broken")


_ASK = "SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'Who was CEO of X in ' || year(o_orderdate) || '?' WHEN 1 THEN 'Who owned it before ' || year(o_orderdate) WHEN 2 THEN 'When did it start' WHEN 3 THEN 'The capital since ' || year(o_orderdate) ELSE 'Tell me more' END AS q, year(o_orderdate) AS y FROM orders"


@query(f"SELECT k, CASE k % 5 WHEN 0 THEN make_timestamp(y, 6, 15, 0, 0, 0) WHEN 1 THEN make_timestamp(y - 1, 12, 31, 0, 0, 0) WHEN 2 THEN TIMESTAMP '{AT}' WHEN 3 THEN TIMESTAMP '{AT}' END AS query_time, k % 5 <> 4 AS use_facts, CASE k % 5 WHEN 0 THEN 'CEO X' WHEN 1 THEN 'owned it' WHEN 2 THEN 'start' WHEN 3 THEN 'capital' ELSE 'Tell me more' END AS search FROM ({_ASK})")
def question_routing(spark, d):
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    q = F.when(k % 5 == 0, F.concat(F.lit("Who was CEO of X in "), y, F.lit("?"))).when(k % 5 == 1, F.concat(F.lit("Who owned it before "), y)).when(k % 5 == 2, "When did it start").when(k % 5 == 3, F.concat(F.lit("The capital since "), y)).otherwise("Tell me more")
    routed = governance.route(table(spark, d, "orders").select(k.alias("k"), q.alias("query")), Vocabulary.default(), F.lit(AT).cast("timestamp"))
    return routed.select("k", F.col("query_time").cast("timestamp_ntz").alias("query_time"), "use_facts", "search")


@query("SELECT source_id, CASE WHEN disputed THEN '[DISPUTED] ' || text ELSE text END AS text FROM (SELECT 'D' || d.doc_id AS source_id, any_value(text) AS text, bool_and(o_orderkey % 3 = 0) AS dead, bool_or(o_orderkey % 7 = 0) AS disputed FROM documents d LEFT JOIN orders ON o_custkey = d.doc_id GROUP BY d.doc_id) WHERE dead IS NOT TRUE")
def governed_passages(spark, d):
    passages = table(spark, d, "documents").select(F.concat(F.lit("D"), "doc_id").alias("source_id"), "text")
    k = F.col("o_orderkey")
    status = F.when(k % 21 == 0, "both").when(k % 3 == 0, "deprecated").when(k % 7 == 0, "contested").otherwise("active")
    rows = table(spark, d, "orders").select(F.concat(F.lit("D"), "o_custkey").alias("source_id"), F.when(status == "both", F.array(F.lit("deprecated"), F.lit("contested"))).otherwise(F.array(status)).alias("s"))
    dead = rows.select("source_id", (F.array_contains("s", "deprecated")).alias("dead"), F.array_contains("s", "contested").alias("disputed"))
    marks = dead.groupBy("source_id").agg(F.bool_and("dead").alias("dead"), F.bool_or("disputed").alias("disputed"))
    evidence = marks.select("source_id", F.explode(F.when(F.col("dead"), F.array(F.lit("deprecated"))).when(F.col("disputed"), F.array(F.lit("contested"), F.lit("active"))).otherwise(F.array(F.lit("active")))).alias("status"))
    return governance.govern(passages, evidence)


@query("SELECT conv_id, turn, regexp_matches(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g') || ' ', '\\s(might|may|maybe|possibly|perhaps|uncertain|unclear|disputed|contested|however|but|although|conflicting)\\s') OR contains(lower(text), 'some sources') OR contains(lower(text), 'others say') AS uncertain FROM conversations")
def uncertain_answers(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", texts.is_uncertain(F.col("text")).alias("uncertain"))


_CLAIM_WORDS = "list_filter(regexp_extract_all(lower(claim), '[\\p{L}\\p{M}\\p{N}\\p{Pc}]+'), lambda x: length(x) > 3)"


@query("""WITH a AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(text), '([.!?])[ \\t\\n\\r]+', '\\1' || chr(10), 'g'), '\\n+'), lambda c: trim(c)), lambda c: c <> '') AS c FROM conversations WHERE role = 'assistant'),
k AS (SELECT conv_id, turn, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS claim FROM a), w AS (SELECT conv_id, turn, i, WORDS AS words FROM k),
o AS (SELECT w.conv_id, w.turn, i, coalesce(bool_or(len(words) = 0 OR len(list_filter(words, lambda x: contains(lower(u.text), x))) > 0), false) AS ok FROM w LEFT JOIN conversations u ON u.conv_id = w.conv_id AND u.role = 'user' AND u.turn < w.turn AND u.turn + 4 > w.turn GROUP BY ALL)
SELECT a.conv_id * 10000 + a.turn AS answer_id, round(coalesce(avg(ok::INT), 1), 6) AS faithfulness FROM a LEFT JOIN o USING (conv_id, turn) GROUP BY ALL""".replace("WORDS", _CLAIM_WORDS))
def answer_faithfulness(spark, d):
    """What assistants say, by the users' words of the four turns before."""
    c = table(spark, d, "conversations").withColumn("answer_id", F.col("conv_id") * 10_000 + F.col("turn"))
    said = c.where("role = 'assistant'").select("answer_id", "conv_id", F.col("text").alias("answer"), F.timestamp_seconds("turn").alias("at"))
    heard = c.where("role = 'user'").select("conv_id", "text", F.timestamp_seconds("turn").alias("validity_start"), F.timestamp_seconds(F.col("turn") + 4).alias("validity_end"))
    blank = F.lit("")
    facts = said.select("answer_id", "conv_id").join(heard, "conv_id").withColumns({"subject": blank, "predicate": blank, "object": blank, "status": F.lit("active")})
    return evaluation.faithfulness(said, facts, "answer_id", "answer", "at").withColumn("faithfulness", F.round("faithfulness", 6))


@query(f"WITH {ORDER} SELECT o_custkey, count(*) AS n_facts, count_if({HOLDS}) AS temporal_valid_count, (count_if(status = 'contested') > 0)::BIGINT AS contested_keys FROM ord GROUP BY o_custkey")
def dataset_enrichment(spark, d):
    facts = facts_order(spark, d)
    rows = facts.select("o_custkey").distinct().withColumns({"row": F.col("o_custkey"), "at": instant(AT)})
    return governance.enrich(rows, facts, ["o_custkey"], "at", "row").select(F.col("row").alias("o_custkey"), "n_facts", "temporal_valid_count", "contested_keys")


@query(f"""WITH {SHIP}, r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY id) AS rank, 'S' || source % 50 AS src FROM ship WHERE status <> 'deprecated'),
l AS (SELECT subject, predicate, string_agg('  ' || subject || ' / ' || predicate || ' → ' || object || '  (active, valid ' || strftime(validity_start, '%Y-%m-%d') || ' — ' || coalesce(strftime(validity_end, '%Y-%m-%d'), 'present') || CASE WHEN validity_known THEN '' ELSE ' · (calendar date unknown — source-date fallback)' END || ', source: ' || src || ')', chr(10) ORDER BY rank) FILTER (status = 'active') AS known,
 string_agg('    • ' || object || '  — ' || src || ': "' || substr(text, 1, 140) || '"', chr(10) ORDER BY rank) FILTER (status = 'contested') AS disputed FROM r GROUP BY ALL)
SELECT subject AS q, concat_ws(chr(10) || chr(10), 'KNOWN FACTS:' || chr(10) || known, 'DISPUTED FACTS (sources disagree — surface the disagreement):' || chr(10) || '  ' || subject || ' / ' || predicate || ':' || chr(10) || disputed) AS context FROM l""")
def context_blocks(spark, d):
    facts = with_provenance(facts_ship(spark, d).where("status <> 'deprecated'")).withColumn("rank", F.row_number().over(W.partitionBy("subject").orderBy("id")))
    return governance.context(facts.withColumn("q", F.col("subject")), ["q"])


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name ELSE p_name || ' Incorrect' END AS name, CASE p_partkey % 2 WHEN 0 THEN 'CEO' ELSE 'number of things' END AS natural_name, CASE WHEN p_size <= 20 THEN round(0.7 * 0.7 + 0.3 * p_size / 20.0, 6) ELSE 0.79 END AS coverage FROM part")
def name_functions(spark, d):
    k = F.col("p_partkey")
    name = F.concat("p_name", F.when(k % 3 == 0, "").when(k % 3 == 1, ", Inc.").otherwise(" Incorrect"))
    predicate = F.when(k % 2 == 0, "chiefExecutiveOfficer").otherwise(texts.camel_case(F.lit("Number of things")))
    return table(spark, d, "part").select("p_partkey", texts.entity_name(name).alias("name"), texts.natural_predicate(predicate).alias("natural_name"), F.round(texts.expected_coverage(F.lit("functional"), F.col("p_size")), 6).alias("coverage"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'rate_limit' WHEN regexp_matches(html, 'track\\(\\d*[05]\\)') THEN 'tracked' WHEN regexp_matches(html, '(?i)<table') THEN 'tabular' WHEN page_id % 5 = 1 THEN 'unknown_block' WHEN length(html) < 3000 THEN 'silent_empty' ELSE 'ok' END AS kind FROM pages")
def response_classes(spark, d):
    k = F.col("page_id")
    kind = texts.response_class(F.when(k % 5 == 0, 429).when(k % 5 == 1, 403).otherwise(200), F.col("html"), F.length("html") < 3000, F.lit(True), [(r"track\(\d*[05]\)", "tracked"), ("(?i)<table", "tabular")])
    return table(spark, d, "pages").select("page_id", kind.alias("kind"))


@query("""SELECT c_custkey::VARCHAR AS source_id, CASE c_custkey % 4 WHEN 0 THEN 'role_succession' WHEN 1 THEN 'entity_rename' ELSE 'functional_relation' END AS kind,
CASE c_custkey % 4 WHEN 0 THEN 'succeededBy' WHEN 1 THEN 'renamedTo' ELSE 'headquarteredIn' END AS predicate,
CASE c_custkey % 4 WHEN 0 THEN 'Ann ' || c_mktsegment ELSE 'Bolt ' || c_custkey END AS subject, CASE c_custkey % 4 WHEN 0 THEN 'Acme ' || c_nationkey WHEN 1 THEN 'Nut ' || c_custkey ELSE c_mktsegment || ' City' END AS object FROM customer WHERE c_custkey % 4 <> 3""")
def trigger_scan(spark, d):
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("Ann "), segment, F.lit(" became the new CEO of Acme "), F.col("c_nationkey"), F.lit(", they say")))
        .when(k % 4 == 1, F.concat(F.lit("Bolt "), k, F.lit(" was renamed to Nut "), k, F.lit("; nothing else")))
        .when(k % 4 == 2, F.concat(F.lit("Bolt "), k, F.lit(" is headquartered in "), segment, F.lit(" City, as known")))
        .otherwise("Nothing here")
    )
    return scan_documents(table(spark, d, "customer").select(k.alias("source_id"), text.alias("text"))).select("source_id", "kind", "predicate", "subject", "object")


# --- events -------------------------------------------------------------------------------------------------------------
@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling(spark, d):
    out = event_windows(table(spark, d, "events"), by=["event_type"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}).withColumn("total", F.round("total", 4))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof_active_count(spark, sf_dir)
