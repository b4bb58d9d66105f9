"""A fact store in a folder: ingest, retrieval, chains, questions, audits and the whole way from documents to a report.

Tables are Parquet folders, a version for each change; the last complete one counts, so a change that breaks off leaves
the store as it was. All methods that read give lazy DataFrames.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.durable import saved
from chronofact.functions.extraction import CACHED, Extractor, cached_extract, extract, extract_apart, probed, scan_documents, trigger_extractor
from chronofact.functions.intervals import contains
from chronofact.functions.texts import alias_key, object_problem, script_language
from chronofact.functions.vocabulary import FUNCTIONAL, Predicate, Vocabulary, canonicalize
from chronofact.model import DOCUMENTS, FACTS, KEY, PASSAGES, fact_id
from chronofact.operators import catalog, chains, conflicts, governance, reports, sampling, search, views
from chronofact.operators import seeds as choice
from chronofact.operators.block_index import MERGE, BlockIndex
from chronofact.operators.vector_index import VectorIndex

#: Start of facts from documents without a date; their ``source_type`` is placeholder.
UNDATED = "1900-01-01"
TABLES = {"facts": FACTS + ", evidence int, ingest_seq long", "incoming": FACTS + ", evidence int, ingest_seq long", "passages": PASSAGES, "vectors": "id string, vector array<double>", "failures": "source_id string, error string, failed_at timestamp", "extractions": CACHED + ", last_used timestamp"}
#: Texts whose extractions the just-in-time cache keeps.
CACHED_TEXTS = 10_000


@dataclass
class FactStore:
    spark: SparkSession
    path: str
    vocabulary: Vocabulary = field(default_factory=Vocabulary.default)

    # --- tables ---------------------------------------------------------------------------------------------------------
    def _versions(self, name: str, complete: bool = True) -> list[int]:
        """Numbers of a table's versions; with those that were begun and not finished unless ``complete``."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        done = [s.getPath() for s in fs.listStatus(folder) if not complete or fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(m[1]) for p in done if (m := re.fullmatch(r"v(\d+)", p.getName())))

    def _table(self, name: str, version: int | None = None) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/v{versions[-1] if version is None else version}")

    def _commit(self, name: str, rows: DataFrame) -> None:
        version = (self._versions(name, complete=False) or [0])[-1] + 1
        rows.write.mode("error").parquet(f"{self.path}/{name}/v{version}")  # of two writers at once the second fails

    def vacuum(self, keep: int = 2) -> int:
        """Deletes versions older than the last ``keep`` complete ones, and broken ones before them; how many."""
        jvm, gone = self.spark.sparkContext._jvm, 0
        for name in TABLES:
            done = self._versions(name)
            for v in self._versions(name, complete=False) if done else []:
                if v < done[-min(max(1, keep), len(done))]:
                    path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/v{v}")
                    gone += bool(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
        return gone

    @property
    def facts(self) -> DataFrame:
        return self._table("facts")

    @property
    def passages(self) -> DataFrame:
        return self._table("passages")

    @property
    def vectors(self) -> DataFrame:
        return self._table("vectors")

    def index(self) -> BlockIndex:
        """The blocks of the facts' texts and names, kept beside the facts: when they are first asked for after a change, a
        segment is added of the facts that came and went since; all is merged into one when segments are many or the version
        that they were made from is gone."""
        index = BlockIndex(self.spark, f"{self.path}/blocks", "string")
        versions = self._versions("facts")
        now, known = str(versions[-1]) if versions else "", index.label()
        if now == known or not versions:
            return index
        words = F.concat_ws(" ", "text", "subject", "object")
        texts = lambda facts: facts.select("id", words.alias("text"))
        if known is None or int(known) not in versions or len(index.segments()) >= MERGE:
            return index.rebuilt(texts(self.facts), now)
        old, new = texts(self._table("facts", int(known))), texts(self.facts)
        came = saved(new.join(old, ["id", "text"], "left_anti"))
        went = saved(old.join(new, ["id", "text"], "left_anti"))
        return index.change(came, went if went.limit(1).count() else None, now)

    def vector_index(self, metric: str = "dot", cells: int | None = None) -> VectorIndex:
        """An inverted file of the store's vectors, kept beside them: made when it is first asked for after a change."""
        version = (self._versions("vectors") or [0])[-1]
        path = f"{self.path}/vector_index_{metric}/v{version}"
        marker = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/cells/_SUCCESS")
        if marker.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
            return VectorIndex.open(self.spark, path)
        return VectorIndex.build(self.vectors, path, metric, cells)

    def put_vectors(self, vectors: DataFrame) -> None:
        """Adds vectors (id, vector) of facts, replacing those of ids that it has."""
        new = vectors.select(F.col("id").cast("string"), F.col("vector").cast("array<double>")).withColumn("put", F.lit(0))
        self._commit("vectors", catalog.upsert(self.vectors.withColumn("put", F.lit(0)), new, ["id"], "put").drop("put"))

    def delete_vectors(self, ids: DataFrame) -> None:
        self._commit("vectors", self.vectors.join(ids.select("id").distinct(), "id", "left_anti"))

    # --- ingest ---------------------------------------------------------------------------------------------------------
    def candidates(self, docs: DataFrame, extractor: Extractor = trigger_extractor, accept: float = 0.0, tagger: Tagger | None = None, similar: float | None = None, extracted: DataFrame | None = None) -> DataFrame:
        """Facts of documents before they meet others: extracted, canonical, dated, turned round or dropped where a
        ``tagger`` says that the entities' types fit so or not at all, names unified with known ones (by string
        similarity too with ``similar``), objects checked. ``ingest_seq`` is the order of source date, source and place
        in it. No step needs more than a row, but for names, a shuffle of distinct mentions, and the order. What was
        ``extracted`` already is not extracted again."""
        found = canonicalize(extract(docs, extractor) if extracted is None else extracted, self.vocabulary).where(object_problem(F.col("object")).isNull())
        if accept:
            found = views.gate(found, accept, min(accept, 0.6), "extraction_confidence").where("decision = 'accepted'").drop("decision")
        none = lambda kind: F.lit(None).cast(kind)
        if tagger is not None:
            found = views.flipped(views.direction(_typed(found, tagger), self.vocabulary.dimension(self.spark)))
        else:
            found = found.withColumns({"subject_type": none("string"), "object_type": none("string")})
        names = self.facts.select(F.explode(F.array("subject", "object")).alias("mention"), F.lit(0).cast("long").alias("ingest_seq"))
        mentions = found.select(F.explode(F.array("subject", "object")).alias("mention"), F.lit(1).cast("long").alias("ingest_seq"))
        aliases = conflicts.resolve_aliases(names.unionByName(mentions), similar=similar).where(alias_key(F.col("mention")) != "").select("mention", "canonical")
        for column in ("subject", "object"):
            found = found.join(aliases.select(F.col("mention").alias(column), F.col("canonical").alias(f"__{column}")), column, "left").withColumn(column, F.coalesce(f"__{column}", column)).drop(f"__{column}")
        span = F.struct("source_id", "evidence_span", none("int").alias("char_start"), none("int").alias("char_end"), F.current_timestamp().alias("created_at"))
        rows = found.withColumns({
            "kind": F.lit("semantic_fact"), "text": F.col("evidence_span"), "scope": F.lit("global"), "source_type": F.when(F.col("validity_start").isNull(), "placeholder").otherwise("document"),
            "status": F.lit("active"), "rank": F.lit("normal"), "parent_id": none("string"), "provenance": F.array(span), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp(), "evidence": F.lit(1),
        })
        rows = arrived(rows)
        rows = rows.withColumn("validity_start", F.coalesce("validity_start", F.lit(UNDATED).cast("timestamp")))
        return rows.withColumn("id", fact_id()).selectExpr(*(c.split()[0] for c in re.sub(r"array<.*>", "x", TABLES["facts"]).split(", ")))

    def extracted_once(self, docs: DataFrame, extractor: Extractor, extractor_id: str, size: int = CACHED_TEXTS) -> DataFrame:
        """``extract`` by way of the store's table ``extractions``: the extractor is called for texts alone that it hasn't seen
        under this id, whatever document they come from; the ``size`` texts used last are kept for the next call."""
        cache, now = self._table("extractions"), F.current_timestamp()
        docs = saved(docs.select("source_id", "text", "source_date"))
        found, fresh = cached_extract(docs, cache.drop("last_used"), extractor_id, extractor, tolerant=True)
        used = docs.where("text is not null").select(catalog.cache_key(F.col("text"), extractor_id).alias("cache_key"), now.alias("now")).distinct()
        rows = cache.join(used, "cache_key", "left").withColumn("last_used", F.coalesce("now", "last_used")).drop("now").unionByName(fresh.withColumn("last_used", now))
        kept = catalog.trimmed_cache(rows.groupBy("cache_key").agg(F.max("last_used").alias("last_used")), size)
        self._commit("extractions", rows.join(kept.select("cache_key"), "cache_key", "left_semi"))
        return found

    @property
    def failures(self) -> DataFrame:
        """Documents whose last extraction raised, and what."""
        return self._table("failures")

    def ingest(self, docs: DataFrame, extractor: Extractor = trigger_extractor, accept: float = 0.0, dedup: float | None = 0.85, judge: Callable | None = None, encoder: Callable | None = None, cosine: float = 0.92, merge_evidence: bool = False, **options) -> dict[str, int]:
        """Writes the documents' passages and facts; ``added`` facts, ``contested`` ones in all, and ``failed`` documents. Only
        keys that the documents touch are folded; all other facts are copied as they are.

        Duplicates are like objects by character grams (``dedup``), or by the vectors of an ``encoder`` of objects and a
        ``cosine``; a ``judge`` settles pairs of single pieces of evidence that are contested (see
        ``resolve_conflicts``). A text on which the extractor raises is kept as a failure until it is ingested again; the
        others' facts are not lost with it.
        """
        stamped = docs.select("source_id", "text", "uri", F.current_timestamp().alias("retrieved_at"), F.lit(None).cast("string").alias("meta_json"))
        self._commit("passages", catalog.upsert(self.passages, stamped, ["source_id"], "retrieved_at"))
        # written before it is used, as what an extractor gives may differ from call to call
        extracted, failed, counts = extract_apart(docs, extractor)
        if counts["failed"] or self._versions("failures"):
            past = self.failures.join(docs.select("source_id").distinct(), "source_id", "left_anti")
            self._commit("failures", past.unionByName(failed.withColumn("failed_at", F.current_timestamp())))
        self._commit("incoming", catalog.latest(self.candidates(docs, extractor, accept, extracted=extracted, **options), ["id"], [F.col("ingest_seq")]))
        old, new = self.facts, self._table("incoming")
        new = new.join(old.select("id"), "id", "left_anti")
        keys = new.select(*KEY).distinct()
        touched = old.join(keys, list(KEY), "left_semi").withColumn("settled", F.lit(True)).unionByName(new.withColumn("settled", F.lit(False)))
        folded = conflicts.resolve_conflicts(touched, self.vocabulary, dedup, judge, merge_evidence, encoder, cosine).drop("settled")
        before = old.count()
        self._commit("facts", old.join(keys, list(KEY), "left_anti").unionByName(folded))
        now = self.facts
        added = now.count() - before
        return {"added": added, "contested": now.where("status = 'contested'").count(), "failed": counts["failed"]}

    def resolve(self, subject: str, predicate: str, winner: str | None, scope: str = "global") -> dict[str, int]:
        """A person's decision about a contested key: the fact with the id ``winner`` is right, or none is. How many facts of the
        key are active and deprecated afterwards. KeyError if the key has no such fact."""
        name = self.vocabulary.canonical(predicate)
        own = views.by_key(self.facts, subject, name, scope)
        if not own.where(F.col("id") == winner if winner is not None else F.lit(True)).limit(1).count():
            raise KeyError(winner or subject)
        decided = self.spark.createDataFrame([(subject, name, scope, "all_wrong" if winner is None else "winner", winner)], "subject string, predicate string, scope string, action string, winner_id string")
        self._commit("facts", catalog.resolve(self.facts, decided))
        counts = {r["status"]: r["n"] for r in views.by_key(self.facts, subject, name, scope).groupBy("status").agg(F.count("*").alias("n")).collect()}
        return {"active": counts.get("active", 0), "deprecated": counts.get("deprecated", 0)}

    # --- reads ----------------------------------------------------------------------------------------------------------
    def retrieve(self, queries: DataFrame, at: Column, view: str = "active", filters: dict[str, str] | None = None, top_k: int = 20, vectors: DataFrame | VectorIndex | None = None) -> DataFrame:
        """Facts with ``query_id, score, rank`` and their rank in either list (the facts' own is ``fact_rank``). ``queries``:
        query_id, query and, for dense search among the store's vectors (or others, or an index of them), vector."""
        facts, vectors = self.facts, self.vectors if vectors is None else vectors
        return search.hybrid(views.as_of(facts, at, view, filters).withColumnRenamed("rank", "fact_rank"), self.index(), None, queries, vectors, top_k=top_k)

    def succession(self, subject: str, predicate: str, scope: str = "global", at: Column | None = None, **options) -> DataFrame:
        return chains.succession(views.by_key(self.facts, subject, self.vocabulary.canonical(predicate), scope), at, **options)

    def renames(self, subject: str, at: Column | None = None, **options) -> DataFrame:
        start = self.spark.createDataFrame([(subject,)], "start string")
        return chains.unambiguous(chains.rename_walk(self.facts, start, self.vocabulary.renaming(strict=True), at, **options))

    def joined(self, subject: str, predicates: list[str], at: Column | None = None, scope: str = "global", resolver: chains.Resolver | None = None) -> DataFrame:
        start = self.spark.createDataFrame([(subject, scope)], "start string, scope string")
        return chains.unambiguous(chains.join_chain(self.facts, start, [self.vocabulary.canonical(p) for p in predicates], at, resolver=resolver)).drop("ambiguous")

    def _known(self, questions: DataFrame, now: Column, top_k: int) -> DataFrame:
        """The store's facts for each question (query_id, query) that asks for facts, as of the time it means, ranked."""
        routed = governance.route(questions, self.vocabulary, now).where("use_facts")
        facts = self.facts
        asked = routed.select("query_id", F.col("search").alias("query"), F.coalesce("query_time", now).alias("at"))
        found = self.index().bm25(asked, top_k=None).select("query_id", "id", "score")
        # hits are few against all facts, so time is a condition on hits and not a join of all facts with all questions
        live = found.join(facts.drop("rank"), "id").join(asked.select("query_id", "at"), "query_id").where(contains(F.col("at")) & (F.col("status") != "deprecated"))
        return search.ranked(live, top_k)

    def answer_context(self, questions: DataFrame, now: Column, top_k: int = 10) -> DataFrame:
        """A block of context for each question (query_id, query) that asks for facts, as of the time it means."""
        return governance.context(self._known(questions, now, top_k), ["query_id"])

    def answered(self, questions: DataFrame, hits: DataFrame, now: Column, top_k: int = 10, extractor: Extractor = trigger_extractor, fresh_days: int | None = None, fallback: Callable[[DataFrame], DataFrame] | None = None, extractor_id: str | None = None) -> DataFrame:
        """``query_id, mode, context`` of every question. ``hits``: query_id, source_id, text, source_date and rank of the
        passages that another retriever found.

        Questions that ask for facts get those of the store (``facts``); where it has none, facts taken from the passages
        just now (``just_in_time``). With ``fresh_days`` a question's facts are fresh if the youngest evidence for the key
        of its best fact is; facts that are not get those of the passages added (``refreshed``), or stay alone
        (``stale_facts``). ``fallback`` gives more passages for questions without fresh facts (query_id, query), such as
        ``TableCorpus.hits``. All other questions, and those without any fact, get the passages (``passages``), the best
        first. A text on which the extractor raises gives none. With an ``extractor_id``, passages that were extracted for
        an earlier answer are not again (``extracted_once``).
        """
        columns = ["query_id", "rank", "subject", "predicate", "scope", "object", "status", "validity_start", "validity_end", "validity_known", "provenance"]
        known = saved(self._known(questions, now, top_k).select(*columns))
        asked = governance.route(questions, self.vocabulary, now).where("use_facts").select("query_id", F.coalesce("query_time", now).alias("at"))
        fresh = known.select("query_id").distinct()
        if fresh_days is not None:
            young = views.freshness(self.facts, now, fresh_days).where("fresh").select(*KEY)
            fresh = known.where("rank = 1").join(young, list(KEY)).select("query_id")
        wanted = saved(asked.join(fresh, "query_id", "left_anti"))
        given = ["query_id", "source_id", "text", "source_date", "rank"]
        passages = hits.select(*given)
        if fallback is not None:
            passages = passages.unionByName(fallback(questions.join(wanted.select("query_id"), "query_id", "left_semi").select("query_id", "query")).select(*given))
        passages = passages.join(wanted, "query_id")
        docs = passages.select("source_id", "text", "source_date").dropDuplicates(["source_id"])
        found = canonicalize(self.extracted_once(docs, extractor, extractor_id) if extractor_id else extract_apart(docs, extractor)[0], self.vocabulary).where(object_problem(F.col("object")).isNull())
        now_facts = passages.select("query_id", "source_id", "rank", "at").join(found, "source_id").where(contains(F.col("at"), F.coalesce("validity_start", F.lit(UNDATED).cast("timestamp"))))
        now_facts = now_facts.withColumns({"status": F.lit("active"), "scope": F.lit("global"), "rank": F.col("rank") + top_k, "provenance": F.array(F.struct("source_id", "evidence_span"))})
        plain = F.transform("provenance", lambda p: F.struct(p["source_id"].alias("source_id"), p["evidence_span"].alias("evidence_span"))).alias("provenance")
        told = saved(known.select(*columns[:-1], plain, F.lit(True).alias("held")).unionByName(now_facts.select(*columns, F.lit(False).alias("held"))))
        stale = wanted.select("query_id", F.lit(True).alias("stale"))
        kinds = told.groupBy("query_id").agg(F.bool_or("held").alias("old"), F.bool_or(~F.col("held")).alias("new")).join(stale, "query_id", "left")
        mode = F.when(F.col("old") & F.col("new"), "refreshed").when(F.col("new"), "just_in_time").when(F.col("stale"), "stale_facts").otherwise("facts")
        both = governance.context(told, ["query_id"]).join(kinds.select("query_id", mode.alias("mode")), "query_id")
        line = F.concat(F.lit("["), F.col("source_id"), F.lit("] "), F.col("text"))
        rest = hits.join(both, "query_id", "left_anti").where(F.col("rank") <= top_k).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("context"))
        return questions.select("query_id").join(both.unionByName(rest.withColumn("mode", F.lit("passages"))), "query_id", "left").select("query_id", "mode", "context")

    def stats(self) -> dict:
        return reports.store_stats(self.facts, self.vocabulary.renaming()).first().asDict()

    def changed_since(self, version: int) -> DataFrame:
        return catalog.snapshot_diff(self._table("facts", version), self.facts)


Tagger = Callable[[str], list[tuple[str, str]]]


def _typed(triples: DataFrame, tagger: Tagger) -> DataFrame:
    """``triples`` with the types of subject and object; each distinct mention is tagged once. Types that the tagger can't
    tell are null."""
    mentions = triples.select(F.explode(F.array("subject", "object")).alias("mention")).distinct()
    types = probed(mentions, tagger).withColumn("entity_type", F.when(~F.col("entity_type").isin("NONE", "UNAVAILABLE"), F.upper("entity_type")))
    for column in ("subject", "object"):
        triples = triples.join(types.select(F.col("mention").alias(column), F.col("entity_type").alias(f"{column}_type")), column, "left")
    return triples


def arrived(rows: DataFrame) -> DataFrame:
    """``rows`` with ``ingest_seq``: numbers that rise with source date, source and position; undated sources come first.
    Rows are dealt by range, so no task sorts them all."""
    ordered = rows.repartitionByRange("source_date", "source_id", "position").sortWithinPartitions("source_date", "source_id", "position")
    return ordered.withColumn("ingest_seq", F.monotonically_increasing_id())


def audit(passages: DataFrame, vocabulary: Vocabulary, at: Column, stale_days: int | None = 180, extractor: Extractor = trigger_extractor) -> DataFrame:
    """Counts of conflicts and stale facts in passages (source_id, text, source_date) without any store: facts are folded
    as they come, equal ones not taken for duplicates."""
    found = arrived(canonicalize(extract(passages, extractor), vocabulary))
    facts = found.withColumns({"scope": F.lit("global"), "status": F.lit("active"), "evidence": F.lit(1), "validity_start": F.coalesce("validity_start", F.lit(UNDATED).cast("timestamp")), "provenance": F.array(F.struct("source_id", "evidence_span", F.coalesce("validity_start", at).alias("created_at")))})
    facts = facts.withColumn("id", F.concat_ws("#", "source_id", "position"))
    return governance.audit_counts(conflicts.resolve_conflicts(facts, vocabulary, dedup=None), views.is_stale(at, stale_days))


def scan_corpus(docs: DataFrame, vocabulary: Vocabulary, size: int = 500, by: str = "composite", seed: int = 0, distance: int | None = 3) -> DataFrame:
    """The fast scan of a stratified sample of documents without near duplicates, one row."""
    sample = saved(sampling.stratified(sampling.strata(docs, by), size, seed, distance=distance).select("source_id", "text"))
    return reports.fast_scan(sample, scan_documents(sample), vocabulary.dimension(docs.sparkSession))


def auto(store: FactStore, docs: DataFrame, sample: int = 500, extractor: Extractor = trigger_extractor, min_frequency: int = 3, seeds: int = 50, second: Extractor | None = None) -> dict:
    """From documents to a store: discovers predicates on a sample, takes them up, ingests all, finds the questions most
    worth asking, and reports. With a ``second`` extractor (a dearer one), the documents that these questions find are
    ingested once more by it."""
    some = sampling.stratified(sampling.strata(docs, "composite"), sample)
    facts = extract(some, extractor)
    proposals = reports.discover_predicates(facts, store.vocabulary.dimension(store.spark), min_frequency).collect()  # as few as predicates are
    store.vocabulary = store.vocabulary.merged([Predicate(r["name"], r["cardinality"], tuple(filter(None, r["aliases"].split(", ")))) for r in proposals])
    counts = store.ingest(docs, extractor)
    functional = [p.name for p in store.vocabulary.predicates.values() if p.cardinality == FUNCTIONAL]
    asked = seed_questions(store.facts, functional, store.vocabulary.renaming(strict=True), seeds, min_frequency).collect()  # seeds of them at most
    again = None
    if second is not None and asked:
        queries = store.spark.createDataFrame([(i, r["query"]) for i, r in enumerate(asked)], "query_id long, query string")
        index = search.postings(docs, "source_id", "text", search.plain_terms)
        hits = search.any_term(index, search.statistics(docs, "text", search.plain_terms), queries, 5).select(F.col("id").alias("source_id")).distinct()
        again = store.ingest(docs.join(hits, "source_id", "left_semi"), second)
    scan = reports.drift_and_conflict(store.facts, functional, store.vocabulary.renaming()).first().asDict()
    return {"ingest": counts, "predicates": [r.asDict() for r in proposals], "seeds": [r.asDict() for r in asked], "second": again, "scan": scan, "stats": store.stats()}


def seeds_of(docs: DataFrame, vocabulary: Vocabulary, sample: int = 500, budget: int = 50, min_frequency: int = 3, extractor: Extractor = trigger_extractor) -> DataFrame:
    """Questions worth asking about documents that are in no store yet: from the facts of a stratified sample of them, folded
    as they come, so that disputed keys are known."""
    some = sampling.stratified(sampling.strata(docs, "composite"), sample)
    found = arrived(canonicalize(extract(some, extractor), vocabulary).where(object_problem(F.col("object")).isNull()))
    start = F.coalesce("validity_start", F.lit(UNDATED).cast("timestamp"))
    facts = found.withColumns({"scope": F.lit("global"), "status": F.lit("active"), "evidence": F.lit(1), "validity_start": start, "text": F.col("evidence_span"), "id": F.concat_ws("#", "source_id", "position")})
    functional = [p.name for p in vocabulary.predicates.values() if p.cardinality == FUNCTIONAL]
    return seed_questions(saved(conflicts.resolve_conflicts(facts, vocabulary, dedup=None)), functional, vocabulary.renaming(strict=True), budget, min_frequency)


def seed_questions(facts: DataFrame, functional: list[str], renaming: list[str], budget: int = 50, min_frequency: int = 3) -> DataFrame:
    """Questions about a store's facts, ``budget`` of them: of great expected coverage and far from each other, by the TF-IDF
    vectors of their character grams; in the order of the choice."""
    spark = facts.sparkSession
    mentions = facts.select(F.explode(F.array("subject", "object")).alias("entity"), "predicate", script_language(F.col("text")).alias("lang"))
    entities = reports.seed_entities(mentions, budget, min_frequency)
    some = spark.createDataFrame([(p,) for p in functional], "predicate string").join(facts.select("predicate").distinct(), "predicate", "left_semi")
    renamed = facts.where(F.col("predicate").isin(renaming)).groupBy(F.col("subject").alias("entity")).agg(F.count("*").alias("n"))
    disputed = facts.where("status = 'contested'").groupBy(F.col("subject").alias("entity"), "predicate").agg(F.count("*").alias("n"))
    asked = reports.seed_queries(entities.select("entity", "n", "rank"), some, renamed, disputed)
    asked = saved(asked)
    vectors = choice.Encoder.fit(asked, "query").vectors(asked, "query", "query")
    chosen = choice.diverse(asked.select(F.col("query").alias("id"), F.col("coverage").alias("quality")), vectors, budget)
    return asked.join(F.broadcast(chosen.withColumnRenamed("id", "query")), "query").orderBy("place").drop("place")  # budget rows


def to_markdown(title: str, rows: list[dict]) -> str:
    """A small report as a table."""
    names = list(rows[0]) if rows else []
    line = lambda values: "| " + " | ".join(str(v).replace("|", "\\|") for v in values) + " |"
    body = [line(names), line(["---"] * len(names)), *(line(r.values()) for r in rows)] if rows else ["Nothing found."]
    return "\n".join([f"# {title}", "", *body, ""])


def documents_of(store: FactStore) -> DataFrame:
    return store.passages.select("source_id", "text", "uri", F.lit(None).cast("timestamp").alias("source_date")).selectExpr(*(c.split()[0] for c in DOCUMENTS.split(", ")))
