"""Reads of the fact table: as-of views, lookups, and row-wise judgements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.functions.intervals import contains
from chronofact.model import KEY

VIEWS = {"active": ["active"], "active_contested": ["active", "contested"], "all": None}
FILTERABLE = ("subject", "predicate", "object", "scope", "kind", "status", "rank", "parent_id")


def as_of(facts: DataFrame, at: Column, view: str = "active", filters: dict[str, str] | None = None) -> DataFrame:
    """Facts valid at an instant, of the view's statuses, that equal the filters. All of it reaches the scan."""
    statuses = VIEWS[view]
    out = facts.where(contains(at))
    if statuses:
        out = out.where(F.col("status").isin(statuses))
    for column, value in (filters or {}).items():
        if column not in FILTERABLE:
            raise ValueError(f"can't filter by {column!r}; one of {FILTERABLE}")
        out = out.where(F.col(column) == value)
    return out


def as_of_join(facts: DataFrame, queries: DataFrame, on: Sequence[str], at: str) -> DataFrame:
    """Each query row with the facts of its key that are valid at its own instant. The key's equality keeps this a
    shuffled or broadcast join; the interval is a residual condition."""
    return queries.alias("q").join(facts.alias("f"), [F.col(f"q.{c}") == F.col(f"f.{c}") for c in on] + [contains(F.col(f"q.{at}"), "f.validity_start", "f.validity_end")])


def by_key(facts: DataFrame, subject: str, predicate: str, scope: str = "global") -> DataFrame:
    return facts.where((F.col("subject") == subject) & (F.col("predicate") == predicate) & (F.col("scope") == scope))


def candidate_keys(facts: DataFrame, subject_like: str | None = None, predicate_like: str | None = None, scope: str | None = None, limit: int = 20) -> DataFrame:
    """Distinct keys whose subject and predicate contain a text, whatever its case, in order."""
    for column, part in (("subject", subject_like), ("predicate", predicate_like)):
        if part is not None:
            facts = facts.where(F.col(column).ilike(f"%{part}%"))
    if scope is not None:
        facts = facts.where(F.col("scope") == scope)
    return facts.select(*KEY).distinct().orderBy(*KEY).limit(limit)


def among(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose id is listed."""
    return rows.join(ids.select(on).distinct(), on, "left_semi")


def not_among(rows: DataFrame, seen: DataFrame, on: str) -> DataFrame:
    """Rows whose id (or hash) isn't listed yet; one row for each."""
    return rows.join(seen.select(on).distinct(), on, "left_anti").dropDuplicates([on])


def from_source(facts: DataFrame, source_id: str) -> DataFrame:
    """Facts with any evidence from a source; no shuffle, as evidence is nested in the fact."""
    return facts.where(F.exists("provenance", lambda p: p["source_id"] == source_id))


def evidence(facts: DataFrame) -> DataFrame:
    """A row for each piece of evidence."""
    return facts.select(F.col("id"), *KEY, "status", F.explode("provenance").alias("p")).select("id", *KEY, "status", "p.*")


def evidence_span(facts: DataFrame) -> DataFrame:
    """Each fact with its earliest and latest evidence."""
    times = F.transform("provenance", lambda p: p["created_at"])
    return facts.withColumns({"first_seen": F.array_min(times), "last_seen": F.array_max(times)})


def is_stale(at: Column, days: int | None = 180) -> Column:
    """Whether an open fact's newest evidence is older than ``days``; of None, whether it is open and has evidence."""
    last = F.array_max(F.transform("provenance", lambda p: p["created_at"]))
    open_ = F.col("validity_end").isNull() & (F.size("provenance") > 0)
    return open_ if days is None else F.coalesce(open_ & (at - last > F.make_dt_interval(F.lit(days))), F.lit(False))


def freshness(facts: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """By key: its newest first evidence, its age in seconds, and whether that is within ``days``."""
    newest = facts.groupBy(*KEY).agg(F.max(F.try_element_at("provenance", F.lit(1))["created_at"]).alias("latest"))
    age = F.timestamp_diff("SECOND", F.col("latest"), now)
    return newest.withColumns({"age_seconds": age, "fresh": F.coalesce(age <= days * 86400, F.lit(False))})


def gate(extractions: DataFrame, accept: float = 0.85, review: float = 0.6, confidence: str = "confidence") -> DataFrame:
    """``decision``: accepted, deferred for review, or rejected."""
    if not review <= accept:
        raise ValueError("review can't be over accept")
    c = F.col(confidence)
    return extractions.withColumn("decision", F.when(c >= accept, "accepted").when(c >= review, "deferred").otherwise("rejected"))


def direction(triples: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``direction``: ok, flip (the entity types fit the other way round) or reject. Types that are null on either side
    and predicates without expectations are ok."""
    dim = F.broadcast(vocabulary.select(F.col("alias").alias("__alias"), "subject_types", "object_types"))
    joined = triples.join(dim, F.lower("predicate") == F.col("__alias"), "left")
    fits = lambda side, value: (F.size(side) == 0) | F.array_contains(side, F.col(value))
    unknown = F.col("subject_types").isNull() | F.col("subject_type").isNull() | F.col("object_type").isNull()
    verdict = F.when(unknown | (fits("subject_types", "subject_type") & fits("object_types", "object_type")), "ok").when(fits("subject_types", "object_type") & fits("object_types", "subject_type"), "flip").otherwise("reject")
    return joined.withColumn("direction", verdict).select(*triples.columns, "direction")


def flipped(triples: DataFrame) -> DataFrame:
    """Applies ``direction``: rejected rows go, flipped ones swap subject and object."""
    swap = F.col("direction") == "flip"
    pairs = [("subject", "object"), ("object", "subject"), ("subject_type", "object_type"), ("object_type", "subject_type")]
    return triples.where("direction <> 'reject'").withColumns({a: F.when(swap, F.col(b)).otherwise(F.col(a)) for a, b in pairs if a in triples.columns}).drop("direction")


def join_eligible(facts: DataFrame, at: Column | None = None) -> DataFrame:
    live = facts.where("status <> 'deprecated'")
    return live if at is None else live.where(contains(at))


def payload(facts: DataFrame) -> DataFrame:
    """The flat record that retrievers hand out; an open end reads ``ongoing``."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return facts.select("id", *KEY, "object", "status", day("validity_start").alias("valid_from"), F.coalesce(day("validity_end"), F.lit("ongoing")).alias("valid_until"))
