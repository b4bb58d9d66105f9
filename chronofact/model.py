"""Schema of facts, passages and documents, and the content hash that names a fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES, RANKS, SCOPES = ("active", "deprecated", "contested"), ("preferred", "normal", "deprecated"), ("global", "user", "group")
KEY = ("subject", "predicate", "scope")
PROVENANCE = "array<struct<source_id:string,evidence_span:string,char_start:int,char_end:int,created_at:timestamp>>"
FACTS = (
    "id string, kind string, subject string, predicate string, object string, text string, subject_type string, object_type string, "
    "validity_start timestamp, validity_end timestamp, scope string, source_type string, validity_known boolean, status string, rank string, "
    f"confidence double, extraction_confidence double, parent_id string, provenance {PROVENANCE}, created_at timestamp, updated_at timestamp"
)
DOCUMENTS = "source_id string, text string, uri string, source_date timestamp"
PASSAGES = "source_id string, text string, uri string, retrieved_at timestamp, meta_json string"


def iso(ts: Column) -> Column:
    """A UTC instant as text with ``+00:00``, microseconds only where there are any; the unknown one is year 1."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(ts, ".SSSSSS")
    return F.coalesce(F.concat(whole, F.when(part == ".000000", "").otherwise(part), F.lit("+00:00")), F.lit("0001-01-01T00:00:00+00:00"))


def short_hash(content: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def fact_id(subject: str = "subject", predicate: str = "predicate", object_: str = "object", start: str = "validity_start", scope: str = "scope") -> Column:
    """A fact's name: a hash of what it says and from when on; its end, status and sources don't change it."""
    return short_hash(F.concat_ws("|", F.col(subject), F.col(predicate), F.col(object_), iso(F.col(start)), F.col(scope)))


def valid_facts(facts: DataFrame) -> DataFrame:
    """Rows that may be stored: texts that aren't empty, known status, rank and scope, confidence within 0 to 1, and an
    end after the start."""
    texts = [F.coalesce(F.length(c) > 0, F.lit(False)) for c in ("subject", "predicate", "object", "text")]
    rules = [*texts, F.col("status").isin(*STATUSES), F.col("rank").isin(*RANKS), F.col("scope").isin(*SCOPES), F.col("confidence").between(0, 1), F.col("validity_end").isNull() | (F.col("validity_end") > F.col("validity_start"))]
    for rule in rules:
        facts = facts.where(rule)
    return facts
