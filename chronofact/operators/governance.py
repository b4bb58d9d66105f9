"""Facts between retriever and answer: routing of questions, filtering of passages, context, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.functions.texts import keyword_query
from chronofact.functions.vocabulary import Vocabulary
from chronofact.model import KEY
from chronofact.operators.views import as_of_join


def _year(query: Column, pattern: str) -> Column:
    return F.try_to_number(F.regexp_extract(query, pattern, 1), F.lit("9999")).cast("int")


def route(questions: DataFrame, vocabulary: Vocabulary, now: Column, query: str = "query") -> DataFrame:
    """``query_time, keyword, use_facts, search`` of each question: the time that it means, the functional predicate that
    it names (the longest keyword; short ones only as whole words), and the words to search by."""
    q = F.col(query)
    low = F.lower(F.trim(q))
    in_year, before, after = (_year(q, p) for p in (r"(?i)\bin\s+(\d{4})\b", r"(?i)\b(?:before|prior to)\s+(\d{4})\b", r"(?i)\b(?:after|since)\s+(\d{4})\b"))
    utc = lambda y, month, day: F.make_timestamp(y, F.lit(month), F.lit(day), F.lit(0), F.lit(0), F.lit(0))
    time = F.when(in_year.between(1, 9999), utc(in_year, 6, 15)).when(low.rlike(r"\b(as of|when)\b"), now).when(before.isNotNull(), utc(before - 1, 12, 31)).when(after.isNotNull(), now)
    escape = lambda w: "".join(c if c.isalnum() or c == " " else "\\" + c for c in w)
    keywords = vocabulary.keywords()
    short = {w for w in keywords if len(w) <= 4}
    hits = F.array(*(F.when(low.rlike(rf"(?<![a-z0-9]){escape(w)}(?![a-z0-9])") if w in short else F.contains(low, F.lit(w)), w) for w in keywords))
    keyword = F.try_element_at(F.array_compact(hits), F.lit(1))
    return questions.withColumns({"query_time": time, "keyword": keyword}).withColumns({"use_facts": F.col("query_time").isNotNull() | F.col("keyword").isNotNull(), "search": keyword_query(q)})


def govern(passages: DataFrame, evidence: DataFrame) -> DataFrame:
    """Passages by the facts taken from them (``evidence``: source_id, status): one whose facts are all deprecated goes,
    one with a contested fact is marked, one without facts stays."""
    state = evidence.groupBy("source_id").agg(F.bool_and(F.col("status") == "deprecated").alias("__dead"), F.bool_or(F.col("status") == "contested").alias("__disputed"))
    joined = passages.join(state, "source_id", "left").where("coalesce(not __dead, true)")
    return joined.withColumn("text", F.when(F.col("__disputed"), F.concat(F.lit("[DISPUTED] "), F.col("text"))).otherwise(F.col("text"))).select(*passages.columns)


def context(hits: DataFrame, by: list[str]) -> DataFrame:
    """A block of text for each query: known facts in order of rank, then the disputed ones by subject and predicate."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    source = F.coalesce(F.try_element_at("provenance", F.lit(1))["source_id"], F.lit("?"))
    note = F.when(~F.col("validity_known"), " · (calendar date unknown — source-date fallback)").otherwise("")
    fact = F.format_string("  %s / %s → %s  (%s, valid %s — %s%s, source: %s)", "subject", "predicate", "object", "status", F.coalesce(day("validity_start"), F.lit("?")), F.coalesce(day("validity_end"), F.lit("present")), note, source)
    claim = F.format_string('    • %s  — %s: "%s"', F.col("object"), source, F.substring(F.coalesce(F.try_element_at("provenance", F.lit(1))["evidence_span"], F.lit("")), 1, 140))
    known = hits.where("status <> 'contested'").groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", fact.alias("line")))), lambda x: x["line"]), "\n").alias("known"))
    grouped = hits.where("status = 'contested'").groupBy(*by, "subject", "predicate").agg(F.min("rank").alias("rank"), F.concat_ws("\n", F.format_string("  %s / %s:", "subject", "predicate"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", claim.alias("line")))), lambda x: x["line"]), "\n")).alias("line"))
    disputed = grouped.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("disputed"))
    parts = [F.concat(F.lit("KNOWN FACTS:\n"), F.col("known")), F.concat(F.lit("DISPUTED FACTS (sources disagree — surface the disagreement):\n"), F.col("disputed"))]
    return known.join(disputed, by, "full_outer").select(*by, F.concat_ws("\n\n", *parts).alias("context"))


def audit_counts(facts: DataFrame, stale: Column) -> DataFrame:
    """One row: facts, conflicting keys, stale facts, and facts that are neither stale nor of a conflicting key."""
    keys = facts.where("status = 'contested'").select(*KEY).distinct()
    marked = facts.withColumn("__stale", stale).join(keys.withColumn("__conflict", F.lit(True)), list(KEY), "left")
    return marked.agg(F.count("*").alias("n_facts"), F.countDistinct(F.when(F.col("__conflict"), F.struct(*KEY))).alias("n_conflicts"), F.count_if("__stale").alias("n_stale"), F.count_if(~F.col("__stale") & F.col("__conflict").isNull()).alias("n_consistent"))


def enrich(rows: DataFrame, facts: DataFrame, on: list[str], at: str, row_id: str) -> DataFrame:
    """Of each dataset row: distinct facts behind it, how many hold at its time, and contested keys among them."""
    found = rows.join(facts, on).dropDuplicates([row_id, "id"])
    holds = (F.col("validity_start") <= F.col(at)) & (F.col("validity_end").isNull() | (F.col("validity_end") > F.col(at)))
    return found.groupBy(row_id).agg(F.count("*").alias("n_facts"), F.count_if(holds).alias("temporal_valid_count"), F.countDistinct(F.when(F.col("status") == "contested", F.struct(*KEY))).alias("contested_keys"))


def answerable(queries: DataFrame, facts: DataFrame, on: list[str], at: str) -> DataFrame:
    return as_of_join(facts, queries, on, at)
