"""Scores of answers: exact match and F1, faithfulness in time, openness about conflicts, completeness of chains."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofact.functions.intervals import contains
from chronofact.functions.texts import claim_words, claims, contains_expected, exact_match, is_uncertain, token_f1


def compare_runs(rows: DataFrame, expected: str, baseline: str, governed: str) -> DataFrame:
    """``rows`` with em and f1 of both runs, and whether the governed one fixed or broke an answer."""
    e, b, g = (F.col(c) for c in (expected, baseline, governed))
    scored = rows.withColumns({"em_baseline": exact_match(b, e), "em_governed": exact_match(g, e), "f1_baseline": token_f1(b, e), "f1_governed": token_f1(g, e)})
    return scored.withColumns({"fixed": ~F.col("em_baseline") & F.col("em_governed"), "broken": F.col("em_baseline") & ~F.col("em_governed")})


def run_report(scored: DataFrame) -> DataFrame:
    mean = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return scored.agg(F.count("*").alias("n"), mean("em_baseline"), mean("em_governed"), mean("f1_baseline"), mean("f1_governed"), F.count_if("fixed").alias("n_fixed"), F.count_if("broken").alias("n_broken"))


def oracle_answer(context: Column, expected: Column) -> Column:
    """The expected answer if the context has it."""
    return F.when(contains_expected(context, expected), expected).otherwise("")


def entailed(entails: Callable[[list[str], list[str]], list[bool]], premise: Column, claim: Column) -> Column:
    """Whether each premise entails its claim, by any model of pairs of texts, a batch at a time."""

    @F.arrow_udf("boolean")
    def judged(premises: pa.Array, claimed: pa.Array) -> pa.Array:
        return pa.array(list(map(bool, entails(premises.to_pylist(), claimed.to_pylist()))) if len(claimed) else [], pa.bool_())

    return judged(F.coalesce(premise, F.lit("")), F.coalesce(claim, F.lit("")))


def answered_by(answerer: Callable[[list[str], list[str]], list[str]], query: Column, context: Column) -> Column:
    """Answers of any model to queries with their contexts, a batch at a time."""

    @F.arrow_udf("string")
    def answers(queries: pa.Array, contexts: pa.Array) -> pa.Array:
        return pa.array(list(answerer(queries.to_pylist(), contexts.to_pylist())) if len(queries) else [], pa.string())

    return answers(query, F.coalesce(context, F.lit("")))


def faithfulness(answers: DataFrame, facts: DataFrame, row_id: str, answer: str, at: str | None = None, entails: Callable[[list[str], list[str]], list[bool]] | None = None) -> DataFrame:
    """Share of an answer's claims that a fact supports which holds at the answer's time: ``facts`` has the row's id. A
    fact supports a claim if it has any of the claim's words of over three letters, or if ``entails`` says so; a claim
    without such words is supported by any. An answer without claims scores 1."""
    asked = answers.select(row_id, *([at] if at else []), F.posexplode_outer(claims(F.col(answer))).alias("__i", "__claim"))
    hay = F.lower(F.concat_ws(" ", "subject", "predicate", "object", "text"))
    usable = facts.where("status <> 'deprecated'").select(row_id, hay.alias("__hay"), "validity_start", "validity_end")
    words = claim_words(F.col("__claim"))
    supports = (F.size(words) == 0) | F.exists(words, lambda w: F.contains(F.col("__hay"), w))
    if entails is not None:
        supports = entailed(entails, F.col("__hay"), F.col("__claim"))
    holds = F.lit(True) if at is None else F.col(at).isNull() | contains(F.col(at))
    per_claim = asked.join(usable, row_id, "left").groupBy(row_id, "__i").agg(F.bool_or(F.coalesce(supports & holds & F.col("__hay").isNotNull(), F.lit(False))).alias("ok"))
    return per_claim.groupBy(row_id).agg(F.when(F.count("__i") == 0, 1.0).otherwise(F.count_if(F.col("ok") & F.col("__i").isNotNull()) / F.count("__i")).alias("faithfulness"))


def transparency(answer: Column, has_contested: Column) -> Column:
    return F.when(~has_contested | is_uncertain(answer), 1.0).otherwise(0.0)


def chain_completeness(answers: DataFrame, facts: DataFrame, row_id: str, answer: str) -> DataFrame:
    """Share of neighbouring objects named in an answer that are neighbours in the chain of the row's largest group of
    facts (ties by name); 1 where either side has fewer than two."""
    text = F.lower(answer)
    grouped = facts.withColumn("__n", F.count("*").over(W.partitionBy(row_id, "subject", "predicate")))
    best = grouped.withColumn("__best", F.dense_rank().over(W.partitionBy(row_id).orderBy(F.col("__n").desc(), "subject", "predicate"))).where("__best = 1")
    nxt = F.lead("object").over(W.partitionBy(row_id).orderBy("validity_start", "id"))
    expected = best.withColumn("nxt", nxt).where("nxt is not null").select(row_id, F.col("object").alias("a"), F.col("nxt").alias("b")).distinct()
    quoted = F.regexp_replace(F.lower("object"), r"([^\p{L}\p{N}\s])", r"\\$1")
    named = answers.select(row_id, F.col(answer)).join(facts.select(row_id, "object").distinct(), row_id).withColumn("__at", F.regexp_instr(text, F.concat(F.lit(r"(?U)\b"), quoted, F.lit(r"\b")))).where("__at > 0")
    pairs = named.withColumn("b", F.lead("object").over(W.partitionBy(row_id).orderBy("__at", "object"))).where("b is not null").select(row_id, F.col("object").alias("a"), "b")
    hit = pairs.join(expected.withColumn("__hit", F.lit(1)), [row_id, "a", "b"], "left").groupBy(row_id).agg((F.count("__hit") / F.count("*")).alias("__score"))
    any_expected = expected.select(row_id).distinct().withColumn("__any", F.lit(True))
    return answers.select(row_id).join(hit, row_id, "left").join(any_expected, row_id, "left").select(row_id, F.when(F.col("__any"), F.coalesce("__score", F.lit(1.0))).otherwise(1.0).alias("completeness"))
