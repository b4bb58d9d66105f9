"""Succession, rename and multi-hop chains over facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofact.durable import saved
from chronofact.functions.intervals import contains, gap_seconds
from chronofact.model import KEY
from chronofact.operators.views import join_eligible


class AmbiguousChain(ValueError):
    """A hop has more than one fact to go on with."""


def succession(facts: DataFrame, at: Column | None = None, include_contested: bool = False, max_depth: int = 50, key: tuple[str, ...] = KEY) -> DataFrame:
    """All keys' chains at once: facts in order of start with ``position``, ``gap_seconds`` from the one before (null if
    that is open or overlaps) and whether the chain was ``truncated`` after ``max_depth``."""
    statuses = ["active", "deprecated", *["contested"] * include_contested]
    rows = facts.where(F.col("status").isin(statuses))
    if at is not None:
        rows = rows.where(F.col("validity_start") <= at)
    order = W.partitionBy(*key).orderBy("validity_start", "id")
    rows = rows.withColumns({"position": F.row_number().over(order), "gap_seconds": gap_seconds(F.lag("validity_end").over(order), F.col("validity_start")), "truncated": F.count("*").over(W.partitionBy(*key)) > max_depth})
    return rows.where(F.col("position") <= max_depth)


def chain_at(chain: DataFrame, at: Column, key: tuple[str, ...] = KEY) -> DataFrame:
    """Of each chain the first fact that holds at an instant."""
    found = chain.where(contains(at))
    return found.withColumn("__first", F.min("position").over(W.partitionBy(*key))).where("position = __first").drop("__first")


def chain_pairs(chain: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Neighbouring objects of each chain."""
    following = F.lead("object").over(W.partitionBy(*key).orderBy("position"))
    return chain.withColumn("next_object", following).where("next_object is not null").select(*key, "object", "next_object")


#: Ways on that a resolver is shown.
SHOWN = 3
#: Chooses one of a few facts (id, subject, predicate, object, validity_start) by its id, or none.
Resolver = Callable[[list[dict]], str | None]


def _one_way(facts: DataFrame, by: list[str], resolver: Resolver | None, strict: bool) -> DataFrame:
    """One fact for each key ``by``, and whether that is ``ambiguous``: there are more, and neither the resolver chose nor
    is the earliest taken (not ``strict``). Of a key's facts a few leave the task that counts them."""
    order = W.partitionBy(*by).orderBy("validity_start", "id")
    few = facts.withColumns({"__n": F.row_number().over(order), "__ways": F.count("*").over(W.partitionBy(*by))}).where(F.col("__n") <= SHOWN)
    if resolver is None:
        return few.where("__n = 1").withColumn("ambiguous", F.lit(strict) & (F.col("__ways") > 1)).drop("__n", "__ways")
    shown = F.struct("validity_start", "id", "subject", "predicate", "object")

    @F.udf("string")
    def chosen(options: list) -> str | None:  # called for ambiguous keys only
        return resolver([o.asDict() for o in options])

    keys = few.groupBy(*by).agg(F.max("__ways").alias("__ways"), F.array_sort(F.collect_list(shown)).alias("__o"))
    picked = keys.withColumn("__id", F.when(F.col("__ways") > 1, chosen("__o")).otherwise(F.col("__o")[0]["id"])).select(*by, "__id")
    told = few.join(picked, by).where(F.coalesce(F.col("id") == F.col("__id"), F.col("__n") == 1))
    return told.withColumn("ambiguous", F.col("__id").isNull() & F.lit(strict)).drop("__n", "__ways", "__id")


def unambiguous(steps: DataFrame) -> DataFrame:
    """``steps`` as they are; AmbiguousChain if any step is ambiguous. For the few rows of a single question."""
    first = steps.where("ambiguous").limit(1).collect()
    if first:
        raise AmbiguousChain(f"more than one fact to go on with from {first[0]['start']!r}")
    return steps


def rename_walk(facts: DataFrame, starts: DataFrame, predicates: list[str], at: Column | None = None, direction: str = "forward", max_depth: int = 10, include_contested: bool = False, strict: bool = True, resolver: Resolver | None = None) -> DataFrame:
    """Walks renamings from every start at once: ``start, step, id, subject, predicate, object, closes, ambiguous,
    truncated``.

    Walks go by doubling: joins of the renamings with themselves give where a name leads in 1, 2, 4, ... steps, as many as
    the depth has binary digits, and as many joins give all places of all walks; a place that comes twice is a circle. A
    walk ends where nothing goes on, after ``max_depth`` steps, or with the step that comes back to a name it had
    (``closes``). Where there is more than one way on, the ``resolver`` chooses; without its choice a ``strict`` walk ends
    with a step marked ``ambiguous`` (the earliest fact), any other goes on with that fact. ``both`` walks either way; a
    fact found twice counts once. A start that is given twice is walked once.
    """
    if direction == "both":
        ways = [rename_walk(facts, starts, predicates, at, d, max_depth, include_contested, strict, resolver) for d in ("backward", "forward")]
        return ways[0].unionByName(ways[1]).dropDuplicates(["start", "id"])
    here, there = ("subject", "object") if direction == "forward" else ("object", "subject")
    edges = facts.where(F.col("predicate").isin(predicates) & F.col("status").isin("active", "deprecated", *["contested"] * include_contested))
    if at is not None:
        edges = edges.where(F.col("validity_start") <= at)
    edges = _one_way(edges, [here], resolver, strict).select(F.col(here).alias("current"), F.col(there).alias("next"), "id", "subject", "predicate", "object", "ambiguous")
    edges = saved(edges)
    leap, leaps = edges.where("not ambiguous").select(F.col("current").alias("node"), "next"), []
    for k in range(max(0, max_depth).bit_length()):
        leaps.append(leap)
        if 2 ** (k + 1) <= max_depth:
            leap = saved(leap.join(leap.select(F.col("node").alias("next"), F.col("next").alias("then")), "next").select("node", F.col("then").alias("next")))
    walks = starts.select("start").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("place"))
    for k in reversed(range(len(leaps))):
        ways = F.array(F.struct("node", "place"), F.struct(F.col("next").alias("node"), (F.col("place") + 2**k).alias("place")))
        walks = walks.join(leaps[k], "node", "left").select("start", F.explode(ways).alias("w")).select("start", "w.*").where(F.col("node").isNotNull() & (F.col("place") <= max_depth))
    again = F.row_number().over(W.partitionBy("start", "node").orderBy("place")) > 1
    walks = walks.withColumn("again", again).withColumn("circle", F.min(F.when(F.col("again"), F.col("place"))).over(W.partitionBy("start")))
    on = walks.where("circle is null or place < circle").join(edges, F.col("node") == F.col("current"))
    # leaps don't follow an ambiguous step, which is the last of its walk: its end is looked for among the names before it
    back = F.col("ambiguous") & F.array_contains(F.collect_set("node").over(W.partitionBy("start")), F.col("next"))
    closing = F.coalesce(F.col("place") + 1 == F.col("circle"), F.lit(False)) | F.coalesce(back, F.lit(False))
    steps = on.select("start", (F.col("place") + 1).alias("step"), "id", "subject", "predicate", "object", closing.alias("closes"), "ambiguous")
    longest = F.max("step").over(W.partitionBy("start"))
    return steps.withColumn("truncated", longest > max_depth).where(F.col("step") <= max_depth)


def join_chain(facts: DataFrame, starts: DataFrame, predicates: list[str], at: Column | None = None, strict: bool = True, resolver: Resolver | None = None) -> DataFrame:
    """Follows facts from each start, within its scope (``start`` and, where given, ``scope``; else global): the object of
    a hop is the subject of the next. ``start, hop_1, hop_2, ...``, null from where it is ``ambiguous``; at most four
    hops. Starts with no fact to go on with are not in the result. At a hop with several facts the ``resolver`` chooses;
    without its choice the chain is marked if ``strict``, else dropped."""
    if not 1 <= len(predicates) <= 4:
        raise ValueError("one to four hops")
    live = join_eligible(facts, at)
    scope = F.col("scope") if "scope" in starts.columns else F.lit("global")
    out = starts.select("start", F.col("start").alias("__here"), scope.alias("scope"), F.lit(False).alias("ambiguous"))
    for i, predicate in enumerate(predicates, 1):
        hop = _one_way(live.where(F.col("predicate") == predicate), ["subject", "scope"], resolver, True)
        hop = hop.select(F.col("subject").alias("__here"), "scope", F.col("object").alias("__next"), F.col("ambiguous").alias("__more"))
        joined = out.join(hop, ["__here", "scope"], "left").where("ambiguous or __next is not null")
        stopped = F.col("ambiguous") | F.col("__more")
        joined = joined.withColumn("ambiguous", F.coalesce(stopped, F.col("ambiguous")))
        out = joined.withColumn(f"hop_{i}", F.when(~F.col("ambiguous"), F.col("__next"))).withColumn("__here", F.col(f"hop_{i}")).drop("__next", "__more")
    out = out.select("start", *(f"hop_{i}" for i in range(1, len(predicates) + 1)), "ambiguous")
    return out if strict else out.where("not ambiguous").drop("ambiguous")
