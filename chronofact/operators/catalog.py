"""Changes to tables, as new tables: upserts, deletions, suppression, resolution, caches and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofact.model import KEY, short_hash


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of each key the first row in an order, which should end in something unique."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(table: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """The table with changed rows replaced and new ones added; of several changes the greatest ``order`` wins.

    One shuffle of either side by key: rows that change are found by a left anti join and never sorted.
    """
    newest = latest(changes, key, [F.col(order).desc()])
    return table.join(newest.select(*key), key, "left_anti").unionByName(newest.select(*table.columns))


def upsert_report(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``created`` for each distinct key of the changes: whether the table lacks it."""
    known = table.select(*key).distinct().withColumn("__known", F.lit(True))
    return changes.select(*key).distinct().join(known, key, "left").select(*key, F.col("__known").isNull().alias("created"))


def write_policy(table: DataFrame, new: DataFrame, key: list[str], policy: str, order: str) -> DataFrame:
    """New rows under a policy for keys that the table has: SKIP them, OVERWRITE, or FAIL (a ValueError)."""
    if policy == "SKIP":
        fresh = latest(new.join(table.select(*key), key, "left_anti"), key, [F.col(order).desc()])
        return table.unionByName(fresh.select(*table.columns))
    if policy == "FAIL" and new.join(table.select(*key), key, "left_semi").limit(1).count():
        raise ValueError("the table has some of these keys")
    return upsert(table, new, key, order)


def delete_sources(facts: DataFrame, passages: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the passages of the sources and the facts with any evidence from one."""
    gone = facts.select("id", F.explode("provenance.source_id").alias("source_id")).join(sources, "source_id", "left_semi").select("id").distinct()
    return facts.join(gone, "id", "left_anti"), passages.join(sources, "source_id", "left_anti")


def mark_preferred(facts: DataFrame, fact_id: str, set_active: bool = True) -> DataFrame:
    """KeyError if there is no such fact."""
    if not facts.where(F.col("id") == fact_id).limit(1).count():
        raise KeyError(fact_id)
    hit = F.col("id") == fact_id
    return facts.withColumns({"rank": F.when(hit, "preferred").otherwise(F.col("rank")), "status": F.when(hit & F.lit(set_active), "active").otherwise(F.col("status"))})


def suppress(facts: DataFrame, fact_id: str) -> DataFrame:
    if not facts.where(F.col("id") == fact_id).limit(1).count():
        raise KeyError(fact_id)
    hit = F.col("id") == fact_id
    return facts.withColumns({c: F.when(hit, "deprecated").otherwise(F.col(c)) for c in ("rank", "status")})


def resolve(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Facts after people decided keys: ``decisions`` has the key, ``action`` (winner, all_wrong, skip, leave) and
    ``winner_id``. A winner becomes active and preferred, all others of its key deprecated; all_wrong has no winner."""
    chosen = decisions.where(F.col("action").isin("winner", "all_wrong")).select(*KEY, "action", "winner_id")
    joined = facts.join(chosen, list(KEY), "left")
    wins = (F.col("action") == "winner") & (F.col("id") == F.col("winner_id"))
    status = F.when(F.col("action").isNull(), F.col("status")).when(wins, "active").otherwise("deprecated")
    rank = F.when(F.col("action").isNull(), F.col("rank")).when(wins, "preferred").otherwise("deprecated")
    return joined.withColumns({"status": status, "rank": rank}).select(*facts.columns)


def append_log(rows: DataFrame, path: str) -> None:
    """Decisions, deferred facts and resolutions are logs of JSON lines that only grow."""
    rows.write.mode("append").json(path)


def cache_key(text: Column, extractor_id: str) -> Column:
    return F.sha2(F.concat(text, F.lit(f"|{extractor_id}")), 256)


def split_by_cache(docs: DataFrame, cache: DataFrame, extractor_id: str) -> tuple[DataFrame, DataFrame]:
    """Documents whose extraction is cached, with it, and those that are yet to be extracted."""
    keyed = docs.withColumn("cache_key", cache_key(F.col("text"), extractor_id))
    return keyed.join(cache, "cache_key"), keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def trimmed_cache(cache: DataFrame, size: int = 10_000) -> DataFrame:
    """The most recently used entries."""
    return cache.orderBy(F.col("last_used").desc(), "cache_key").limit(size)


def passage_hash(text: Column) -> Column:
    return short_hash(text)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``id, change, old_status, new_status``: facts added, removed, or of another status."""
    a, b = old.select("id", F.col("status").alias("old_status")), new.select("id", F.col("status").alias("new_status"))
    change = F.when(F.col("old_status").isNull(), "added").when(F.col("new_status").isNull(), "removed").when(F.col("old_status") != F.col("new_status"), "status_changed")
    return a.join(b, "id", "full_outer").withColumn("change", change).where("change is not null")
