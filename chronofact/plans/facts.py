"""Fact relations projected from the star schema, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofact.model import fact_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def facts_ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which supplier delivered a part, from its first to its last shipment; orders are the evidence."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.groupBy("l_partkey", "l_suppkey").agg(F.min("l_shipdate").alias("validity_start"), F.max("l_shipdate").alias("__last"), F.count("*").cast("int").alias("evidence"), F.min("l_orderkey").alias("source"))
    s = F.col("l_suppkey")
    return rows.select(
        F.concat(F.lit("Part#"), "l_partkey").alias("subject"), F.lit("supplier").alias("predicate"), F.concat(F.lit("Supplier#"), s).alias("object"), F.lit("global").alias("scope"),
        "validity_start", F.when(F.col("__last") > F.col("validity_start"), F.col("__last")).alias("validity_end"), "evidence", "source",
        F.when(s % 5 == 0, "deprecated").when(s % 7 == 0, "contested").otherwise("active").alias("status"), ((s % 100) / 100).alias("confidence"), (F.col("source") % 2 == 0).alias("validity_known"),
    ).withColumn("text", F.concat_ws(" ", "subject", F.lit("comes from"), "object")).withColumn("id", fact_id())


SHIP = """ship0 AS (SELECT l_partkey, l_suppkey, min(l_shipdate) AS validity_start, max(l_shipdate) AS last_, count(*)::INT AS evidence, min(l_orderkey) AS source FROM lineitem GROUP BY ALL),
ship AS (SELECT *, subject || ' comes from ' || object AS text, substr(sha256(subject || '|' || predicate || '|' || object || '|' || strftime(validity_start, '%Y-%m-%dT%H:%M:%S') || '+00:00|' || scope), 1, 16) AS id FROM (
 SELECT 'Part#' || l_partkey AS subject, 'supplier' AS predicate, 'Supplier#' || l_suppkey AS object, 'global' AS scope, validity_start, CASE WHEN last_ > validity_start THEN last_ END AS validity_end, evidence, source,
 CASE WHEN l_suppkey % 5 = 0 THEN 'deprecated' WHEN l_suppkey % 7 = 0 THEN 'contested' ELSE 'active' END AS status, (l_suppkey % 100) / 100 AS confidence, source % 2 = 0 AS validity_known FROM ship0))"""


def facts_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's order status from one order to the next."""
    nxt = F.lead("o_orderdate").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderdate").alias("validity_start"), nxt.alias("validity_end"))
    rows = rows.where(F.col("validity_end").isNull() | (F.col("validity_end") > F.col("validity_start")))
    return rows.select(
        F.concat(F.lit("Order#"), "o_orderkey").alias("id"), F.concat(F.lit("Customer#"), "o_custkey").alias("subject"), F.lit("orderStatus").alias("predicate"), F.col("o_orderstatus").alias("object"), F.lit("global").alias("scope"),
        "validity_start", "validity_end", F.when(F.col("o_orderkey") % 10 == 0, "contested").otherwise("active").alias("status"), F.col("o_orderkey").alias("source"), "o_custkey",
    )


ORDER = """ord AS (SELECT * FROM (SELECT 'Order#' || o_orderkey AS id, 'Customer#' || o_custkey AS subject, 'orderStatus' AS predicate, o_orderstatus AS object, 'global' AS scope, o_orderdate AS validity_start,
 lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS validity_end, CASE WHEN o_orderkey % 10 = 0 THEN 'contested' ELSE 'active' END AS status, o_orderkey AS source, o_custkey FROM orders)
 WHERE validity_end IS NULL OR validity_end > validity_start)"""


def edges_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is followed by the same customer's next one."""
    nxt = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("validity_start"), nxt.alias("__next")).where("__next is not null")
    return rows.select(F.concat(F.lit("e"), "o_orderkey").alias("id"), F.concat(F.lit("O"), "o_orderkey").alias("subject"), F.lit("renamedTo").alias("predicate"), F.concat(F.lit("O"), "__next").alias("object"), "validity_start", F.lit("active").alias("status"))


EDGES = """edges AS (SELECT 'e' || o_orderkey AS id, 'O' || o_orderkey AS subject, 'O' || nxt AS object, validity_start FROM (SELECT o_orderkey, o_orderdate AS validity_start,
 lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) WHERE nxt IS NOT NULL)"""


def facts_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers are in nations, nations in regions; open-ended."""
    nation = table(spark, sf_dir, "nation")
    parts = [
        table(spark, sf_dir, kind).join(F.broadcast(nation), F.col(f"{k}_nationkey") == F.col("n_nationkey")).select(F.col(f"{k}_name").alias("subject"), F.lit("locatedNation").alias("predicate"), F.col("n_name").alias("object"))
        for kind, k in (("customer", "c"), ("supplier", "s"))
    ]  # nations are 25
    regions = nation.join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("subject"), F.lit("inRegion").alias("predicate"), F.col("r_name").alias("object"))
    all_ = parts[0].unionByName(parts[1]).unionByName(regions)
    return all_.withColumns({"id": F.md5(F.concat_ws("|", "subject", "predicate", "object")), "scope": F.lit("global"), "validity_start": instant("1992-01-01"), "validity_end": F.lit(None).cast("timestamp_ntz"), "status": F.lit("active")})


def facts_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user did something; the kind of event is the predicate."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("ev"), "event_id").alias("id"), F.concat(F.lit("User#"), "user_id").alias("subject"), F.col("event_type").alias("predicate"), F.get_json_object("props", "$.k").alias("object"), F.lit("global").alias("scope"), F.col("ts").alias("validity_start"), "event_id", "value")


EVENT = "ev AS (SELECT 'ev' || event_id AS id, 'User#' || user_id AS subject, event_type AS predicate, json_extract_string(props, '$.k') AS object, 'global' AS scope, ts AS validity_start, event_id, value FROM events)"


def with_provenance(facts: DataFrame) -> DataFrame:
    """Evidence rows for facts that only have a source: one at the start, and one at the end if there is one."""
    at = lambda ts: F.struct(F.concat(F.lit("S"), (F.col("source") % 50).cast("string")).alias("source_id"), F.col("text").alias("evidence_span"), ts.alias("created_at"))
    return facts.withColumn("provenance", F.when(F.col("validity_end").isNull(), F.array(at(F.col("validity_start")))).otherwise(F.array(at(F.col("validity_start")), at(F.col("validity_end")))))
