"""Counts and reports over facts, documents and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofact.functions.extraction import times_named
from chronofact.functions.texts import camel_case, entity_name, expected_coverage, is_event_verb, natural_predicate, script_language, shortened, token_count, wilson
from chronofact.model import KEY


def count_by_status(facts: DataFrame) -> DataFrame:
    return facts.groupBy("status").agg(F.count("*").alias("n"))


def contested_keys(facts: DataFrame) -> DataFrame:
    return facts.where("status = 'contested'").groupBy(*KEY).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), *KEY)


def store_stats(facts: DataFrame, renaming: list[str]) -> DataFrame:
    """One row of counts, in one pass."""
    return facts.agg(
        F.count("*").alias("n_facts"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("active", "deprecated", "contested")),
        F.countDistinct("subject").alias("n_subjects"), F.countDistinct("predicate").alias("n_predicates"), F.count_if(F.col("predicate").isin(renaming)).alias("n_renames"),
    )


def inspect(facts: DataFrame) -> DataFrame:
    return facts.agg(F.countDistinct(*KEY).alias("n_keys"), F.min("validity_start").alias("first_start"), F.max("validity_start").alias("last_start"))


def top(rows: DataFrame, by: str, k: int = 10) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), by).limit(k)


def rename_edges(facts: DataFrame, renaming: list[str]) -> DataFrame:
    """Renaming facts counted once for each piece of evidence."""
    return facts.where(F.col("predicate").isin(renaming)).agg(F.coalesce(F.sum(F.size("provenance")), F.lit(0)).alias("n"))


def confidence_bucket(c: Column) -> Column:
    return F.when(c < 0.5, "<0.5").when(c < 0.7, "0.5-0.7").when(c < 0.85, "0.7-0.85").otherwise(">=0.85")


def review_histogram(queue: DataFrame, confidence: str = "confidence", extractor: str = "extractor") -> DataFrame:
    return queue.groupBy(F.col(extractor).alias("extractor"), confidence_bucket(F.col(confidence)).alias("bucket")).agg(F.count("*").alias("n"))


def decision_histogram(lines: DataFrame, column: str = "value", field: str = "decision") -> DataFrame:
    """Of lines of JSON; broken lines don't count, lines without the field are UNKNOWN."""
    parsed = lines.withColumn("__ok", F.try_parse_json(F.col(column)).isNotNull())
    return parsed.where("__ok").groupBy(F.coalesce(F.get_json_object(column, f"$.{field}"), F.lit("UNKNOWN")).alias("decision")).agg(F.count("*").alias("n"))


def last_rationales(lines: DataFrame, n: int = 5, column: str = "value", at: str = "timestamp") -> DataFrame:
    """``decision, rationale, timestamp`` of the last ``n`` judgements; broken lines don't count."""
    get = lambda name: F.get_json_object(column, f"$.{name}")
    parsed = lines.where(F.try_parse_json(F.col(column)).isNotNull())
    return parsed.select(F.coalesce(get("decision"), F.lit("UNKNOWN")).alias("decision"), get("rationale").alias("rationale"), get(at).alias("timestamp")).orderBy(F.col("timestamp").desc_nulls_last()).limit(n)


def passage_count(passages: DataFrame) -> DataFrame:
    return passages.agg(F.count("*").alias("n"))


def disputes(facts: DataFrame, evidence: str = "text") -> DataFrame:
    """Contested facts by subject and predicate: their claims in order, with 140 characters of evidence."""
    claim = F.struct("validity_start", "id", F.concat(F.col("object"), F.lit(": "), F.substring(evidence, 1, 140)).alias("claim"))
    return facts.where("status = 'contested'").groupBy("subject", "predicate").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(claim)), lambda c: c["claim"]), " | ").alias("claims"))


def share(rows: DataFrame, hit: Column, by: list[str]) -> DataFrame:
    """``k, n, percent`` and the 95 % interval of a condition, by group."""
    counted = rows.groupBy(*by).agg(F.count_if(hit).alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return counted.select(*by, "k", "n", F.when(F.col("n") > 0, 100.0 * F.col("k") / F.col("n")).otherwise(0.0).alias("percent"), low.alias("low"), high.alias("high"))


def verdict(drift: Column, conflict: Column, any_: Column) -> Column:
    return F.when(drift + conflict >= 5, "high").when(any_ > 0, "medium").otherwise("low")


def drift_and_conflict(facts: DataFrame, functional: list[str], renaming: list[str], days: int = 365) -> DataFrame:
    """The deep scan of a fact table, one row: of keys, the share whose objects differ over more than ``days``; of
    functional keys, the share with a contested fact; of facts, the shares of known time and of renamings."""
    keys = facts.groupBy(*KEY).agg(
        F.countDistinct("object").alias("objects"), F.count_if("validity_known").alias("known"), F.bool_or(F.col("status") == "contested").alias("contested"),
        F.timestamp_diff("DAY", F.min(F.when(F.col("validity_known"), F.col("validity_start"))), F.max(F.when(F.col("validity_known"), F.col("validity_start")))).alias("span"),
    )
    is_functional = F.col("predicate").isin(functional)
    of_keys = keys.agg(F.count("*").alias("n_keys"), F.count_if((F.col("objects") >= 2) & (F.col("known") >= 2) & (F.col("span") > days)).alias("n_drift"), F.count_if(is_functional).alias("n_functional"), F.count_if(is_functional & F.col("contested")).alias("n_conflict"))
    of_facts = facts.agg(F.count("*").alias("n_facts"), F.count_if("validity_known").alias("n_known"), F.count_if(F.col("predicate").isin(renaming)).alias("n_rename"))
    percent = lambda k, n: F.when(F.col(n) > 0, 100.0 * F.col(k) / F.col(n)).otherwise(0.0)
    out = of_keys.crossJoin(of_facts).withColumns({"drift": percent("n_drift", "n_keys"), "conflict": percent("n_conflict", "n_functional"), "depth": percent("n_known", "n_facts"), "rename": percent("n_rename", "n_facts")})
    return out.withColumn("verdict", verdict(F.col("drift"), F.col("conflict"), F.greatest("drift", "conflict", "depth", "rename")))


#: Examples of each dimension of a scan, and the days over which a cluster's objects must differ to drift.
EXAMPLES, DRIFT_DAYS = 3, 365
DIMENSIONS = ("depth", "drift", "conflict", "rename")


def fast_scan(sample: DataFrame, triggers: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The scan of a sample of documents (source_id, text) and its triggers, one row.

    Of documents, the shares that name a time (``depth``) and a renaming (``rename``); of clusters by subject and
    predicate, the share with several objects whose documents' times are over a year apart (``drift``); of functional
    clusters, that with several objects (``conflict``). Each in percent with its 95 % interval, counts and examples.
    """
    dim = F.broadcast(vocabulary.select(F.col("alias").alias("__alias"), "canonical", "cardinality"))
    named = triggers.join(dim, F.lower("predicate") == F.col("__alias"), "left").withColumn("predicate", F.coalesce("canonical", "predicate"))
    clusters = named.groupBy("subject", "predicate").agg(
        F.countDistinct("object").alias("objects"), F.first("cardinality").alias("cardinality"), F.timestamp_diff("DAY", F.min("first_time"), F.max("last_time")).alias("days"),
        F.min("object").alias("one"), F.max("object").alias("other"),
    )
    functional, several = F.coalesce(F.col("cardinality") == "functional", F.lit(False)), F.col("objects") >= 2
    drifts, cluster = several & F.coalesce(F.col("days") > DRIFT_DAYS, F.lit(False)), F.concat_ws(" / ", "subject", "predicate")
    best = lambda hit, text: F.transform(F.slice(F.sort_array(F.collect_list(F.when(hit, F.struct("objects", shortened(text).alias("text")))), asc=False), 1, EXAMPLES), lambda x: x["text"])
    pair = F.concat(cluster, F.lit(" / "), F.col("one"), F.lit(" \u2194 "), F.col("other"))
    of_clusters = clusters.agg(F.count("*").alias("n_clusters"), F.count_if(functional).alias("n_functional"), F.count_if(drifts).alias("n_drift"), F.count_if(functional & several).alias("n_conflict"), best(drifts, cluster).alias("drift_examples"), best(functional & several, pair).alias("conflict_examples"))
    renames = named.where("kind = 'entity_rename'").agg(F.countDistinct("source_id").alias("n_rename"), F.slice(F.array_sort(F.collect_set(shortened(F.col("match_text")))), 1, EXAMPLES).alias("rename_examples"))
    of_docs = sample.select(times_named(F.col("text")).alias("__t")).agg(F.count("*").alias("n_docs"), F.count_if(F.col("__t") > 0).alias("n_depth"))
    out, of = of_clusters.crossJoin(renames).crossJoin(of_docs), dict(zip(DIMENSIONS, ("n_docs", "n_clusters", "n_functional", "n_docs"), strict=True))  # a row each
    for name, n in of.items():
        low, high = wilson(F.col(f"n_{name}"), F.col(n))
        out = out.withColumns({name: F.when(F.col(n) > 0, 100.0 * F.col(f"n_{name}") / F.col(n)).otherwise(0.0), f"{name}_low": low, f"{name}_high": high})
    return out.withColumn("verdict", verdict(F.col("drift"), F.col("conflict"), F.greatest(*DIMENSIONS)))


def discover_predicates(facts: DataFrame, vocabulary: DataFrame | None = None, min_frequency: int = 3) -> DataFrame:
    """Predicates that a corpus's facts suggest: ``name, frequency, cardinality, aliases, examples``. A predicate is of an
    event log if it or a spelling is a verb of news, functional if no subject has two objects, else of several values."""
    raw = facts.withColumn("raw", F.col("predicate"))
    if vocabulary is not None:
        dim = F.broadcast(vocabulary.select(F.col("alias").alias("__alias"), "canonical"))
        raw = raw.join(dim, F.lower("raw") == F.col("__alias"), "left").withColumn("name", F.coalesce("canonical", camel_case(F.col("raw"))))
    else:
        raw = raw.withColumn("name", camel_case(F.col("raw")))
    example = F.concat(F.lit("("), F.col("subject"), F.lit(", "), F.col("name"), F.lit(", "), F.col("object"), F.lit(")"))
    per_subject = raw.groupBy("name", "subject").agg(F.count("*").alias("n"), F.countDistinct("object").alias("objects"), F.collect_set("raw").alias("forms"), F.min(example).alias("example"), F.bool_or(is_event_verb(F.col("raw"))).alias("event"))
    found = per_subject.groupBy("name").agg(F.sum("n").alias("frequency"), F.max("objects").alias("objects"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("forms")))).alias("forms"), F.bool_or("event").alias("event"), F.min("example").alias("example"))
    cardinality = F.when(F.col("event") | is_event_verb(F.col("name")), "event_log").when(F.col("objects") == 1, "functional").otherwise("multi_valued")
    return found.where(F.col("frequency") >= min_frequency).select("name", "frequency", cardinality.alias("cardinality"), F.array_join(F.array_except("forms", F.array("name")), ", ").alias("aliases"), "example")


def expected_types(facts: DataFrame, by: str = "predicate", column: str = "subject_type", threshold: float = 0.5) -> DataFrame:
    """Entity types that at least half of a predicate's facts have; facts without one count too."""
    n = F.sum("n").over(W.partitionBy(by))
    counted = facts.groupBy(by, column).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / n).where(F.col("share") >= threshold).where(F.col(column).isNotNull() & ~F.col(column).isin("UNAVAILABLE", "NONE", "COMPOUND")).select(by, column, "share")


def seed_entities(mentions: DataFrame, budget: int = 50, min_frequency: int = 3) -> DataFrame:
    """``entity, n, n_predicates, n_langs, score, rank`` of the entities most worth asking about. ``mentions``: entity,
    predicate (may be null) and lang."""
    named = mentions.withColumn("entity", entity_name(F.col("entity"))).where("entity <> ''")
    counted = named.groupBy("entity").agg(F.count("*").alias("n"), F.countDistinct("predicate").alias("n_predicates"), F.countDistinct("lang").alias("n_langs")).where(F.col("n") >= min_frequency)
    scored = counted.withColumn("score", F.col("n") * (1 + F.col("n_predicates")) * (1 + 0.2 * F.col("n_langs")))
    best = scored.orderBy(F.col("score").desc(), F.col("n").desc(), F.col("entity").desc()).limit(min(200, 4 * budget))
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), F.col("n").desc(), F.col("entity").desc())))  # of 200 rows at most


def seed_queries(entities: DataFrame, functional: DataFrame, renamed: DataFrame, disputed: DataFrame) -> DataFrame:
    """``query, kind, entity, predicate, coverage``; of equal queries the first kind stays: functional, rename,
    disputed_check, entity_coverage. ``functional``: (predicate); ``renamed``: (entity, n); ``disputed``: (entity,
    predicate, n)."""
    row = lambda kind, i: [F.lit(kind).alias("kind"), F.lit(i).alias("__order")]
    ask = F.concat_ws(" ", "entity", natural_predicate(F.col("predicate")))
    parts = [
        entities.crossJoin(F.broadcast(functional)).select(ask.alias("query"), *row("functional", 1), "entity", "predicate", "n"),
        renamed.select(F.explode(F.array(F.concat("entity", F.lit(" renamed")), F.concat("entity", F.lit(" formerly known as")))).alias("query"), *row("rename", 2), "entity", F.lit("renamedTo").alias("predicate"), "n"),
        disputed.select(ask.alias("query"), *row("disputed_check", 3), "entity", "predicate", "n"),
        entities.where("rank <= 50").select(F.col("entity").alias("query"), *row("entity_coverage", 4), "entity", F.lit(None).cast("string").alias("predicate"), "n"),
    ]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    first = all_.groupBy("query").agg(F.min_by(F.struct("kind", "entity", "predicate", "n"), F.struct("__order", "entity", "predicate")).alias("c")).select("query", "c.*")
    return first.withColumn("coverage", expected_coverage(F.col("kind"), F.col("n"))).drop("n")


# Prices of 1000 input and output tokens by model, those of an unknown one, and tokens a second.
PRICES = {"gpt-4o-mini": (0.00015, 0.0006), "gpt-4o": (0.0025, 0.01), "claude-haiku-4-5-20251001": (0.0008, 0.004), "claude-sonnet-4-6": (0.003, 0.015), "Qwen/Qwen3-32B": (0.0004, 0.0012), "trigger": (0.0, 0.0)}
UNKNOWN_PRICE, LIVE_RATE, CACHED_RATE = (0.0005, 0.002), 30.0, 150.0


def ingest_cost(docs: DataFrame, model: str = "gpt-4o-mini", n_total: int | None = None, hit_rate: float = 0.0) -> DataFrame:
    """One row: mean tokens of the sampled ``docs`` carried to ``n_total`` documents, money and seconds."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out_tokens = F.greatest(F.lit(1), F.least(F.lit(800), F.floor(F.length(text) / 10)))
    means = docs.agg(F.count("*").alias("n_sampled"), F.avg(token_count(text)).alias("mean_in"), F.avg(out_tokens).alias("mean_out"))
    price_in, price_out = PRICES.get(model, UNKNOWN_PRICE)
    n = F.lit(n_total) if n_total is not None else F.col("n_sampled")
    totals = means.withColumns({"total_in": F.round(F.col("mean_in") * n).cast("long"), "total_out": F.round(F.col("mean_out") * n).cast("long")})
    gross = F.col("total_in") / 1000.0 * price_in + F.col("total_out") / 1000.0 * price_out
    tokens = F.col("total_in") + F.col("total_out")
    seconds = F.lit(0.0) if model == "trigger" else (1 - hit_rate) * tokens / LIVE_RATE + hit_rate * tokens / CACHED_RATE
    return totals.withColumns({"gross_usd": gross, "net_usd": gross * (1 - hit_rate), "seconds": seconds})


def mention_languages(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("lang_block", script_language(F.col(text)))
