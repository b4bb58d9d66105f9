"""Commands over a fact store: ``python -m chronofact.cli --store PATH COMMAND ...`` or by spark-submit."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chronofact.functions.extraction import extract
from chronofact.operators import reports, sampling, views
from chronofact.plans.store import FactStore, audit, auto, scan_corpus, seeds_of, to_markdown
from chronofact.sources.readers import documents_folder, documents_jsonl, passages_text


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="chronofact")
    out.add_argument("--store", default="facts-store")
    sub = out.add_subparsers(dest="command", required=True)
    for name, args in {
        "ingest": ["source"], "auto": ["source"], "doctor": ["source"], "audit": ["source"], "estimate-cost": ["source"], "query": ["text"], "context": ["text"], "chain": ["subject", "predicate"], "renames": ["subject"], "inspect": [], "contested": [], "diff": ["version"], "review": [],
        "seeds": ["source"], "schema": ["source"], "failures": [], "resolve": ["subject", "predicate", "winner"],
    }.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        p.add_argument("--at", help="ISO time; now by default")
        p.add_argument("--view", default="active", choices=list(views.VIEWS))
        p.add_argument("--top", type=int, default=10)
        p.add_argument("--sample", type=int, default=500)
        p.add_argument("--json", action="store_true")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = FactStore(spark, a.store)
    at = F.lit(a.at).cast("timestamp") if a.at else F.current_timestamp()
    docs = (lambda: documents_jsonl(spark, a.source) if a.source.endswith(".jsonl") else documents_folder(spark, a.source))
    query = lambda: spark.createDataFrame([(1, a.text)], "query_id long, query string")
    run = {
        "ingest": lambda: [store.ingest(docs())],
        "auto": lambda: [{k: json.dumps(v, default=str) for k, v in auto(store, docs(), a.sample).items()}],
        "doctor": lambda: scan_corpus(docs(), store.vocabulary, a.sample),
        "audit": lambda: audit(passages_text(spark, a.source).select(F.col("position").cast("string").alias("source_id"), "text", F.lit(None).cast("timestamp").alias("source_date")), store.vocabulary, at),
        "estimate-cost": lambda: reports.ingest_cost(docs()),
        "query": lambda: views.payload(store.retrieve(query(), at, a.view, top_k=a.top).orderBy("rank")),
        "context": lambda: store.answer_context(query(), at, a.top),
        "chain": lambda: store.succession(a.subject, a.predicate, at=at).orderBy("position").select("position", "object", "validity_start", "validity_end", "gap_seconds"),
        "renames": lambda: store.renames(a.subject, at).orderBy("step").select("step", "subject", "object"),
        "inspect": lambda: [store.stats()],
        "contested": lambda: reports.contested_keys(store.facts).limit(a.top),
        "diff": lambda: store.changed_since(int(a.version)).limit(a.top),
        "seeds": lambda: seeds_of(docs(), store.vocabulary, a.sample, a.top),
        "schema": lambda: reports.discover_predicates(extract(sampling.stratified(sampling.strata(docs(), "composite"), a.sample)), store.vocabulary.dimension(spark)),
        "failures": lambda: store.failures.limit(a.top),
        "resolve": lambda: [store.resolve(a.subject, a.predicate, None if a.winner == "none" else a.winner)],
        "review": lambda: reports.review_histogram(store.facts, "extraction_confidence", "source_type"),
    }[a.command]()
    rows = run if isinstance(run, list) else [r.asDict() for r in run.collect()]  # reports are small
    text = json.dumps(rows, default=str) if a.json else to_markdown(a.command, rows)
    print(text)
    return text


if __name__ == "__main__":
    main()
