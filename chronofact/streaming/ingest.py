"""Streams of documents and facts: extraction without state, the keyed fold with state, and an idempotent sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronofact.functions.vocabulary import FUNCTIONAL, Vocabulary
from chronofact.model import KEY
from chronofact.operators.catalog import upsert
from chronofact.operators.conflicts import Entry, settle, similarity

STATE = "id array<string>, object array<string>, start array<timestamp>, end array<timestamp>, evidence array<int>, status array<string>"
SETTLED = "id string, subject string, predicate string, scope string, object string, validity_start timestamp, validity_end timestamp, status string, evidence int"


def stream_conflicts(facts: DataFrame, vocabulary: Vocabulary, dedup: float = 0.85) -> DataFrame:
    """Folds a stream of facts by key in order of ``ingest_seq``; emits each fact that a batch added or changed.

    A key's facts are its state, as any later fact may overlap any of them: late facts are judged by their start, not by
    their arrival, so there is no watermark that could drop them. The sink keeps the last version of each id.
    """
    functional = {p for p in vocabulary.alias_table() if vocabulary.cardinality(p) == FUNCTIONAL}

    def run(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        none = lambda x: None if pd.isna(x) else pd.Timestamp(x)
        held = [Entry(i, o, pd.Timestamp(s), none(e), int(n), st) for i, o, s, e, n, st in zip(*state.get, strict=True)] if state.exists else []
        before = {e.id: (e.status, e.end) for e in held}
        rows = pd.concat(list(groups)).sort_values(["ingest_seq", "id"])
        for r in rows.itertuples():
            new = Entry(r.id, r.object, r.validity_start, none(r.validity_end), int(r.evidence), r.status)
            if any(similarity(new.object, p.object) >= dedup for p in held):
                continue
            settle(new, held, key[1].lower() in functional)
            held.append(new)
        state.update(tuple([getattr(e, name) for e in held] for name in ("id", "object", "start", "end", "evidence", "status")))
        out = [e for e in held if before.get(e.id) != (e.status, e.end)]
        if out:
            yield pd.DataFrame([(e.id, *key, e.object, e.start, e.end, e.status, e.evidence) for e in out], columns=[c.split()[0] for c in SETTLED.split(", ")])

    return facts.groupBy(*KEY).applyInPandasWithState(run, SETTLED, STATE, "update", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str, key: str = "id"):
    """A ``foreachBatch`` function that keeps the last version of each id in a Parquet table, as versions of folders:
    a batch that comes again writes its own version again and nothing else."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        change = batch.withColumn("__batch", F.lit(number))
        if number:
            old = spark.read.parquet(f"{path}/v{number - 1}").withColumn("__batch", F.lit(number - 1))
            change = upsert(old, change, [key], "__batch")
        change.drop("__batch").write.mode("overwrite").parquet(f"{path}/v{number}")

    return write


def event_windows(events: DataFrame, ts: str = "ts", width: str = "1 hour", slide: str | None = None, late: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Counts and sums of ``value`` in tumbling or sliding windows of event time, for batches and streams; ``late`` is how
    late rows of a stream may come."""
    if late:
        events = events.withWatermark(ts, late)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(window, *(by or [])).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(by or []), "n", "total")
