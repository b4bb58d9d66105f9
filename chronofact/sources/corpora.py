"""Corpora to sample and search, whatever holds them.

A corpus is two functions that give DataFrames. Files are searched by the engine's own operators; remote stores (search
engines, vector stores) plug in by a fetch function that is called on executors, one page after another, through
Spark's Python data sources.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronofact.model import DOCUMENTS
from chronofact.operators import search
from chronofact.operators.sampling import reservoir

# Questions of broad topics that a diverse sample is drawn by.
TOPICS = (
    "recipe", "symptoms", "travel guide", "tutorial", "best of 2024", "research study", "how to fix", "interview with", "diagnosis", "review", "conference", "lawsuit", "university", "album release",
    "workout", "budget", "election", "vaccine", "festival", "stock market", "restaurant", "fashion", "climate", "book review", "tournament", "scholarship", "startup",
)


class Corpus(Protocol):
    def sample(self, mode: str, n: int) -> DataFrame: ...

    def search(self, query: str, limit: int) -> DataFrame: ...


@dataclass
class TableCorpus:
    """Documents in a DataFrame. Modes of sampling: topic_diverse, uniform, random_ids."""

    docs: DataFrame
    seed: int = 0

    def search(self, query: str, limit: int) -> DataFrame:
        """Best documents with any word of the query; if there is none, the first ones by id."""
        hits = self._hits([query], limit).join(self.docs, F.col("id") == F.col("source_id")).orderBy("rank").select(*self.docs.columns)
        return hits if hits.limit(1).count() else self.docs.orderBy("source_id").limit(limit)

    def hits(self, questions: DataFrame, limit: int = 5) -> DataFrame:
        """The best documents for each of a batch of questions (query_id, query): the documents' columns with ``query_id``
        and ``rank``."""
        index = search.postings(self.docs, "source_id", "text", search.plain_terms)
        found = search.any_term(index, search.statistics(self.docs, "text", search.plain_terms), questions, top_k=limit)
        return found.select("query_id", F.col("id").alias("source_id"), "rank").join(self.docs, "source_id")

    def _hits(self, queries: list[str], limit: int) -> DataFrame:
        asked = self.docs.sparkSession.createDataFrame(list(enumerate(queries)), "query_id long, query string")
        index = search.postings(self.docs, "source_id", "text", search.plain_terms)
        return search.any_term(index, search.statistics(self.docs, "text", search.plain_terms), asked, top_k=limit)

    def sample(self, mode: str, n: int) -> DataFrame:
        if mode not in ("topic_diverse", "uniform", "random_ids"):
            raise ValueError(f"unknown mode {mode!r}")
        if mode != "topic_diverse":
            return reservoir(self.docs, n, self.seed)
        return topic_diverse(self._hits(list(TOPICS), n // len(TOPICS) + 1), self.docs, n)


def topic_diverse(hits: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Union of each topic's best documents, in the topics' order, each once, up to ``n``."""
    first = hits.groupBy("id").agg(F.min(F.struct("query_id", "rank")).alias("__o")).orderBy("__o", "id").limit(n)
    return docs.join(first.select(F.col("id").alias("source_id")), "source_id", "left_semi")


Fetch = Callable[[str | None, int, int], list[tuple]]


def paged_source(name: str, fetch: Fetch, total: int, page: int = 500, query: str | None = None) -> type[DataSource]:
    """A data source over a store that gives documents by offset: ``fetch(query, offset, limit)`` returns rows of
    ``source_id, text, uri, source_date``. Pages are partitions, so they are read in parallel and again if lost."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(at) for at in range(0, total, page)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from fetch(query, partition.value, min(page, total - partition.value))

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return DOCUMENTS

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Source


@dataclass
class RemoteCorpus:
    """A store behind a fetch function, such as a client of a search engine."""

    spark: SparkSession
    name: str
    fetch: Fetch
    total: int
    page: int = 500

    def _read(self, query: str | None, total: int) -> DataFrame:
        self.spark.dataSource.register(paged_source(self.name, self.fetch, total, self.page, query))
        return self.spark.read.format(self.name).load()

    def search(self, query: str, limit: int) -> DataFrame:
        return self._read(query, limit)

    def sample(self, mode: str, n: int) -> DataFrame:
        if mode != "topic_diverse":
            return reservoir(self._read(None, self.total), n)
        out = None
        for topic in TOPICS:
            found = self._read(topic, n // len(TOPICS) + 1).dropDuplicates(["source_id"])
            out = found if out is None else out.unionByName(found)
        return out.dropDuplicates(["source_id"]).limit(n)
