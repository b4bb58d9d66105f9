"""Fetch functions over the clients of search engines and vector stores, for ``RemoteCorpus``.

Each takes ``connect``, a function that makes the client; it is called on executors, once for each page, so clients
never travel. No client library is needed to import this module. Rows are ``source_id, text, uri, source_date``.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from chronofact.sources.corpora import Fetch
from chronofact.sources.readers import documents

Connect = Callable[[], Any]


@dataclass(frozen=True)
class Fields:
    """Names of a store's fields."""

    text: str = "text"
    uri: str = "uri"
    date: str = "source_date"


def _time(value: Any) -> datetime | None:
    if value is None or isinstance(value, datetime):
        return value
    try:
        found = datetime.fromtimestamp(value, UTC) if isinstance(value, int | float) else datetime.fromisoformat(str(value).strip().replace("Z", "+00:00"))
    except (ValueError, OverflowError):
        return None
    return found if found.tzinfo else found.replace(tzinfo=UTC)


def _rows(found: Iterable[tuple[Any, Mapping]], fields: Fields) -> list[tuple]:
    """Rows of hits with a text; ids become text."""
    return [(str(i), str(x[fields.text]), x.get(fields.uri), _time(x.get(fields.date))) for i, x in found if x.get(fields.text)]


def elasticsearch(connect: Connect, index: str, fields: Fields = Fields(), seed: int = 0) -> Fetch:  # noqa: B008
    """Elasticsearch and OpenSearch: full-text search, or all documents in a random order that ``seed`` fixes."""

    def fetch(query: str | None, offset: int, limit: int) -> list[tuple]:
        every = {"function_score": {"query": {"match_all": {}}, "random_score": {"seed": seed, "field": "_seq_no"}}}
        body = {"from": offset, "size": limit, "query": {"match": {fields.text: query}} if query else every}
        found = connect().search(index=index, body=body)["hits"]["hits"]
        return _rows(((h["_id"], h["_source"]) for h in found), fields)

    return fetch


def _vector(query: str | None, encoder: Callable[[str], list[float]] | None, size: int, seed: int) -> list[float]:
    """The query's vector, or a random direction to probe a store by."""
    if query is not None and encoder is not None:
        return list(encoder(query))
    rng = random.Random(f"{seed}|{query}")
    return [rng.gauss(0, 1) for _ in range(size)]


def qdrant(connect: Connect, collection: str, size: int, encoder: Callable[[str], list[float]] | None = None, fields: Fields = Fields(), seed: int = 0) -> Fetch:  # noqa: B008
    """Qdrant: the points nearest to the query's vector; without an encoder or a query, to a random one of ``size``."""

    def fetch(query: str | None, offset: int, limit: int) -> list[tuple]:
        found = connect().query_points(collection_name=collection, query=_vector(query, encoder, size, seed), limit=limit, offset=offset, with_payload=True).points
        return _rows(((p.id, p.payload or {}) for p in found), fields)

    return fetch


def pinecone(connect: Connect, size: int, encoder: Callable[[str], list[float]] | None = None, fields: Fields = Fields(), seed: int = 0) -> Fetch:  # noqa: B008
    """Pinecone, which knows no offset: each page asks for all matches up to its end."""

    def fetch(query: str | None, offset: int, limit: int) -> list[tuple]:
        found = connect().query(vector=_vector(query, encoder, size, seed), top_k=offset + limit, include_metadata=True)["matches"]
        return _rows(((m["id"], m.get("metadata") or {}) for m in found[offset:]), fields)

    return fetch


def vespa(connect: Connect, source: str, fields: Fields = Fields(), id_field: str = "id") -> Fetch:  # noqa: B008
    """Vespa: full-text search or all documents; marks of highlighted words are taken out."""

    def fetch(query: str | None, offset: int, limit: int) -> list[tuple]:
        what = "userQuery()" if query else "true"
        body = {"yql": f"select * from {source} where {what}", "offset": offset, "hits": limit} | ({"query": query} if query else {})
        hits = [(h["fields"].get(id_field, h.get("id")), dict(h["fields"])) for h in connect().query(body=body).hits]
        for _, x in hits:
            x[fields.text] = re.sub(r"<sep ?/>", " ", re.sub(r"</?hi>", "", x.get(fields.text) or ""))
        return _rows(hits, fields)

    return fetch


def documents_held(spark: SparkSession, store: Any) -> DataFrame:
    """Documents of an in-memory store of another framework: one with ``filter_documents()`` (id, content, meta), or with
    a ``docstore`` or ``docs`` by id (text, metadata)."""
    if hasattr(store, "filter_documents"):
        held = [(d.id, d.content, d.meta) for d in store.filter_documents()]
    else:
        held = [(i, getattr(d, "text", None) or d.get_content(), d.metadata) for i, d in getattr(store, "docstore", store).docs.items()]
    rows = [{"source_id": str(i), "text": t, "uri": (m or {}).get("uri"), "source_date": _time((m or {}).get("source_date"))} for i, t, m in held if t]
    return documents(spark, rows)
