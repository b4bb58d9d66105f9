"""Connected components of a link table, without collecting it: alternating star contraction over shuffles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.llm.storage import stash, tidy


def spanning_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contracts the links of one partition: each node goes with the smallest node that these links reach."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (nxt := up.get(top, top)) != top:
            top = nxt
        while (nxt := up.get(x, x)) != top:
            up[x], x = top, nxt
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    for k in range(0, len(nodes), 50_000):
        part = nodes[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["a", "b"])


#: A node with more links than this, and more than one in MOST of all, is joined apart: there are 2 * MOST such nodes at most.
HEAVY, MOST = 256, 10_000


def _with_least(ends: DataFrame, n: int) -> DataFrame:
    """``a, b, m`` for each row of ``ends``, m the least b of that a. The rows of nodes with very many links are not dealt
    by node: these nodes' minima are broadcast, a bounded number."""
    least = ends.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
    heavy = F.broadcast(least.where(F.col("k") > max(HEAVY, n // MOST)).select("a", "m"))
    light = ends.join(heavy, "a", "left_anti").join(least.select("a", "m"), "a")
    return light.union(ends.join(heavy, "a"))


def connected_components(links: DataFrame, a: str = "a", b: str = "b", contracted: bool = False) -> DataFrame:
    """``(node, root)`` for each node with a link to another one; the root is its component's smallest node. Where links
    come out of ``spanning_stars`` already (``contracted``), they need no Python worker here.

    Links may repeat, point either way or at themselves; those with a null end are ignored. Every round is written to
    the shared folder. Minima are aggregated before they are joined, and hubs of stars are joined by broadcast.
    """
    links = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    links = links if contracted else links.mapInArrow(tidy(spanning_stars), "a long, b long")
    links, before = stash(links, "stars"), None
    while True:
        now = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if not now["n"] or now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * now["n"]).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = stash(large, "large-stars")
        small = _with_least(large, now["n"]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        links = stash(small.select("x.*").where("a <> b").distinct(), "stars")
