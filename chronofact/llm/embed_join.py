"""Near-duplicate vectors by an epsilon grid order join.

Vectors are projected on their leading principal axes and sorted by grid cells as wide as the greatest distance of two
linked unit vectors. The sorted sequence is cut into intervals, each a file in the shared folder with its bounding box;
pairs of intervals are refined level by level, and a pair of which the boxes are too far apart is dropped with all below
it. What is left is compared exactly: only numbers of intervals are shuffled, and workers read the files. Equal vectors
are one node, and no list of pairs is built: intervals give counts and spanning links.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.llm import text as T
from chronofact.llm.components import connected_components
from chronofact.llm.storage import new_folder, read_file, stash, tidy, tune, write_file

#: Axes of the grid order and of bounding boxes; vectors of an interval that moves as a whole, and of one inside it;
#: intervals under one node of the next level.
CELLS, AXES, INTERVAL, INNER, FAN = 6, 16, 2048, 128, 16
#: Intervals that a worker keeps.
KEPT = 6


def _read(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that can be linked, and their vectors."""
    data = column.flatten()
    values = data.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    size = np.where(np.asarray(column.is_valid()), np.diff(np.asarray(column.offsets)), 0)
    begin = np.cumsum(size) - size
    own = [values[b : b + n] for b, n in zip(begin, size, strict=True)]
    good = np.array([bool(len(v)) and bool(np.isfinite(v).all()) and bool(v.any()) for v in own], bool)
    return good, own


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good, own = _read(batch.column(1))
        single = pa.types.is_float32(batch.column(1).type.value_type)
        vectors = [(v + 0.0).astype("<f4" if single else "<f8").tobytes() if g else None for g, v in zip(good, own, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], names=["id", "vector"])


def _matrix(column: pa.Array, dims: int, kind: str) -> np.ndarray:
    """Raw vectors as rows, shorter ones with zeros after them."""
    data, offsets = T.buffers(column)
    flat, width = np.frombuffer(data.tobytes(), kind).astype(np.float64), np.dtype(kind).itemsize
    size = np.diff(offsets) // width
    if (size == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(size), dims))
    out[np.repeat(np.arange(len(size)), size), T.spread(np.zeros(len(size), np.int64), size)] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _axes(vectors: DataFrame, dims: int, kind: str, axes: int) -> np.ndarray:
    """Leading principal axes of all unit vectors; only sums of products (dims**2 numbers) leave the executors."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            x = np.hstack([_unit(_matrix(batch.column(0), dims, kind)), np.ones((batch.num_rows, 1))])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "value"])

    total = np.zeros((dims + 1) ** 2)
    for row in vectors.select("vector").mapInArrow(tidy(sums), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        total[row["at"]] = row["value"]
    total = total.reshape(dims + 1, dims + 1)
    mean = total[dims, :dims] / max(1.0, total[dims, dims])
    _, vectors_of = np.linalg.eigh(total[:dims, :dims] / max(1.0, total[dims, dims]) - np.outer(mean, mean))
    return vectors_of[:, ::-1][:, :axes]


def _far(a: str, b: str, limit: float) -> Column:
    """Whether two boxes are provably farther apart than ``limit`` (squared)."""
    gap = f"zip_with(zip_with({a}_lo, {b}_hi, (x, y) -> x - y), zip_with({b}_lo, {a}_hi, (x, y) -> x - y), (x, y) -> pow(greatest(x, y, 0D), 2))"
    return F.expr(f"aggregate({gap}, 0D, (s, x) -> s + x) > {limit!r}D")


def _labels(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of a bipartite block: a label for each row and column, the least number of a row or column in it."""
    m, n = hit.shape
    rows, columns = np.arange(m), m + np.arange(n)
    while True:
        new = np.minimum(columns, np.where(hit, rows[:, None], m + n).min(0))
        now = np.minimum(rows, np.where(hit, new, m + n).min(1))
        if (new == columns).all() and (now == rows).all():
            return rows, columns
        rows, columns = now, new


@dataclass(frozen=True)
class _Interval:
    """Vectors with their lengths, ids, copies and places on the axes."""

    x: np.ndarray
    length: np.ndarray
    ids: np.ndarray
    copies: np.ndarray
    boxes: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def load(cls, path: str) -> _Interval:
        with np.load(io.BytesIO(read_file(path))) as f:
            x, places = f["x"].astype(np.float64), f["places"].astype(np.float64)
            boxes = [(places[k : k + INNER].min(0), places[k : k + INNER].max(0)) for k in range(0, len(x), INNER)]
            return cls(x, np.sqrt((x * x).sum(1)), f["ids"], f["copies"], boxes)


def _compare(cosine: float, limit: float):
    """Compares pairs of intervals, given by their files and sorted, so that a file is read once for a run of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = lru_cache(KEPT)(_Interval.load)
        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _pair(load(a), load(b), a == b, cosine, limit)

    return run


def _pair(a: _Interval, b: _Interval, same: bool, cosine: float, limit: float) -> pa.RecordBatch:
    links_a, links_b, edges = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64), []
    for p, (lo, hi) in enumerate(a.boxes):
        for q, (low, high) in enumerate(b.boxes):
            if same and q < p or (np.maximum(np.maximum(lo - high, low - hi), 0) ** 2).sum() > limit:
                continue
            i, j = slice(p * INNER, (p + 1) * INNER), slice(q * INNER, (q + 1) * INNER)
            hit = (a.x[i] @ b.x[j].T) / (a.length[i][:, None] * b.length[j]) >= cosine
            if same and p == q:
                np.fill_diagonal(hit, False)
            if not hit.any():
                continue
            links_a[i] += hit @ b.copies[j]
            if not (same and p == q):
                links_b[j] += a.copies[i] @ hit
            rows, columns = _labels(hit)
            both = np.concatenate([a.ids[i], b.ids[j]])
            label = np.concatenate([rows, columns])
            moved = label != np.arange(len(label))
            edges.append(np.stack([both[moved], both[label[moved]]], 1))
    if same:
        links_a, links_b = links_a + links_b, links_b * 0
    edges = np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), np.int64)
    edges = edges[edges[:, 0] != edges[:, 1]]
    x = np.concatenate([a.ids[links_a > 0], b.ids[links_b > 0], edges[:, 0]])
    y = np.concatenate([links_a[links_a > 0], links_b[links_b > 0], edges[:, 1]])
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(x)) >= len(x) - len(edges)), pa.array(x), pa.array(y)], names=["link", "x", "y"])


def _intervals(axes: np.ndarray, dims: int, kind: str, width: int, folder: str):
    """Cuts a sorted partition into intervals of ``width`` vectors, each a file, with their bounding boxes."""

    def cut(rows: pa.Table, part: int, number: int) -> pa.RecordBatch:
        x = _matrix(rows.column("vector").combine_chunks(), dims, kind)
        places = (_unit(x) @ axes).astype(np.float32)
        lo, hi = places.min(0).astype(np.float64), places.max(0).astype(np.float64)
        data = io.BytesIO()
        np.savez(data, x=x.astype(kind), places=places, ids=rows.column("id").to_numpy(), copies=rows.column("copies").to_numpy())
        values, types = [part, number, lo, hi, write_file(folder, data.getvalue())], [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], ty) for v, ty in zip(values, types, strict=True)], names=["part", "number", "lo", "hi", "path"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, part = [], 0, TaskContext.get().partitionId()
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            while table.num_rows >= width:
                yield cut(table.slice(0, width), part, number)
                table, number = table.slice(width), number + 1
            held = table.combine_chunks().to_batches()
        if held and sum(b.num_rows for b in held):
            yield cut(pa.Table.from_batches(held), part, number)

    return run


def near_vectors(df: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", interval: int = INTERVAL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row.

    Vectors are linked if their cosine in double precision is ``cosine`` (over 0, under 1) or more; ``n_links`` counts
    the other rows linked directly, ``component_id`` is the smallest id that links reach and ``kept`` says that it is
    the row's own. Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id
    (their component is null, they are kept) are linked with nothing. Of vectors of several lengths, shorter ones count
    as followed by zeros. Rows with equal vectors count as linked. Other columns are not carried.
    """
    tune(df.sparkSession)
    spark = df.sparkSession
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    kind = "<f4" if source.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"
    parsed = source.mapInArrow(tidy(_parse), "id long, vector binary").withColumn("vector", F.when(F.col("id").isNotNull(), F.col("vector")))
    base = stash(parsed.withColumns({"k1": F.when(F.col("vector").isNotNull(), F.xxhash64("vector")), "k2": F.xxhash64(F.lit(1), "vector")}), "vectors")
    nodes = base.where("k1 is not null").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    nodes = stash(nodes, "vector-nodes")
    widest = nodes.agg(F.max(F.length("vector"))).first()[0] or 0
    rows = base.select("id", "k1", "k2")
    if not widest:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    dims = widest // np.dtype(kind).itemsize
    axes = _axes(nodes, dims, kind, min(AXES, dims))
    eps = float(np.sqrt(2 - 2 * cosine))
    limit = eps * eps + 1e-5  # the projections are kept in single precision
    cells = min(CELLS, axes.shape[1])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _unit(_matrix(batch.column(2), dims, kind)) @ axes[:, :cells]
            cell = pa.array(list(np.floor(p / eps).astype(np.int32)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cell, pa.array(p[:, 0])], names=["id", "copies", "vector", "cell", "first"])

    order = nodes.select("id", "copies", "vector").mapInArrow(tidy(placed), "id long, copies long, vector binary, cell array<int>, first double")
    order = order.repartitionByRange("cell", "first", "id").sortWithinPartitions("cell", "first", "id")
    schema = "part long, number long, lo array<double>, hi array<double>, path string"
    intervals = stash(order.mapInArrow(tidy(_intervals(axes, dims, kind, interval, new_folder(spark, "interval-files"))), schema), "intervals")
    before, total = [], 0
    for r in sorted(intervals.groupBy("part").agg(F.max("number").alias("last")).collect()):
        before.append((r["part"], total))
        total += r["last"] + 1
    numbered = intervals.join(F.broadcast(spark.createDataFrame(before, "part long, before long")), "part").withColumn("node", F.col("before") + F.col("number"))
    levels, height = [numbered.select("node", "lo", "hi")], 0
    while FAN**height < total:
        height += 1
        box = [f(F.element_at(side, i + 1)).alias(f"{side}{i}") for side, f in (("lo", F.min), ("hi", F.max)) for i in range(axes.shape[1])]
        up = levels[-1].groupBy(F.floor(F.col("node") / FAN).cast("long").alias("node")).agg(*box)
        levels.append(up.select("node", *(F.array(*(f"{side}{i}" for i in range(axes.shape[1]))).alias(side) for side in ("lo", "hi"))))
    pairs = spark.createDataFrame([(0, 0)], "a long, b long")
    for level in reversed(levels[:-1]):
        below = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1)).alias(c)
        pairs = pairs.select(below("a"), "b").select("a", below("b")).where("a <= b")
        for side in "ab":
            pairs = pairs.join(level.select(F.col("node").alias(side), F.col("lo").alias(f"{side}_lo"), F.col("hi").alias(f"{side}_hi")), side)
        pairs = stash(pairs.where(~_far("a", "b", limit)).select("a", "b"), "interval-pairs")
    for side in "ab":
        pairs = pairs.join(numbered.select(F.col("node").alias(side), F.col("path").alias(f"{side}_path")), side)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 8)  # stated, as rows of names are small and their work is not
    pairs = pairs.repartitionByRange(tasks, "a", "b").sortWithinPartitions("a", "b").select("a_path", "b_path")
    found = stash(pairs.mapInArrow(tidy(_compare(cosine, limit)), "link boolean, x long, y long"), "vector-links")
    counts = found.where("not link").groupBy(F.col("x").alias("id")).agg(F.sum("y").alias("others"))
    roots = connected_components(found.where("link"), "x", "y").withColumnRenamed("node", "id")
    result = nodes.select("id", "k1", "k2", "copies").join(counts, "id", "left").join(roots, "id", "left").where("copies > 1 or others is not null").select("k1", "k2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("root", "id").alias("root"))
    component = F.coalesce("root", "id")
    return rows.join(result, ["k1", "k2"], "left").select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
