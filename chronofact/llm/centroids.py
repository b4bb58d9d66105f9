"""Exact k-means on integers: float32 screening with rounding-error intervals, integers where intervals overlap.

A matrix product in single precision gives each vector an interval for its distance from each centroid that provably holds
the true one. Centroids whose interval begins after another's end are out; where more than one is left, distances are
computed in integers, and equal ones go to the centroid with the smaller number. Sums are exact too, so results depend on
neither partitions nor the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofact.llm.storage import stash, tidy, tune

#: Components up to this size are kept as 32-bit integers: distances of such vectors fit into 64 bits. Rows with greater
#: components are kept as decimal text and handled with integers of any size.
SMALL = 2**27
#: A centroid with a component beyond is further from a row of small components than any centroid of small ones.
FAR = 2**33
#: Bits of the limbs in which sums leave a task; 2**39 tasks' limbs add up in 64 bits.
LIMB = 24
#: Unit roundoff of single precision.
_U = 2.0**-24
ROWS = 4096


def _integers(x: float, scale: int) -> int:
    return int(np.floor(x * scale)) if abs(x) < 2.0**53 else int(x) * scale


def _parsed(dims: int, scale: int):
    """``id, embedding`` to ``id, small, large`` of rows with ``dims`` finite components: 32-bit integers or decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            size = np.where(np.asarray(column.is_valid()), np.diff(np.asarray(column.offsets)), -1)
            flat = column.flatten()
            begin = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
            values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(size == dims)
            x = values[begin[rows][:, None] + np.arange(dims)] if len(rows) else np.zeros((0, dims))
            good = np.isfinite(x).all(1)
            rows, x = rows[good], x[good]
            easy = (np.abs(x) <= SMALL // scale).all(1)
            ints = np.zeros(x.shape, "<i4")
            ints[easy] = np.floor(x[easy] * scale)
            small = [v.tobytes() if e else None for v, e in zip(ints, easy, strict=True)]
            large = [None if e else ",".join(str(_integers(float(c), scale)) for c in v) for v, e in zip(x, easy, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(small, pa.binary()), pa.array(large, pa.string())], names=["id", "small", "large"])

    return run


class Centroids:
    """Centroids of any integers, and what screening needs of those that a row of small components may be nearest to."""

    def __init__(self, rows: list[list[int]]) -> None:
        self.rows = rows
        top = [max(map(abs, c), default=0) for c in rows]
        #: Without a centroid of small components, all rows are compared exactly.
        self.near = [k for k, m in enumerate(top) if m < FAR] if any(m <= SMALL for m in top) else []
        self.exact = np.array([[int(v) for v in rows[k]] for k in self.near], np.int64)
        self.fits = np.array([top[k] <= SMALL for k in self.near], bool)
        self.single = self.exact.astype(np.float32)
        self.square = np.array([float(sum(v * v for v in rows[k])) for k in self.near])
        self.length = np.sqrt(self.square) * (1 + 1e-9)

    def _of_large(self, row: list[int]) -> tuple[int, int]:
        found = [sum((a - b) ** 2 for a, b in zip(row, c, strict=True)) for c in self.rows]
        best = min(range(len(found)), key=lambda k: (found[k], k))
        return best, found[best]

    def _distance(self, x: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Exact squared distances of rows from the near centroids ``k``; objects where they may not fit in 64 bits."""
        wide = not self.fits[k].all()
        difference = x.astype(object if wide else np.int64) - self.exact[k]
        return (difference * difference).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of 32-bit integers the nearest centroid, and how many rows needed integers."""
        if not self.near:
            return np.array([self._of_large([int(v) for v in row])[0] for row in x], np.int64), np.arange(len(x))
        dims = x.shape[1]
        products = x.astype(np.float32) @ self.single.T
        # Both factors are rounded once, and `dims` products and sums once each: relative to sum(|x| |c|), which the
        # lengths' product bounds, the error is below (dims + 4) roundings; what follows is in double precision.
        length = np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        products = products.astype(np.float64)
        middle = self.square - 2 * products
        error = 2.02 * (dims + 4) * _U * length[:, None] * self.length + 2.0**-49 * (self.square + 2 * np.abs(products)) + 2.0**-49
        low, high = middle - error, middle + error
        left = low <= high.min(1, keepdims=True)
        best = left.argmax(1)
        open_rows = np.flatnonzero(left.sum(1) > 1)
        if len(open_rows):
            row, k = np.nonzero(left[open_rows])
            exact = self._distance(x[open_rows[row]], k)
            begin = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
            # The first of the least within each row's run: runs list centroids by number.
            least = np.minimum.reduceat(exact, begin)
            is_least = exact == np.repeat(least, np.diff(np.append(begin, len(row))))
            first = np.flatnonzero(is_least)
            _, at = np.unique(row[first], return_index=True)
            best[open_rows] = k[first[at]]
        return np.array(self.near, np.int64)[best], open_rows

    def distances(self, x: np.ndarray | list[list[int]], cluster: np.ndarray) -> np.ndarray | list[int]:
        """Exact squared distances of rows from their centroids."""
        if isinstance(x, list) or not self.near:
            return [sum((int(a) - b) ** 2 for a, b in zip(row, self.rows[c], strict=True)) for row, c in zip(x, cluster, strict=True)]
        return self._distance(x, np.searchsorted(self.near, cluster))

    def of_batch(self, b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray | list[list[int]], np.ndarray]]:
        """Blocks of rows: their places in the batch, their components, their centroids."""
        small, dims = b.column("small"), len(self.rows[0])
        easy = np.flatnonzero(np.asarray(small.is_valid()))
        for s in range(0, len(easy), ROWS):
            at = easy[s : s + ROWS]
            x = np.frombuffer(b"".join(small.take(pa.array(at)).to_pylist()), "<i4").reshape(-1, dims)
            yield at, x, self.nearest(x)[0]
        hard = np.flatnonzero(~np.asarray(small.is_valid()))
        for at, row in zip(hard, b.column("large").take(pa.array(hard)).to_pylist(), strict=True):
            x = [int(v) for v in row.split(",")]
            yield np.array([at]), [x], np.array([self._of_large(x)[0]])


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """An integer as limbs of LIMB bits; all but the last are not negative."""
    n = 0
    while not -(2**LIMB) < value < 2**LIMB:
        yield n, value % 2**LIMB
        value, n = value >> LIMB, n + 1
    yield n, value


def _sums(model: Centroids):
    """``cluster, dim, limb, s``: a task's exact sums of components, and under dim -1 of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = len(model.rows), len(model.rows[0])
        total = [[0] * dims for _ in range(k)]
        count = [0] * k
        for b in batches:
            for _, x, cluster in model.of_batch(b):
                for c in np.unique(cluster):
                    own = [x[i] for i in np.flatnonzero(cluster == c)] if isinstance(x, list) else x[cluster == c].astype(np.int64)
                    added = [sum(v) for v in zip(*own, strict=True)] if isinstance(x, list) else own.sum(0).tolist()
                    total[c] = [a + v for a, v in zip(total[c], added, strict=True)]
                    count[c] += len(own)
        rows = [(c, d, n, v) for c in range(k) if count[c] for d, value in [(-1, count[c]), *enumerate(total[c])] for n, v in _limbs(value)]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["cluster", "dim", "limb", "s"])

    return run


def _assigned(model: Centroids):
    """``id, cluster, distance``; the distance is null where it doesn't fit in 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, distance = np.zeros(b.num_rows, np.int32), [None] * b.num_rows
            for at, x, own in model.of_batch(b):
                cluster[at] = own
                for i, d in zip(at, model.distances(x, own), strict=True):
                    distance[i] = int(d) if d < 2**63 else None
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])

    return run


def _first(kept: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The vectors of the k smallest hashes of ``<seed>:<id>``, a null id counting as empty; of equal hashes the least vectors."""
    hashed = kept.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256))
    found = hashed.orderBy("h", "small", "large").limit(k).collect()
    return [np.frombuffer(r["small"], "<i4").tolist() if r["small"] is not None else [int(v) for v in r["large"].split(",")] for r in found]


def centroid_clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, dims: int = 64, scale: int = 1024, rounds: int = 10, seed: str = "3") -> DataFrame:
    """Clusters of the vectors by ``rounds`` rounds of k-means on the integers ``floor(scale * x)``, ``scale`` a power of 2.

    One row for each vector of ``dims`` finite components, others are left out: the id, ``cluster`` int, ``distance`` (the
    squared one, long), ``cluster_inertia`` and ``inertia`` (distances summed over the cluster and over all),
    ``centroid_sha256`` (of the final centroid's components, joined by commas). Rows are vectors: a repeated id counts
    each time. First centroids are the vectors with the smallest hashes of ``<seed>:<id>`` (a null id counts as empty), so
    with fewer vectors there are fewer. A mean is rounded down; a centroid without
    vectors stays. Components may be of any finite size; distances and sums that don't fit in 64 bits are null. Other
    columns are not carried. An empty table gives no rows.

    Each round reads the integers once and sends each task's sums, at most ``k * (dims + 1)`` numbers of a few limbs.
    Rounds end early where no centroid moves, as all later ones would be equal.
    """
    spark = df.sparkSession
    tune(spark)
    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    vectors = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = stash(vectors.mapInArrow(tidy(_parsed(dims, scale)), f"id {kind}, small binary, large string"), "integers")
    rows = _first(kept, k, seed)
    schema = f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not rows:
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        sums: dict[tuple[int, int], int] = {}
        parts = kept.select("small", "large").mapInArrow(tidy(_sums(Centroids(rows))), "cluster int, dim int, limb int, s long")
        for r in parts.groupBy("cluster", "dim", "limb").agg(F.sum("s").alias("s")).collect():  # k * (dims + 1) sums, each of a few limbs
            sums[r["cluster"], r["dim"]] = sums.get((r["cluster"], r["dim"]), 0) + (r["s"] << (LIMB * r["limb"]))
        moved = [[sums[c, d] // sums[c, -1] for d in range(dims)] if (c, -1) in sums else old for c, old in enumerate(rows)]
        if moved == rows:
            break
        rows = moved
    out = stash(kept.mapInArrow(tidy(_assigned(Centroids(rows))), f"id {kind}, cluster int, distance long"), "assigned")
    whole = F.sum(F.col("distance").cast("decimal(19,0)"))
    sums_of = out.groupBy("cluster").agg(whole.alias("s"), F.count_if(F.col("distance").isNull()).alias("lost"))  # k rows
    sums_of = sums_of.withColumns({"all": F.sum("s").over(W.partitionBy()), "all_lost": F.sum("lost").over(W.partitionBy())})
    fitting = lambda s, lost: F.when((F.col(lost) == 0) & (F.col(s) <= F.lit(2**63 - 1).cast("decimal(20,0)")), F.col(s).cast("long"))
    digests = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(rows)], "cluster int, centroid_sha256 string")
    inertia = sums_of.select("cluster", fitting("s", "lost").alias("cluster_inertia"), fitting("all", "all_lost").alias("inertia"))
    return out.join(F.broadcast(inertia.join(digests, "cluster")), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
