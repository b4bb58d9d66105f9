"""An inverted file of vectors: cells around centroids, kept as Parquet partitioned by cell.

Centroids are fitted by k-means on a bounded sample; every vector is indexed. A search routes each query to the cells whose
centroids are nearest and reads those partitions alone. With ``exact``, cells that could hold a better vector than those
found, by their radius, are read as well, so the result is that of an exact scan; without, as many cells answer as were
found to hold the wanted share of true hits when the index was built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.durable import saved
from chronofact.operators.search import QUERY_BLOCK, _best, ranked

#: Bounds of the sample that centroids are fitted on and of their number, which else is the root of the vectors' number.
SAMPLE, MOST_CELLS = 100_000, 4096
#: Queries, hits and share of true hits by which the number of cells that answer is found.
CALIBRATION, HITS, RECALL = 256, 10, 0.95
#: Vectors in a file of a cell: a cell with more is dealt to several tasks and files.
FILE_ROWS = 100_000
#: Relative rounding error that bounds of cells are widened by.
SLACK = 1e-9

METRICS = ("dot", "cosine", "l2")


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array, dims: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``dims`` finite components, and these as a matrix; of unit length for cosine."""
    at = np.asarray(column.offsets)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    # null lists may span values that flatten() leaves out, so sizes count from the valid ones
    size = np.where(np.asarray(column.is_valid()), np.diff(at), 0)
    begin = np.cumsum(size) - size
    rows = np.flatnonzero(size == dims)
    x = flat[begin[rows][:, None] + np.arange(dims)] if len(rows) else np.zeros((0, dims))
    x = _unit(x) if metric == "cosine" else x
    good = np.isfinite(x).all(1)
    return rows[good], x[good]


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x from all rows of y."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))


def _assigned(centroids, metric: str):
    """``id, vector`` to ``cell, away, id, vector``: nearest centroid and the distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        for b in batches:
            rows, x = _matrix(b.column(1), c.shape[1], metric)
            for s in range(0, len(rows), 4096):
                own, part = rows[s : s + 4096], x[s : s + 4096]
                cell = _apart(part, c).argmin(1)
                away = np.sqrt(((part - c[cell]) ** 2).sum(1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * c.shape[1]), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(away), b.column(0).take(pa.array(own)), lists], names=["cell", "away", "id", "vector"])

    return run


def _compared(shared, top_k: int, metric: str, margin: float):
    """``cell, id, vector`` to ``query, id, score``: each cell's vectors against the queries that ask for the cell; of each
    query a task sends its best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, asked = shared.value  # queries as rows, and for each cell the numbers of those that ask for it
        held = [np.zeros(0, np.int64), np.zeros(0, np.float64), None]
        for b in batches:
            cells = b.column(0).to_numpy(zero_copy_only=False)
            rows, x = _matrix(b.column(2), queries.shape[1], "dot")
            held[2] = b.column(1).slice(0, 0) if held[2] is None else held[2]
            parts = [[held[0]], [held[1]], [held[2]]]
            for cell in np.unique(cells[rows]):
                own = np.flatnonzero(cells[rows] == cell)
                of = asked.get(int(cell), np.zeros(0, np.int64))
                for s in range(0, len(of), 512):
                    some = of[s : s + 512]
                    scores = -_apart(queries[some], x[own]) if metric == "l2" else queries[some] @ x[own].T
                    good = np.isfinite(scores)
                    if len(own) > top_k:
                        good &= scores >= np.partition(scores, -top_k, axis=1)[:, -top_k, None] - margin
                    q, r = np.nonzero(good)
                    parts[0].append(some[q])
                    parts[1].append(scores[q, r])
                    parts[2].append(b.column(1).take(pa.array(rows[own[r]])))
            query, score, ids = np.concatenate(parts[0]), np.concatenate(parts[1]), pa.concat_arrays(parts[2])
            held = _best([query, score, ids], top_k, margin) if len(query) else held
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), held[2], pa.array(held[1])], names=["query", "id", "score"])

    return run


@dataclass
class VectorIndex:
    """Cells of an index in a folder: ``<path>/cells`` (cell, centroid, radius, n) and ``<path>/vectors`` by cell."""

    spark: SparkSession
    path: str
    metric: str
    #: Type of the ids.
    kind: str
    centroids: np.ndarray
    radius: np.ndarray
    #: Cells that a search asks unless told otherwise.
    probes: int = 1

    @classmethod
    def build(cls, vectors: DataFrame, path: str, metric: str = "dot", cells: int | None = None, sample: int = SAMPLE, seed: int = 0, recall: float = RECALL) -> VectorIndex:
        """Indexes ``vectors`` (id, vector). Null vectors, those with another length than most of the sample's, and those
        with components that are null or not finite are no hits of any search and left out.

        One pass counts, one fits on about ``sample`` vectors chosen by a hash of their id, one writes, and exact searches
        for some of the vectors find the number of cells to ask (``calibrated``). The driver gets the centroids, MOST_CELLS
        at most unless ``cells`` says otherwise.
        """
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric}")
        spark = vectors.sparkSession
        own = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
        sizes = own.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dims").first()
        dims, n = (sizes["dims"], sizes["n"]) if sizes else (0, 0)
        wanted = cells or min(MOST_CELLS, max(1, round(n**0.5)))
        good = own.where((F.size("vector") == dims) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
        if metric == "cosine":
            length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v))
            good = good.withColumn("length", length).where("length > 0").select("id", F.transform("vector", lambda v: v / F.col("length")).alias("vector"))
        part = min(1.0, sample / max(1, n))
        some = good.where(F.xxhash64("id", F.lit(seed)).bitwiseAND(F.lit(2**63 - 1)) <= F.lit(min(2**63 - 1, int(part * 2**63)))) if part < 1 else good
        features = saved(some.select(array_to_vector("vector").alias("features")))
        if features.limit(1).count():
            model = KMeans(k=wanted, seed=seed, maxIter=10).fit(features) if wanted > 1 else None
            centroids = np.array(model.clusterCenters()) if model else np.array([features.first()["features"].toArray()])
        else:
            centroids = np.zeros((1, dims))
        index = cls(spark, path, metric, own.schema["id"].dataType.simpleString(), centroids, np.zeros(len(centroids)))
        index._write(own, "overwrite")
        some = own.orderBy(F.xxhash64("id", F.lit(seed + 1))).limit(CALIBRATION)
        return index._measured().calibrated(some.select(F.monotonically_increasing_id().alias("query_id"), "vector"), recall)

    def _write(self, vectors: DataFrame, mode: str) -> None:
        placed = vectors.mapInArrow(_assigned(self.spark.sparkContext.broadcast(self.centroids), self.metric), f"cell int, away double, id {self.kind}, vector array<double>")
        placed = saved(placed)
        files = placed.groupBy("cell").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("files"))
        dealt = placed.join(F.broadcast(files), "cell").withColumn("file", F.pmod(F.xxhash64("id"), F.col("files")))  # a row for each cell
        dealt.repartition("cell", "file").drop("files", "file").write.partitionBy("cell").mode(mode).parquet(f"{self.path}/vectors")

    def _measured(self) -> VectorIndex:
        """Counts vectors and radius of each cell and keeps them beside the vectors."""
        found = {r["cell"]: r for r in self._vectors().groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()}  # a row for each cell
        rows = [(k, self.metric, self.kind, self.probes, c.tolist(), float(found[k]["radius"]) if k in found else -1.0, found[k]["n"] if k in found else 0) for k, c in enumerate(self.centroids)]
        self.spark.createDataFrame(rows, "cell int, metric string, kind string, probes int, centroid array<double>, radius double, n long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells")
        self.radius = np.array([r[5] for r in rows])
        return self

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])  # MOST_CELLS of them
        return cls(spark, path, rows[0]["metric"], rows[0]["kind"], np.array([r["centroid"] for r in rows]), np.array([r["radius"] for r in rows]), rows[0]["probes"])

    def calibrated(self, queries: DataFrame, recall: float = RECALL, top_k: int = HITS) -> VectorIndex:
        """Sets the number of cells to ask to the least with which so many of these queries' ``top_k`` exact hits are found:
        the cells of the hits are looked up in the order in which the query would ask them. A bounded number of queries."""
        asked = saved(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")))
        hits = self.search(asked, top_k, exact=True).join(self._vectors().select("id", "cell"), "id").select("query_id", "cell")
        found = hits.join(asked, "query_id").select("vector", "cell").toArrow().combine_chunks()
        if found.num_rows:
            rows, x = _matrix(found.column("vector").combine_chunks(), self.centroids.shape[1], self.metric)
            middle = self._bounds(x)[0]
            own = middle[np.arange(len(rows)), found.column("cell").to_numpy()[rows]]
            place = np.sort((middle > own[:, None]).sum(1) + 1)
            self.probes = int(place[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)])
        return self._measured()

    def add(self, vectors: DataFrame) -> VectorIndex:
        """Puts more vectors into the cells that there are; ids that are in the index already stay as well."""
        self._write(vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null"), "append")
        return self._measured()

    def _vectors(self, cells: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"away double, id {self.kind}, vector array<double>, cell int").parquet(f"{self.path}/vectors")
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def _bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and cell the centroid's score, and a score that no vector of the cell exceeds."""
        if self.metric == "l2":
            middle = -_apart(queries, self.centroids)
            bound = np.minimum(middle + self.radius, 0)
        else:
            middle = queries @ self.centroids.T
            bound = middle + np.sqrt((queries * queries).sum(1))[:, None] * self.radius
        bound = bound + SLACK * (1 + np.abs(middle) + np.abs(bound))
        return np.where(self.radius >= 0, middle, -np.inf), np.where(self.radius >= 0, bound, -np.inf)

    def search(self, queries: DataFrame, top_k: int = 20, probes: int | None = None, exact: bool = False, digits: int | None = None, candidates: DataFrame | None = None) -> DataFrame:
        """``query_id, id, score, rank`` as of ``search.dense``: of ``probes`` cells for each query (by default as many as
        were found to do), or with ``exact`` of all
        cells that may hold a hit. ``queries``: query_id, vector; those of another length than the index's have no hits.
        ``candidates`` (id) are the vectors that may be hits, by default all.

        Queries go in blocks of QUERY_BLOCK, routed on the driver and broadcast; only the partitions of the cells that a
        block asks for are read, and each task sends its best of each query.
        """
        asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
        kind, margin = asked.schema["query_id"].dataType.simpleString(), 0.0 if digits is None else 10.0**-digits
        blocks, found = max(1, -(-asked.count() // QUERY_BLOCK)), None
        for block in range(blocks):
            table = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow().combine_chunks()  # about QUERY_BLOCK rows
            rows, x = _matrix(table.column("vector").combine_chunks(), self.centroids.shape[1], self.metric) if table.num_rows else (np.zeros(0, np.int64), np.zeros((0, self.centroids.shape[1])))
            names = self.spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(rows))), "query_id": table.column("query_id").take(pa.array(rows))}))
            hits = self._block(x, top_k, probes or self.probes, exact, margin, candidates).join(F.broadcast(names), "query").select(F.col("query_id").cast(kind).alias("query_id"), "id", "score")
            found = hits if found is None else found.unionByName(hits)
        return ranked(found.select("query_id", "id", (F.col("score") if digits is None else F.round("score", digits)).alias("score")), top_k)

    def _block(self, x: np.ndarray, top_k: int, probes: int, exact: bool, margin: float, candidates: DataFrame | None) -> DataFrame:
        middle, bound = self._bounds(x)
        first = np.zeros(middle.shape, bool)
        some = min(probes, middle.shape[1])
        np.put_along_axis(first, np.argsort(-middle, axis=1, kind="stable")[:, :some], True, 1)
        first &= np.isfinite(middle)
        hits = self._read(x, first, top_k, margin, candidates)
        if not exact:
            return hits
        hits = saved(hits)
        last = F.col("rank") == top_k
        least = ranked(hits.withColumnRenamed("query", "query_id"), top_k).where(last).select("query_id", "score").collect()  # a number for each query
        floor = np.full(len(x), -np.inf)
        for r in least:
            floor[r["query_id"]] = r["score"]
        return hits.unionByName(self._read(x, ~first & (bound >= floor[:, None] - margin) & np.isfinite(bound), top_k, margin, candidates))

    def _read(self, x: np.ndarray, wanted: np.ndarray, top_k: int, margin: float, candidates: DataFrame | None) -> DataFrame:
        """Hits of queries in the cells that they want; the partitions of other cells are not read."""
        cells = np.flatnonzero(wanted.any(0)).tolist()
        shared = self.spark.sparkContext.broadcast((x, {c: np.flatnonzero(wanted[:, c]) for c in cells}))
        vectors = self._vectors(cells) if candidates is None else self._vectors(cells).join(candidates.select("id").distinct(), "id", "left_semi")
        return vectors.select("cell", "id", "vector").mapInArrow(_compared(shared, top_k, self.metric, margin), f"query long, id {self.kind}, score double")
