"""Postings in blocks with bounds, in segments that changes add to, for search that reads only blocks that can win.

A block holds one term's postings of one set of documents, with its greatest count and its shortest text: no score in it is
above what these two give, whatever the mean length becomes. A search reads the bounds of its terms, scores the blocks of
the greatest sums first, and then only blocks whose sum reaches the last rank so far. Documents are put into sets by their
length, so that bounds are tight. A change writes a segment of what came and what went; nothing written is changed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.durable import saved
from chronofact.functions.analysis import terms, words
from chronofact.operators.search import B, BROADCAST_TERMS, K1, MIN_IDF, _asked, postings, ranked

#: Documents of a block, about; blocks of a query that are scored before any bound is compared; segments from which on a
#: change merges all.
BLOCK, FIRST, MERGE = 1024, 4, 16
#: Relative rounding error that bounds are widened by.
SLACK = 1e-9
#: Terms up to which a search names them in the scan's filter.
NAMED = 1000


#: Lets the files of a job's shuffles go when it ends; what a later job needs is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def _part(tf: Column, length: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))


@dataclass
class BlockIndex:
    """Segments ``<path>/s<n>`` of blocks, document frequencies, ids that went, and one row of totals, written last."""

    spark: SparkSession
    path: str
    #: Type of the ids.
    kind: str

    # --- segments -------------------------------------------------------------------------------------------------------
    def segments(self) -> list[int]:
        """Numbers of the segments that count: those from the last merged one on whose totals are complete."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        done = [m for s in fs.listStatus(folder) if (m := re.fullmatch(r"s(\d+)(w?)", s.getPath().getName())) and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "totals/_SUCCESS"))]
        found = sorted((int(m[1]), m[2]) for m in done)
        whole = max((n for n, w in found if w), default=0)  # of a number, the whole one replaces all before it
        return sorted({n for n, _ in found if n >= whole})

    def _folder(self, n: int) -> str:
        jvm = self.spark.sparkContext._jvm
        whole = jvm.org.apache.hadoop.fs.Path(f"{self.path}/s{n}w/totals/_SUCCESS")
        return f"{self.path}/s{n}w" if whole.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(whole) else f"{self.path}/s{n}"

    def _read(self, name: str, schema: str) -> DataFrame:
        found = [self.spark.read.schema(schema).parquet(f"{self._folder(n)}/{name}").withColumn("segment", F.lit(n)) for n in self.segments()]
        out = found[0] if found else self.spark.createDataFrame([], schema).withColumn("segment", F.lit(0))
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def blocks(self) -> DataFrame:
        return self._read("blocks", f"term string, block long, max_tf long, min_length int, n long, tokens long, rows array<struct<id:{self.kind},tf:bigint,length:int>>")

    def change(self, added: DataFrame, gone: DataFrame | None = None, label: str = "") -> BlockIndex:
        """A segment of texts (id, text) that came and that went; an id may do both, if its text changed. One shuffle by term
        and document, one by term and block. ``label`` is kept beside the totals."""
        now = self.segments()
        if len(now) >= MERGE:
            raise ValueError("merge first")
        with _shuffles_dropped(self.spark):
            return self._write(f"s{now[-1] + 1 if now else 1}", added, gone, label)

    def rebuilt(self, texts: DataFrame, label: str = "") -> BlockIndex:
        """All texts (id, text) in one segment, in place of all before it."""
        now = self.segments()
        with _shuffles_dropped(self.spark):
            return self._write(f"s{now[-1] + 1 if now else 1}w", texts, None, label)

    def _write(self, name: str, added: DataFrame, gone: DataFrame | None, label: str) -> BlockIndex:
        path = f"{self.path}/{name}"
        # sets of documents by length, in steps of an eighth of a doubling, and by hash where a step has many
        step = F.floor(F.log2(F.greatest(F.col("length"), F.lit(1)).cast("double")) * 8).cast("long")
        sizes = added.select(F.size(words(F.col("text"))).alias("length")).groupBy(step.alias("step")).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
        placed = postings(added.select("id", "text"), "id", "text").withColumn("step", step).join(F.broadcast(sizes), "step", "left")  # a row for each step: under 300
        block = F.col("step") * F.lit(2**40) + F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1).cast("long")))
        rows = placed.withColumn("block", block).groupBy("term", "block").agg(F.max("tf").alias("max_tf"), F.min("length").alias("min_length"), F.count("*").alias("n"), F.sum("tf").alias("tokens"), F.collect_list(F.struct("id", "tf", "length")).alias("rows"))
        rows.sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/blocks")  # dealt by term and block already
        came = self.spark.read.parquet(f"{path}/blocks")
        counts, total = came.select("term", F.col("n").alias("d")), added.select(F.lit(1).alias("d")).withColumn("tokens", F.lit(0).cast("long"))
        tokens = came.agg(F.sum("tokens").alias("tokens")).select(F.lit(0).alias("d"), "tokens")
        if gone is not None:
            went = saved(postings(gone.select("id", "text"), "id", "text"))
            counts = counts.unionByName(went.select("term", F.lit(-1).cast("long").alias("d")))
            total = total.unionByName(gone.select(F.lit(-1).alias("d"), F.lit(0).cast("long").alias("tokens")))
            tokens = tokens.unionByName(went.agg((-F.sum("tf")).alias("tokens")).select(F.lit(0).alias("d"), "tokens"))
        counts.groupBy("term").agg(F.sum("d").cast("long").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
        (gone.select("id").distinct() if gone is not None else self.spark.createDataFrame([], f"id {self.kind}")).write.mode("overwrite").parquet(f"{path}/gone")
        totals = total.unionByName(tokens).agg(F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("n_texts"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens")).withColumn("label", F.lit(label))
        totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
        return self

    def label(self) -> str | None:
        """That of the last segment."""
        now = self.segments()
        return self.spark.read.parquet(f"{self._folder(now[-1])}/totals").first()["label"] if now else None

    # --- search ---------------------------------------------------------------------------------------------------------
    def bm25(self, queries: DataFrame, candidates: DataFrame | None = None, top_k: int | None = 20, digits: int | None = None) -> DataFrame:
        """``query_id, id, score, rank``, the same rows as ``search.bm25`` over all living texts.

        Bounds are read without the postings beside them. The blocks that a query's first FIRST sums of bounds point at are
        scored, and its last rank's score excludes most others. With ``candidates`` only they count for that score.
        """
        asked = saved(_asked(queries, terms))
        number = self._read("totals", "n_texts long, tokens long, label string").agg(F.sum("n_texts").alias("n"), F.sum("tokens").alias("tokens")).first()
        n, mean = number["n"] or 0, (number["tokens"] or 0) / max(1, number["n"] or 0) or 1.0
        wanted = asked.select("term").distinct()
        names = [r["term"] for r in wanted.limit(NAMED + 1).collect()]

        def of_terms(df: DataFrame) -> DataFrame:
            """Rows of the queries' terms: named in the scan's filter where they are few."""
            return df.where(F.col("term").isin(names)) if len(names) <= NAMED else df.join(wanted, "term", "left_semi")

        df = of_terms(self._read("terms", "term string, df long")).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        idf = F.greatest(F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(MIN_IDF))
        asked = saved(asked.join(df, "term").select("query_id", "wanted", "term", idf.alias("idf")))
        asked = F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked
        heads = of_terms(self.blocks().drop("rows", "tokens")).join(asked, "term")
        bound = F.sum(F.col("idf") * _part(F.col("max_tf"), F.col("min_length"), mean)) * (1 + SLACK)
        sums = heads.groupBy("query_id", "wanted", "segment", "block").agg(bound.alias("score"), F.count("*").alias("found")).where("found = wanted").drop("found")
        if top_k is None:
            return ranked(self._scored(sums, asked, of_terms, candidates, mean, digits), None)
        sums = saved(sums)
        place = sums.withColumn("id", F.struct("segment", "block"))
        first = saved(ranked(place, max(FIRST, -(-top_k // BLOCK))).drop("id", "rank"))
        best = saved(self._scored(first, asked, of_terms, candidates, mean, digits))
        least = ranked(best, top_k).where(F.col("rank") == top_k).select("query_id", F.col("score").alias("least"))
        rest = sums.join(first.select("query_id", "segment", "block"), ["query_id", "segment", "block"], "left_anti").join(least, "query_id", "left")
        margin = 0.0 if digits is None else 10.0**-digits
        rest = rest.where(F.col("least").isNull() | (F.col("score") >= F.col("least") - margin)).drop("least")
        return ranked(best.unionByName(self._scored(rest, asked, of_terms, candidates, mean, digits)), top_k)

    def _scored(self, wanted: DataFrame, asked: DataFrame, of_terms, candidates: DataFrame | None, mean: float, digits: int | None) -> DataFrame:
        """``query_id, id, score`` of the living texts in the wanted blocks (query_id, segment, block) that hold all terms."""
        need = saved(wanted.drop("score", "wanted").join(asked, "query_id"))
        need = F.broadcast(need) if need.count() <= BROADCAST_TERMS else need
        rows = of_terms(self.blocks()).join(need, ["term", "segment", "block"]).select("query_id", "wanted", "segment", "idf", F.explode("rows").alias("p")).select("query_id", "wanted", "segment", "idf", "p.*")
        part = F.col("idf") * _part(F.col("tf"), F.col("length"), mean)
        hits = rows.groupBy("query_id", "wanted", "segment", "id").agg(F.sum(part).alias("score"), F.count("*").alias("found")).where("found = wanted")
        if len(self.segments()) > 1:
            dead = self._read("gone", f"id {self.kind}").select("id", F.col("segment").alias("until"))
            hits = hits.join(dead, (hits["id"] == dead["id"]) & (hits["segment"] < dead["until"]), "left_anti")
        if candidates is not None:
            hits = hits.join(candidates.distinct(), [c for c in ("query_id", "id") if c in candidates.columns], "left_semi")
        return hits.select("query_id", "id", (F.col("score") if digits is None else F.round("score", digits)).alias("score"))
