"""Sparse TF-IDF vectors of character grams, cosine search over them, and the choice of diverse candidates.

Vectors are rows ``id, gram, w`` of unit length, so a dot product is a join and a sum, whatever the number of grams.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofact.durable import saved
from chronofact.operators.conflicts import name_grams
from chronofact.operators.search import ranked

#: Length of grams; rows of queries' grams up to which they are broadcast; candidates that the driver chooses from at once.
GRAM, BROADCAST_GRAMS, BATCH = 3, 200_000, 1024
#: Gains are compared with so many digits.
DIGITS = 12


@dataclass
class Encoder:
    """A fitted encoder: ``idf`` (gram, idf) of the texts it has seen. Grams that it hasn't seen have no weight."""

    idf: DataFrame

    @classmethod
    def fit(cls, texts: DataFrame, text_col: str = "text", features: int | None = None) -> Encoder:
        """Counts in how many texts each gram within words is; ``features`` keeps the most frequent grams. One shuffle."""
        grams = texts.select(name_grams(F.col(text_col), (GRAM,)).alias("g"))
        counted = grams.select(F.explode(F.array_distinct("g")).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
        if features is not None:
            often = grams.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
            counted = counted.join(often.orderBy(F.col("n").desc(), "gram").limit(features).select("gram"), "gram", "left_semi")
        return cls(saved(counted.select("gram", (F.ln(F.lit(1.0 + texts.count()) / (1 + F.col("df"))) + 1).alias("idf"))))

    def vectors(self, texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
        """``id, gram, w`` of unit length; texts without a known gram have no rows, those with a null id neither. Rows that
        repeat an id count once, if their texts are the same."""
        rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id is not null").distinct()
        counted = rows.select("id", F.explode(name_grams(F.col("t"), (GRAM,))).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))
        weighted = counted.join(self.idf, "gram").select("id", "gram", (F.col("tf") * F.col("idf")).alias("w"))
        return weighted.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id"))))


def cosine_topk(vectors: DataFrame, queries: DataFrame, top_k: int | None = 20, digits: int | None = None) -> DataFrame:
    """``query_id, id, score, rank`` by cosine of ``vectors`` (id, gram, w) with ``queries`` (query_id, gram, w). Only
    vectors that share a gram with a query are met. A small batch of queries is broadcast, so that no gram's rows meet in
    one task."""
    asked = queries.select("query_id", "gram", F.col("w").alias("v"))
    asked = F.broadcast(asked) if asked.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS else asked
    score = F.sum(F.col("w") * F.col("v"))
    hits = vectors.join(asked, "gram").groupBy("query_id", "id").agg((score if digits is None else F.round(score, digits)).alias("score"))
    return ranked(hits, top_k)


def similar_texts(encoder: Encoder, texts: DataFrame, queries: DataFrame, top_k: int = 20, digits: int | None = None) -> DataFrame:
    """``query_id, id, score, rank`` by cosine of ``texts`` (id, text) with ``queries`` (query_id, text), as ``cosine_topk``
    of their vectors. Ids with the same texts have the same vector: only the smallest of them are encoded and compared,
    and no more than ``top_k`` of them can be hits.

    Kinds of texts are ranked by score and smallest id. One that ``top_k`` others precede has that many smallest ids
    before all of its own, so the best ids are among those of the best ``top_k`` kinds.
    """
    kinds = lambda df, key: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set("text")).alias("texts"))
    place = F.row_number().over(W.partitionBy("texts").orderBy("id"))
    heads = saved(kinds(texts.select("id", "text"), "id").withColumn("place", place).where(F.col("place") <= top_k))
    asked = saved(kinds(queries.select("query_id", "text"), "query_id"))
    firsts = saved(asked.groupBy("texts").agg(F.min("query_id").alias("first")))
    first = heads.where("place = 1")
    vectors = saved(encoder.vectors(first.select("id", F.explode("texts").alias("text"))))
    of_kinds = encoder.vectors(firsts.select(F.col("first").alias("id"), F.explode("texts").alias("text"))).withColumnRenamed("id", "query_id")
    best = cosine_topk(vectors, of_kinds, top_k, digits).select(F.col("query_id").alias("first"), F.col("id").alias("like"), "score")
    rows = best.join(first.select(F.col("id").alias("like"), "texts"), "like").join(heads.select("id", "texts"), "texts")
    hits = saved(ranked(rows.select(F.col("first").alias("query_id"), "id", "score"), top_k).withColumnRenamed("query_id", "first"))
    return asked.join(firsts, "texts").select("query_id", "first").join(hits, "first").select("query_id", "id", "score", "rank")


def diverse(candidates: DataFrame, vectors: DataFrame, budget: int, batch: int = BATCH) -> DataFrame:
    """``id, place`` of ``budget`` candidates: the first is that of the greatest quality, each further one that of the greatest
    quality times distance from all before it. ``candidates``: id, quality (a null counts as 0); quality is scaled to
    0.5..1, ties go to the smaller id. ``vectors``: id, gram, w; a candidate without is far from all.

    Gains only fall while others are chosen. So the driver takes the ``batch`` best candidates with their grams and
    chooses among them as long as the best one's gain is not below what the first one left out had; only then are the
    gains of all renewed, with the chosen ones' grams broadcast. The choice is the same as over all candidates at once.
    With as many candidates as the budget or fewer, all are taken by quality.
    """
    spark = candidates.sparkSession
    kind = candidates.schema["id"].dataType.simpleString()
    own = candidates.select("id", F.coalesce("quality", F.lit(0.0)).cast("double").alias("quality")).where("id is not null").groupBy("id").agg(F.max("quality").alias("quality"))
    own = saved(own)
    vectors = saved(vectors.join(own.select("id"), "id", "left_semi"))
    size = own.agg(F.count("*").alias("n"), F.max("quality").alias("top")).first()
    if size["n"] <= budget:
        chosen = [r["id"] for r in own.orderBy(F.col("quality").desc(), "id").collect()]  # the budget at most
        return spark.createDataFrame(list(zip(chosen, range(1, len(chosen) + 1))), f"id {kind}, place int")
    state = own.select("id", (0.5 + 0.5 * F.col("quality") / F.lit(size["top"] + 1e-9)).alias("q"), F.lit(0.0).alias("near"))
    chosen: list = []
    while len(chosen) < budget:
        gain = F.round(F.col("q") * (1 - F.col("near")), DIGITS)
        left = state.where(~F.col("id").isin(chosen)) if chosen else state
        rows = left.select("id", "q", "near", gain.alias("gain")).orderBy(F.col("gain").desc(), "id").limit(batch + 1).collect()
        if not rows:
            break
        bound = (rows[batch]["gain"], rows[batch]["id"]) if len(rows) > batch else None
        some = {r["id"]: [r["q"], r["near"]] for r in rows[:batch]}
        grams: dict = {i: {} for i in some}
        picked = spark.createDataFrame([(i,) for i in some], f"id {kind}")
        for r in vectors.join(F.broadcast(picked), "id").collect():  # grams of a batch
            grams[r["id"]][r["gram"]] = r["w"]
        new: list = []
        while some and len(chosen) + len(new) < budget:
            # after the first, a gain is new only by what this batch gave
            best = min(some, key=lambda i: (-round(some[i][0] * (1 - some[i][1]), DIGITS), i))
            worth = round(some[best][0] * (1 - some[best][1]), DIGITS)
            if new and bound is not None and (worth < bound[0] or (worth == bound[0] and best > bound[1])):
                break
            del some[best]
            new.append(best)
            for i, values in some.items():
                values[1] = max(values[1], sum(w * grams[i].get(g, 0.0) for g, w in grams[best].items()))
        chosen += new
        if len(chosen) < budget:
            last = F.broadcast(vectors.join(F.broadcast(spark.createDataFrame([(i,) for i in new], f"id {kind}")), "id").select(F.col("id").alias("of"), "gram", F.col("w").alias("v")))
            met = vectors.join(last, "gram").groupBy("id", "of").agg(F.sum(F.col("w") * F.col("v")).alias("s")).groupBy("id").agg(F.max("s").alias("s"))
            state = saved(state.join(met, "id", "left").select("id", "q", F.greatest("near", F.coalesce("s", F.lit(0.0))).alias("near")))
    return spark.createDataFrame(list(zip(chosen, range(1, len(chosen) + 1))), f"id {kind}, place int")
