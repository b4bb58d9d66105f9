"""Stratified and reservoir samples, near duplicates by SimHash, and greedy selection.

Draws order rows by a hash of id and seed, so they are the same for any partitioning, and need no shuffle of texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from chronofact.durable import saved
from chronofact.functions.texts import domain, script_language
from chronofact.operators.conflicts import earliest

STRATA = ("source_date", "none", "domain", "language", "composite")


def draw_order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def global_rank(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``__rank`` from 0 in an order without ties, and how many there are. Rows are dealt by range and sorted
    there, so no task sorts them all; only a count for each partition comes to the driver."""
    placed = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    before, total = [], 0
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        before.append((r["part"], total))
        total += r["n"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "__part long, __before long"))
    ranked = placed.withColumn("__part", part).join(offsets, "__part").withColumn("__rank", F.col("__before") + place)
    return ranked.drop("__at", "__part", "__before"), total


def deciles(rows: DataFrame, order: list[str]) -> DataFrame:
    """``decile`` 0..9 by rank, as even as ranks allow; null dates go to -1."""
    ranked, total = global_rank(rows.where(F.col(order[0]).isNotNull()), order)
    placed = ranked.withColumn("decile", F.least(F.lit(9), F.floor(F.col("__rank") * 10 / max(1, total))).cast("int")).select(*rows.columns, "decile")
    return placed.unionByName(rows.where(F.col(order[0]).isNull()).withColumn("decile", F.lit(-1)))


def strata(docs: DataFrame, by: str, id_col: str = "source_id") -> DataFrame:
    """``stratum`` of each document."""
    if by not in STRATA:
        raise ValueError(f"strata {by!r}; one of {STRATA}")
    if by == "source_date":
        return deciles(docs, ["source_date", id_col]).withColumnRenamed("decile", "__d").withColumn("stratum", F.col("__d").cast("string")).drop("__d")
    parts = {"none": F.lit("all"), "domain": domain(F.col("uri")), "language": script_language(F.col("text"))} if by != "composite" else {}
    year = F.coalesce(F.year("source_date").cast("string"), F.lit("unknown")) if "source_date" in docs.columns else F.lit("unknown")
    key = parts.get(by)
    if by == "composite":
        key = F.concat_ws("|", year, domain(F.col("uri")), script_language(F.col("text")))
    return docs.withColumn("stratum", key)


def stratified(docs: DataFrame, size: int, seed: int = 0, stratum: str = "stratum", id_col: str = "source_id", distance: int | None = None, text_col: str = "text") -> DataFrame:
    """About equal shares of each stratum, filled up from what is left to ``size`` rows in all. With ``distance``, rows
    whose SimHash is within so many bits of an earlier one's in the draw are passed over, and others drawn instead."""
    if size <= 0:
        return docs.limit(0)
    order = draw_order(id_col, seed)
    columns = [F.col(id_col), F.col(stratum), order.alias("__h"), *([simhash(F.col(text_col)).alias("__s")] if distance is not None else [])]
    keyed = docs.select(*columns)
    each = F.ceil(F.lit(size) / F.greatest(F.lit(1), F.lit(docs.select(stratum).distinct().count())))
    by_stratum = W.partitionBy(stratum).orderBy("__h")
    if distance is not None:
        first = keyed.groupBy("__s").agg(F.min_by(F.struct(id_col, stratum, "__h"), "__h").alias("__r"))  # of equal texts the first one drawn
        turn = first.select("__s", "__r.*").withColumn("__turn", F.row_number().over(by_stratum))
        return docs.join(_apart(turn, each, size, distance, id_col), id_col, "left_semi")
    turn = keyed.withColumn("__turn", F.row_number().over(by_stratum)).where(F.col("__turn") <= size)  # a stratum gives no more, so tasks send no more
    chosen = turn.orderBy((F.col("__turn") > each).cast("int"), "__h").limit(size)
    return docs.join(chosen.select(id_col), id_col, "left_semi")


def _apart(turn: DataFrame, each: Column, size: int, distance: int, id_col: str) -> DataFrame:
    """The first ``size`` rows in the order of the draw that are farther than ``distance`` from all kept before; ids. Rows
    come to the driver a few times ``size`` at a time, ids and hashes only, until enough are kept."""
    ordered = saved(turn.select(id_col, "__s", F.struct((F.col("__turn") > each).cast("int").alias("late"), F.col("__turn") * (F.col("__turn") > each).cast("int"), "__h").alias("__o")))
    kept, hashes, last = [], np.zeros(0, np.uint64), None
    while len(kept) < size:
        rest = ordered if last is None else ordered.where(F.col("__o") > F.struct(*(F.lit(x) for x in last)))
        rows = rest.orderBy("__o").limit(4 * size).collect()
        for r in rows:
            h = np.uint64(r["__s"] & (2**64 - 1))
            if len(kept) < size and not (np.bitwise_count(hashes ^ h) <= distance).any():
                kept.append(r[id_col])
                hashes = np.append(hashes, h)
        if len(rows) < 4 * size:
            break
        last = tuple(rows[-1]["__o"])
    return turn.sparkSession.createDataFrame([(k,) for k in kept], turn.select(id_col).schema)


def reservoir(docs: DataFrame, size: int, seed: int = 0, id_col: str = "source_id") -> DataFrame:
    """A uniform sample of ``size`` rows, as the rows of the least hashes."""
    return docs.orderBy(draw_order(id_col, seed), id_col).limit(max(0, size))


def simhash_of(text: str | None) -> int:
    """Signed 64-bit SimHash of white space separated words, by the last 8 bytes of each one's MD5; 0 without words."""
    words = (text or "").split()
    if not words:
        return 0
    digests = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest()[8:] for w in words), np.uint8).reshape(-1, 8)
    ones = np.unpackbits(digests, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(words)).view(">i8")[0])


@F.pandas_udf(LongType())
def simhash(text: pd.Series) -> pd.Series:
    """SimHash of a text. As lambdas over 64 bits of each word's hash it would be hashed anew for each bit, so it runs in
    Arrow batches."""
    return text.map(simhash_of, na_action=None)


def near_duplicate_pairs(hashes: DataFrame, distance: int = 3, id_col: str = "id", hash_col: str = "simhash") -> DataFrame:
    """Pairs whose SimHashes differ in at most ``distance`` bits: ``left_id, right_id, bits``. Of distance + 1 bands one
    is equal in each such pair; a pair is kept by its first equal band only. Equal hashes are one group beforehand."""
    bands = distance + 1
    width = 64 // bands
    distinct = hashes.groupBy(F.col(hash_col).alias("__h")).agg(F.min(id_col).alias("__id"))
    part = lambda h, b: F.shiftrightunsigned(h, b * width).bitwiseAND(F.lit((1 << width) - 1).cast('long'))
    keyed = distinct.select("__id", "__h", F.posexplode(F.array(*(part("__h", b) for b in range(bands)))).alias("__band", "__key"))
    left, right = (keyed.select(F.col("__id").alias(f"{s}_id"), F.col("__h").alias(f"{s}_h"), "__band", "__key") for s in ("left", "right"))
    bits = F.bit_count(F.col("left_h").bitwiseXOR(F.col("right_h")))
    first = F.lit(None).cast("int")
    for b in reversed(range(bands)):
        first = F.when(part("left_h", b) == part("right_h", b), b).otherwise(first)
    pairs = left.join(right, ["__band", "__key"]).where("left_id < right_id").withColumn("bits", bits).where(F.col("bits") <= distance).where(first == F.col("__band"))
    copies = hashes.join(distinct, hashes[hash_col] == F.col("__h")).where(F.col(id_col) != F.col("__id")).select(F.col("__id").alias("left_id"), F.col(id_col).alias("right_id"), F.lit(0).alias("bits"))
    return pairs.select("left_id", "right_id", "bits").unionByName(copies)


def without_near_duplicates(hashes: DataFrame, distance: int = 3, id_col: str = "id", hash_col: str = "simhash") -> DataFrame:
    """The ids that stay when, in order of id, each text within ``distance`` bits of an earlier one that stays is dropped.

    The same as a filter that looks at one text after another, over any number of them: of equal hashes all but the first
    go; of the others it is decided in rounds, all at once whose nearer neighbours are decided. Null hashes and ids go.
    """
    rows = hashes.select(F.col(id_col).alias("id"), F.col(hash_col).alias("simhash")).where("id is not null and simhash is not null")
    first = saved(rows.groupBy("simhash").agg(F.min("id").alias("id")))
    pairs = near_duplicate_pairs(first, distance, "id", "simhash").select(F.col("right_id").alias("a"), F.col("left_id").alias("b"), (-F.col("bits")).alias("worth"))
    return first.join(earliest(pairs).select(F.col("a").alias("id")), "id", "left_anti").select(F.col("id").alias(id_col))
