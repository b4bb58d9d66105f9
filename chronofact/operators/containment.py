"""Which texts contain which others, by joins on runs of words.

An item of three words or more can only be in a text that has the item's inner words as whole words, one after another.
So each item is looked up by one run of them, the rarest in the texts of a few, and compared at that place. The words of
a shorter item may all be parts of the text's words; it is looked up in the vocabulary.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.durable import saved
from chronofact.functions.texts import qa_normal

#: Words of a run at most; runs of an item whose texts are counted; items that are looked up in one pass over the texts.
RUN, CHOICES, BLOCK = 4, 8, 50_000


def containing(texts: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """``item_id, doc_id`` for each row of ``items`` (item_id, expected) and each row of ``texts`` (doc_id, text) that
    contains it as ``contains_expected`` does. Rows that repeat an id count each, ids may be null.

    Each text is normalised once. A pass over the texts takes about ``block`` items, of which the longer ones are
    broadcast.
    """
    number = F.monotonically_increasing_id()
    given = saved(texts.select(number.alias("row"), "doc_id", qa_normal(F.col("text")).alias("normal")))
    wanted = saved(items.select(number.alias("item"), "item_id", qa_normal(F.col("expected")).alias("expected")).where("expected <> ''"))
    size = F.size(F.split("expected", " "))
    short, long = wanted.where(size < 3), wanted.where(size >= 3)
    blocks = -(-long.count() // block)
    found = [_long(given, long.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)) for b in range(blocks)]
    if not short.isEmpty():
        found.append(_short(given, short))
    if not found:
        return items.crossJoin(texts).select("item_id", "doc_id").limit(0)
    return reduce(DataFrame.union, found).dropDuplicates(["row", "item"]).select("item_id", "doc_id")


def _run(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *(F.get(words, at + j) for j in range(size)))


def _long(given: DataFrame, items: DataFrame) -> DataFrame:
    split = items.withColumn("words", F.split("expected", " ")).withColumn("n", F.size("words"))
    places = split.select("item", "words", "n", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - 1 - RUN))).alias("at"))
    key = F.xxhash64("item")  # never taken, as a longer item's run is as long as its inner words or RUN
    for size in range(1, RUN + 1):
        key = F.when(F.least(F.col("n") - 2, F.lit(RUN)) == size, _run(F.col("words"), F.col("at"), size)).otherwise(key)
    runs = places.select("item", "at", F.least(F.col("n") - 2, F.lit(RUN)).alias("size"), key.alias("key"))
    some = runs.groupBy("item", "key").agg(F.min("at").alias("at"), F.first("size").alias("size"))  # a run's first place
    some = some.groupBy("item").agg(F.slice(F.array_sort(F.collect_list(F.struct("key", "at", "size"))), 1, CHOICES).alias("c"))
    some = saved(some.select("item", F.explode("c").alias("c")).select("item", "c.*"))
    sizes = sorted(r["size"] for r in some.select("size").distinct().collect())  # of 1 to RUN

    cut = given.select("row", "doc_id", F.split("normal", " ").alias("words"))
    each = cut.select("row", "doc_id", "words", F.posexplode("words").alias("pos", "word"))
    keys = [_run(F.col("words"), F.col("pos"), size) for size in sizes] or [F.lit(0).cast("long")]
    at_word = each.select("row", "doc_id", "words", "pos", keys[0].alias("key") if len(keys) == 1 else F.explode(F.array(*keys)).alias("key"))

    counts = saved(at_word.select("key").join(F.broadcast(some.select("key").distinct()), "key", "left_semi").groupBy("key").agg(F.count("*").alias("df")))
    best = some.join(counts, "key", "left").groupBy("item").agg(F.min("df").alias("df"), F.min_by(F.struct("key", "at"), F.struct("df", "key")).alias("c"), F.bool_and(F.col("df").isNotNull()).alias("all"))
    # of an item with a run that no text has, nothing is looked up
    chosen = best.where("all").select("item", "c.*").join(items, "item").withColumn("n", F.size(F.split("expected", " ")))
    start = F.col("pos") - F.col("at") + 1
    window = F.array_join(F.slice("words", F.greatest(start, F.lit(1)), F.col("n")), " ")
    return at_word.join(F.broadcast(chosen), "key").where((start >= 1) & F.contains(window, F.col("expected"))).select("row", "item", "item_id", "doc_id")


def _short(given: DataFrame, items: DataFrame) -> DataFrame:
    """One or two words: the longer of them is part of a word of the text, and the item of that word and its neighbours."""
    words = F.split("expected", " ")
    last = F.coalesce(F.get(words, 1), F.lit(""))
    part = F.when(F.length(last) > F.length(F.get(words, 0)), last).otherwise(F.get(words, 0))
    asked = saved(items.withColumn("part", part))
    lengths = [r["n"] for r in asked.select(F.length("part").alias("n")).distinct().collect()]  # of words
    each = given.select("row", "doc_id", F.split("normal", " ").alias("words")).select("row", "doc_id", "words", F.posexplode("words").alias("pos", "word"))
    vocabulary = saved(each.select("word").where("word <> ''").distinct())
    size = F.explode(F.array(*map(F.lit, lengths)))
    parts = vocabulary.select("word", size.alias("n")).where(F.length("word") >= F.col("n"))
    parts = parts.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("n") + 1)).alias("at"))
    parts = parts.select("word", F.substring("word", F.col("at"), F.col("n")).alias("part")).distinct()
    near = saved(parts.join(asked, "part").select("word", "item", "item_id", "expected"))
    window = F.concat_ws(" ", F.when(F.col("pos") > 0, F.get("words", F.col("pos") - 1)), "word", F.get("words", F.col("pos") + 1))
    met = each.select("row", "doc_id", "word", window.alias("window")).join(near, "word")
    return met.where(F.contains("window", "expected")).select("row", "item", "item_id", "doc_id")
