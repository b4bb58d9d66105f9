"""From raw documents to packed training sequences, a stage after another."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.llm.langid import identify, learnable
from chronofact.llm.minhash import near_duplicates
from chronofact.llm.packing import pack
from chronofact.llm.phrases import remove_repeats
from chronofact.llm.queries import categories
from chronofact.llm.storage import stash
from chronofact.llm.toxicity import toxicity


def _own(docs: DataFrame) -> DataFrame:
    """The documents with all columns marked, so that no column that comes with them clashes with an operator's."""
    return docs.select(*(F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns))


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"`in_{c}`").alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones among them, doesn't call toxic. Null and empty
    texts stay; without labels all do."""
    labels = categories(spark.read.parquet(f"{sf_dir}/labels.parquet")).withColumnRenamed("doc_id", "in_doc_id")
    own = _own(docs)
    return _back(toxicity(own, labels, ["low_quality", "toxic"], id_col="in_doc_id", text_col="in_text", columns=own.columns).where("kept"), docs)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that those with a known language teach; null texts and texts without letters
    go."""
    own = _own(docs)
    labelled = learnable(own, "in_doc_id", "in_text", "in_lang")[1]
    return _back(identify(own, labelled, text_col="in_text", columns=own.columns).where("not rejected"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; documents without an id, and rows that repeat
    an id with its text, stay."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words that recur; where any are cut, single spaces join what is left."""
    own = _own(docs)
    cut = remove_repeats(own, columns=own.columns, text_col="in_text", with_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("in_text"))
    return _back(cut.withColumns({"in_text": text, "in_n_chars": F.length(text).cast("long")}), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("packing", pack_sequences),
]

#: The trained models of the first two stages cannot be told in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
