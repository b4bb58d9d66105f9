"""Documents, passages and logs from files; every reader has a fixed schema, so no file is read to infer one."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.model import DOCUMENTS


def lenient_time(text: Column) -> Column:
    """A UTC instant of an ISO date or time, null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), r"(?i)z$", "+00:00"))


def documents_jsonl(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """JSON lines with ``source_id`` and ``text``, maybe ``uri`` and ``source_date``. Blank lines are skipped; broken ones
    and rows without id or text are skipped too, or fail the job if ``strict``."""
    schema = "source_id string, text string, uri string, source_date string, _broken string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    good = F.col("_broken").isNull() & F.coalesce(F.length("source_id") > 0, F.lit(False)) & F.coalesce(F.length("text") > 0, F.lit(False))
    if strict:
        rows = rows.withColumn("source_id", F.when(good, F.col("source_id")).otherwise(F.raise_error(F.concat(F.lit("bad document row: "), F.coalesce("_broken", F.to_json(F.struct("source_id", "uri")))))))
    else:
        rows = rows.where(good)
    return rows.select("source_id", "text", "uri", lenient_time(F.col("source_date")).alias("source_date"))


def documents_folder(spark: SparkSession, path: str) -> DataFrame:
    """Text and Markdown files below a folder, one document each; the id is the path below it. Blank files are skipped."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").text(path, wholetext=True)
    name = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + _escaped(path.rstrip("/").removeprefix("file://")) + "/", "")
    return files.where(F.trim("value") != "").select(name.alias("source_id"), F.col("value").alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("timestamp").alias("source_date"))


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() or c == "/" else "\\" + c for c in text)


def passages_text(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of a text file, parted by blank lines: ``position, text``."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\n\s*\n")).alias("position", "text")).withColumn("text", F.trim("text")).where("text <> ''")


def audit_batches(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a query and its passages: ``query, position, text``."""
    return spark.read.schema("query string, passages array<string>").json(path).select("query", F.posexplode("passages").alias("position", "text"))


def documents(spark: SparkSession, rows: DataFrame | Iterable[Mapping]) -> DataFrame:
    """A DataFrame, or mappings of documents, in the documents' schema."""
    if isinstance(rows, DataFrame):
        missing = [c for c in ("source_id", "text") if c not in rows.columns]
        if missing:
            raise ValueError(f"documents need columns {missing}")
        extra = {"uri": "string", "source_date": "timestamp"}
        return rows.select(F.col("source_id").cast("string"), "text", *(F.col(c).cast(k) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in extra.items()))
    return spark.createDataFrame([(r["source_id"], r["text"], r.get("uri"), r.get("source_date")) for r in rows], DOCUMENTS)


def stored_documents(passages: DataFrame) -> DataFrame:
    """All passages of a store as documents, one for each source."""
    return passages.dropDuplicates(["source_id"]).select("source_id", "text", "uri", F.lit(None).cast("timestamp").alias("source_date"))


#: Questions of a small built-in benchmark: query, expected answer, year asked about.
SANITY = [
    ("Who was CEO of Google in 2013?", "Larry Page", 2013), ("Who was CEO of Google in 2005?", "Eric Schmidt", 2005),
    ("Who was CEO of Google in 2020?", "Sundar Pichai", 2020), ("What was Twitter renamed to?", "X Corp", None),
    ("Where is Microsoft headquartered?", "Redmond", None),
]


def benchmark(spark: SparkSession, rows: Iterable[tuple[str, str, int | None]] = tuple(SANITY)) -> DataFrame:
    """``query, expected_answer, query_time``; a year stands for the middle of June."""
    raw = spark.createDataFrame([tuple(r) for r in rows], "query string, expected_answer string, year int")
    return raw.select("query", "expected_answer", F.make_timestamp("year", F.lit(6), F.lit(15), F.lit(0), F.lit(0), F.lit(0)).alias("query_time"))
