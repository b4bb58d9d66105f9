"""Facts out of texts: trigger patterns and the time expressions around them.

Regular expressions with lazy groups and overlap rules are no column expressions; they run in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from chronofact.durable import saved
from chronofact.functions.texts import BARE_NUMBER, NO_LETTERS, QUESTION_END

# Patterns of triggers with kind and predicate, in order of precedence; role words with predicates.
_NAME, _WIDE = r"[A-Z][\w .']+", r"[A-Z][\w .'&]+"
_ROLES = r"(?:CEO|chairman|president|director|chair|chief executive|chief operating officer|COO|CFO|CTO)"
TRIGGERS = [
    (rf"\b({_NAME}?)\s+(?:became|was named|was appointed)\s+(?:the\s+new\s+)?{_ROLES}\s+of\s+({_WIDE})", "role_succession", "succeededBy"),
    (rf"\b({_NAME}?)\s+succeeded\s+({_NAME})\s+as\s+(?:CEO|chairman|president|chief executive)", "role_succession", "succeededBy"),
    (rf"\b({_NAME}?)\s+(?:replaced|took over from)\s+({_NAME})\s+as\s+", "role_succession", "succeededBy"),
    (rf"\b({_WIDE}?)\s+(?:was\s+)?(?:renamed|rebranded)\s+(?:to|as)\s+({_WIDE})", "entity_rename", "renamedTo"),
    (rf"\b({_WIDE}?)\s+formerly known as\s+({_WIDE})", "entity_rename", "formerlyKnownAs"),
    (rf"\b({_WIDE}?)\s+merged into\s+({_WIDE})", "entity_rename", "corporateName"),
    (rf"\b({_WIDE}?)\s+acquired\s+({_WIDE}?)(?:\s+for\s+\$?[\d,.]+\s*(?:billion|million))?", "functional_relation", "acquired"),
    (rf"\b({_WIDE}?)\s+(?:is\s+)?headquartered in\s+({_WIDE})", "functional_relation", "headquarteredIn"),
    (rf"\b({_WIDE}?)\s+priced\s+at\s+(\$?[\d,.]+\s*(?:billion|million))", "functional_relation", "priceOf"),
]
ROLE_PREDICATES = {
    "chief executive officer": "chiefExecutiveOfficer", "chief operating officer": "chiefOperatingOfficer", "chief executive": "chiefExecutiveOfficer",
    "ceo": "chiefExecutiveOfficer", "coo": "chiefOperatingOfficer", "cfo": "chiefFinancialOfficer", "cto": "chiefTechnologyOfficer",
    "chairman": "chairperson", "chairwoman": "chairperson", "chairperson": "chairperson", "chair": "chairperson", "president": "president", "director": "director",
}
# Cues of time, each with what may follow its date.
_CUES = {
    "from_to": r"\bfrom\s+([A-Za-z0-9 ,.\-/]+?)\s+to\s+([A-Za-z0-9 ,.\-/]+?)(?=[.,;)]|\s+(?:and|or|but|while|when|where|which|who|then|that|before|after|until|since)\b|$)",
    "years": r"\b((?:19|20)\d{2})\s*[-–]\s*((?:19|20)\d{2})\b",
    "until": r"\buntil\s+([A-Za-z0-9 ,.\-/]+?)(?=[.,;)]|\s+(?:and|or|but|while|when|where|which|who|then|that)\b|$)",
    "since": r"\b(?:since|starting|from)\s+([A-Za-z0-9 ,.\-/]+?)(?=[.,;)]|\s+(?:and|or|but|while|when|where|which|who|then|that|has|have|was|were|is|are|until)\b|$)",
    "became": r"\b(?:became|resumed|retook|took\s+over)\b.*?\bin\s+([A-Za-z0-9 ,.\-/]+?)(?=[.,;)]|\s+(?:and|or|but|while|when|where|which|who|then|that)\b|$)",
    "in": r"\bin\s+((?:19|20)\d{2}(?:[-/\s][A-Za-z0-9 ,.\-/]*)?)(?=[.,;)]|\s+(?:and|or|but|while|when|where|which|who|then|that)\b|$)",
    "bare": r"\b(?:19|20)\d{2}\b",
}

_TRIGGERS = [(re.compile(p, re.IGNORECASE), kind, predicate) for p, kind, predicate in TRIGGERS]
_CUE = {name: re.compile(p, re.IGNORECASE) for name, p in _CUES.items()}
_ROLE = re.compile(r"\b(" + "|".join(sorted(ROLE_PREDICATES, key=len, reverse=True)) + r")\b")
_USELESS = [re.compile(BARE_NUMBER, re.IGNORECASE), re.compile(NO_LETTERS), re.compile(QUESTION_END)]
_FORMATS = ("%Y-%m-%d", "%Y/%m/%d", "%Y-%m", "%Y", "%d %B %Y", "%B %d %Y", "%d %b %Y", "%b %d %Y", "%B %Y", "%b %Y", "%d.%m.%Y", "%m/%d/%Y")


def parse_date(text: str) -> datetime | None:
    """An ISO date, a year, or day, month and year in usual orders; parts that are missing are the first ones. UTC."""
    plain = " ".join(re.sub(r"(\d)(?:st|nd|rd|th)\b", r"\1", text.replace(",", " ")).split()).rstrip(".")
    try:
        found = datetime.fromisoformat(plain.replace("Z", "+00:00")) if len(plain) > 7 else None
    except ValueError:
        found = None
    for form in _FORMATS if found is None else ():
        try:
            found = datetime.strptime(plain, form)
            break
        except ValueError:
            continue
    return found and (found if found.tzinfo else found.replace(tzinfo=UTC))


#: What a text says about time: dates in usual forms, months of a year, and years.
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_TIME = re.compile(rf"\b(?:\d{{4}}-\d\d-\d\d|\d{{4}}/\d\d/\d\d|(?:\d{{1,2}}(?:st|nd|rd|th)?\s+)?(?:{_MONTHS})\.?(?:\s+\d{{1,2}}(?:st|nd|rd|th)?)?,?\s+\d{{4}}|(?:19|20)\d\d)\b")


def time_expressions(text: str | None) -> list[tuple[str, datetime | None]]:
    """Spans of dates and years in a text, with what they mean if that can be told."""
    return [(m[0], parse_date(m[0].replace(".", ""))) for m in _TIME.finditer(text or "")]


def infer_validity(text: str, source_date: datetime, prior: tuple[datetime, datetime | None] | None = None) -> tuple[datetime, datetime | None, bool, float]:
    """``start, end, known, confidence`` from the first cue that gives dates, ranges before single dates. Without any, a
    ``prior`` holds, else the source's date, unknown; a year without a cue makes that less certain."""

    def dates(cue: str) -> list[datetime | None]:
        m = _CUE[cue].search(text)
        return [parse_date(g) for g in m.groups()] if m else []

    for cue in ("from_to", "years"):
        found = dates(cue)
        if found and all(found) and found[1] > found[0]:
            return found[0], found[1], True, 1.0
    if (found := dates("until")) and found[0]:
        end = found[0]
        return (source_date if end > source_date else end.replace(year=end.year - 1, day=min(end.day, 28) if end.month == 2 else end.day)), end, True, 1.0
    for cue in ("since", "became", "in"):
        if (found := dates(cue)) and found[0]:
            return found[0], None, True, 1.0
    confidence = 0.75 if _CUE["bare"].search(text) else 1.0
    return (*prior, True, confidence) if prior else (source_date, None, False, confidence)


def scan(text: str) -> list[tuple[str, str, str, str, str, int, int]]:
    """``kind, predicate, subject, object, match, start, end`` of all triggers; where two overlap the earlier pattern's
    stays."""
    out, used = [], []
    for pattern, kind, predicate in _TRIGGERS:
        for m in pattern.finditer(text or ""):
            if all(m.end() <= a or b <= m.start() for a, b in used):
                used.append(m.span())
                out.append((kind, predicate, m[1].strip(), m[2].strip(), m[0], m.start(), m.end()))
    return out


def triples(text: str) -> list[tuple[str, str, str, str, str]]:
    """``kind, subject, predicate, object, match``: a role's predicate is the role, of the organisation, by the person."""
    out = []
    for kind, predicate, subject, obj, match, _, _ in scan(text):
        role = _ROLE.search(match.lower()) if kind == "role_succession" else None
        if role:
            subject, obj, predicate = obj, subject, ROLE_PREDICATES[role[1]]
        if subject and len(obj) > 1 and not any(p.search(obj) for p in _USELESS):  # as texts.object_problem says
            out.append((kind, subject, predicate, obj, match))
    return out


Extractor = Callable[[str], list[tuple[str, str, str, str, float]]]


def trigger_extractor(text: str) -> list[tuple[str, str, str, str, float]]:
    """``subject, predicate, object, evidence, confidence``; needs no model, so its confidence is 0.5."""
    return [(s, p, o, m, 0.5) for _, s, p, o, m in triples(text)]


EXTRACTED = "source_id string, position int, subject string, predicate string, object string, evidence_span string, extraction_confidence double, validity_start timestamp, validity_end timestamp, validity_known boolean, confidence double, source_date timestamp"


def extract(docs: DataFrame, extractor: Extractor = trigger_extractor) -> DataFrame:
    """A row for each fact that the extractor finds in a document: ``source_id, position, subject, predicate, object,
    evidence_span, extraction_confidence, validity_start, validity_end, validity_known, confidence, source_date``.

    ``docs``: ``source_id, text, source_date``. Any callable is an extractor, a model's client too; it is called once
    for each text. Time is inferred from the evidence's sentence; documents without a date give an unknown start.
    """
    return _extracted(docs, extractor, tolerant=False).drop("error")


def extract_apart(docs: DataFrame, extractor: Extractor = trigger_extractor) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """``extract``, but a text on which the extractor raises is a dead letter, and the others' facts are kept: the facts, the
    failures (source_id, error) and the counts ``facts`` and ``failed``. Written once, so each text is tried once."""
    seen = Observation("extracted")
    failed = F.col("error").isNotNull()
    rows = saved(_extracted(docs, extractor, tolerant=True).observe(seen, F.count_if(~failed).alias("facts"), F.count_if(failed).alias("failed")))
    return rows.where(~failed).drop("error"), rows.where(failed).select("source_id", "error"), dict(seen.get)


def _extracted(docs: DataFrame, extractor: Extractor, tolerant: bool) -> DataFrame:
    """Rows as of EXTRACTED and ``error``, which is null but for a row for each text that failed."""
    names = [*(c.split()[0] for c in EXTRACTED.split(", ")), "error"]
    kinds = [pa.string(), pa.int32(), *[pa.string()] * 4, pa.float64(), *[pa.timestamp("us", "UTC")] * 2, pa.bool_(), pa.float64(), pa.timestamp("us", "UTC"), pa.string()]

    def of_text(source: str, text: str, date: datetime | None) -> list[tuple]:
        rows = []
        for i, (s, p, o, span, c) in enumerate(extractor(text)):
            start, end, known, factor = infer_validity(_sentence(text, span), date or datetime(1, 1, 1, tzinfo=UTC))
            rows.append((source, i, s, p, o, span, c, start if start.year > 1 else None, end, known, c * factor, date, None))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, text, date in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not text:
                    continue
                try:
                    rows += of_text(source, text, date)
                except Exception as e:  # whatever a model's client raises
                    if not tolerant:
                        raise
                    rows.append((source, *[None] * 11, f"{type(e).__name__}: {e}"))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select("source_id", "text", F.col("source_date").cast("timestamp")).mapInArrow(run, f"{EXTRACTED}, error string")


CACHED = "cache_key string, subject string, predicate string, object string, evidence_span string, extraction_confidence double, position int"


def cached_extract(docs: DataFrame, cache: DataFrame | None, extractor_id: str, extractor: Extractor = trigger_extractor, tolerant: bool = False) -> tuple[DataFrame, DataFrame]:
    """What ``extract`` gives, with the extractor called only for texts that the ``cache`` (CACHED) lacks, once for each
    distinct one; also the rows to add to the cache. A text without facts is cached by a row with a null subject. Times
    are inferred anew, as documents of one text may have different dates. If ``tolerant``, a text on which the extractor
    raises has no facts and is not cached, so that it is tried again."""
    spark = docs.sparkSession
    key = F.sha2(F.concat(F.col("text"), F.lit(f"|{extractor_id}")), 256).alias("cache_key")
    cache = spark.createDataFrame([], CACHED) if cache is None else cache
    texts = docs.select(key, "text").where("text is not null").dropDuplicates(["cache_key"]).join(cache.select("cache_key"), "cache_key", "left_anti")
    names = CACHED.replace(",", "").split()[::2]
    kinds = [*[pa.string()] * 5, pa.float64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [(k, *found, i) for i, found in enumerate(extractor(text))] or [(k, None, None, None, None, None, None)]
                except Exception:  # whatever a model's client raises
                    if not tolerant:
                        raise
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(names), kinds, strict=True)], names=names)

    fresh = saved(texts.select("cache_key", "text").mapInArrow(run, CACHED))
    held = docs.select("source_id", "text", "source_date", key).join(cache.unionByName(fresh).where("subject is not null"), "cache_key")
    return _dated(held), fresh


def _dated(found: DataFrame) -> DataFrame:
    """Extractions with their documents' texts and dates, and the validity that those give."""

    @F.arrow_udf("struct<validity_start:timestamp,validity_end:timestamp,validity_known:boolean,factor:double>")
    def validity(texts: pa.Array, spans: pa.Array, dates: pa.Array) -> pa.Array:
        rows = []
        for text, span, date in zip(texts.to_pylist(), spans.to_pylist(), dates.to_pylist(), strict=True):
            start, end, known, factor = infer_validity(_sentence(text, span), date or datetime(1, 1, 1, tzinfo=UTC))
            rows.append({"validity_start": start if start.year > 1 else None, "validity_end": end, "validity_known": known, "factor": factor})
        stamp = pa.timestamp("us", "UTC")
        return pa.array(rows, pa.struct([("validity_start", stamp), ("validity_end", stamp), ("validity_known", pa.bool_()), ("factor", pa.float64())]))

    told = found.withColumn("source_date", F.col("source_date").cast("timestamp")).withColumn("__v", validity("text", "evidence_span", "source_date"))
    confidence = (F.col("extraction_confidence") * F.col("__v.factor")).alias("confidence")
    return told.select("source_id", "position", "subject", "predicate", "object", "evidence_span", "extraction_confidence", "__v.validity_start", "__v.validity_end", "__v.validity_known", confidence, "source_date")


def _sentence(text: str, span: str) -> str:
    """The span, on to the end of its sentence."""
    at = text.find(span)
    if at < 0:
        return text
    stop = re.search(r"[.!?](?=\s|$)", text[at + len(span) :])
    return text[at : at + len(span) + (stop.end() if stop else len(text))]


def scan_documents(docs: DataFrame) -> DataFrame:
    """A row for each trigger: ``source_id, kind, predicate, subject, object, match_text``, and the first and the last time
    that its document names (null without any)."""
    names = ["source_id", "kind", "predicate", "subject", "object", "match_text", "first_time", "last_time"]
    kinds = [*[pa.string()] * 6, *[pa.timestamp("us", "UTC")] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits = scan(x)
                times = [t for _, t in time_expressions(x) if t] if hits else []
                rows += [(s, *hit[:5], min(times, default=None), max(times, default=None)) for hit in hits]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("source_id").cast("string"), "text").mapInArrow(run, ", ".join(f"{n} string" for n in names[:6]) + ", first_time timestamp, last_time timestamp")


@F.arrow_udf(IntegerType())
def times_named(texts: pa.Array) -> pa.Array:
    """How many time expressions a text has."""
    return pa.array([len(time_expressions(x)) for x in texts.to_pylist()], pa.int32())


def probed(mentions: DataFrame, tagger: Callable[[str], list[tuple[str, str]]] | None, column: str = "mention") -> DataFrame:
    """``mentions`` with ``entity_type``: the label of the one entity that is the whole mention, COMPOUND if there are
    others or only a part is one, NONE without any, UNAVAILABLE without a tagger. ``tagger``: text to (span, label)."""

    @F.arrow_udf("string")
    def label(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts.to_pylist():
            found = tagger((x or "").strip()) if (x or "").strip() else []
            out.append("NONE" if not found else found[0][1] if len(found) == 1 and found[0][0].strip() == x.strip() else "COMPOUND")
        return pa.array(out, pa.string())

    return mentions.withColumn("entity_type", F.lit("UNAVAILABLE") if tagger is None else label(F.col(column)))


def encoded(rows: DataFrame, encoder: Callable[[list[str]], object], text_col: str = "text", vector_col: str = "vector") -> DataFrame:
    """``rows`` with a vector of each text (null: empty) by any encoder of lists of texts, a batch at a time."""

    @F.arrow_udf("array<double>")
    def vector(texts: pa.Array) -> pa.Array:
        found = encoder([x or "" for x in texts.to_pylist()]) if len(texts) else []
        return pa.array([[float(c) for c in v] for v in found], pa.list_(pa.float64()))

    return rows.withColumn(vector_col, vector(F.col(text_col)))
