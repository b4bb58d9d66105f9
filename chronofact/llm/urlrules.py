"""URL filters: rules of host and path, indexed by their rarest literal token."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.llm.storage import tidy

#: Rules that one index holds; more are applied index after index, so a worker never holds more than one.
INDEX_RULES = 50_000


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    path = rest[cut:]
    end = min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))
    return rest[:cut].encode().lower().decode(), path[:end]


def tokens(host: str, path: str) -> list[str]:
    """Literal tokens: labels of the host and segments of the path, told apart by a leading mark."""
    return [f"h {x}" for x in host.split(".") if x] + [f"p {x}" for x in path.split("/") if x]


def rule_tokens(rule: str) -> list[str]:
    """A rule's tokens; its last path segment counts only if a slash ends it, as else it may be part of a longer one."""
    host, _, path = rule.partition("/")
    return tokens(host, path[: path.rfind("/") + 1])


def _pattern(rule: str) -> regex.Pattern:
    host, slash, path = rule.partition("/")
    return regex.compile(rf"(?:[^/]*\.)?{regex.escape(host)}{regex.escape(slash + path) if slash else '(?=/|$)'}")


class RuleIndex:
    """``counts``: how often each token of the rules occurs; the rarest one of a rule fetches it, ties by name."""

    def __init__(self, rules: Sequence[tuple[str, str]], counts: dict[str, int]) -> None:
        self.by_token: dict[str, list[tuple[int, str, str, regex.Pattern]]] = defaultdict(list)
        for verdict, rule in rules:
            words = rule_tokens(rule)
            if not words:
                raise ValueError(f"rule without a literal token: {rule!r}")
            self.by_token[min(words, key=lambda w: (counts.get(w, 0), w))].append((len(rule), rule, verdict, _pattern(rule)))

    def best(self, host: str, path: str) -> tuple[int, str, str] | None:
        """Length, rule and verdict of the longest rule that fits (ties: the first in order of text)."""
        found = None
        for word in set(tokens(host, path)):
            for n, rule, verdict, pattern in self.by_token.get(word, ()):
                if (not found or (-n, rule) < (-found[0], found[1])) and pattern.match(host + path):
                    found = (n, rule, verdict)
        return found


def token_counts(urls: Column, df: DataFrame, wanted: list[str]) -> dict[str, int]:
    """In how many rows each wanted token occurs, counted over all rows; the result is as small as the rules."""
    rest = F.regexp_extract(urls, "(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    all_tokens = F.concat(F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h "), x)), F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p "), x)))
    hit = df.select(F.explode(F.array_intersect(all_tokens, F.array(*map(F.lit, wanted)))).alias("token"))
    return {r["token"]: r["n"] for r in hit.groupBy("token").agg(F.count("*").alias("n")).collect()}


def url_verdicts(df: DataFrame, rules: Sequence[tuple[str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row.

    ``rules``: (verdict, ``host/path``); a rule fits its host and all subdomains where the path starts with its own, and
    the longest wins. Where none fits, ``rule`` is null and the verdict is ``default``. One rule with two verdicts is a
    ValueError. Null urls and urls without ``://`` have an empty host and path. Repeated rows stay; other columns are not
    carried.
    """
    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    verdicts: dict[str, str] = {}
    for verdict, rule in rules:
        if verdicts.setdefault(rule, verdict) != verdict:
            raise ValueError(f"rule {rule!r} has two verdicts")
    ordered = sorted(verdicts.items())
    out = df.select(F.col(id_col), F.col(url_col).alias("url"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    starts = range(0, max(1, len(ordered)), INDEX_RULES)
    for k in starts:
        part = [(verdict, rule) for rule, verdict in ordered[k : k + INDEX_RULES]]
        wanted = sorted({w for _, rule in part for w in rule_tokens(rule)})
        counts = token_counts(F.col(url_col), df, wanted) if wanted else {}
        run = _judge(df.sparkSession.sparkContext.broadcast((part, counts)), k == starts[-1], id_col)
        out = out.mapInArrow(tidy(run), f"`{id_col}` {kind}, {'host string, path' if k == starts[-1] else 'url'} string, rule string, verdict string")
    return out


def _judge(index, last: bool, id_col: str):
    """Applies one index of rules to urls with what earlier ones found; the last pass gives host and path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = RuleIndex(*index.value)
        for b in batches:
            split = [split_url(u) for u in b.column(1).to_pylist()]
            rows = []
            for parts, rule, verdict in zip(split, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                found = here.best(*parts)
                if found and (rule is None or (-found[0], found[1]) < (-len(rule), rule)):
                    _, rule, verdict = found
                rows.append((rule, verdict))
            judged = [pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)]
            if last:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in split], pa.string()) for i in (0, 1)), *judged], names=[id_col, "host", "path", "rule", "verdict"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *judged], names=[id_col, "url", "rule", "verdict"])

    return run
