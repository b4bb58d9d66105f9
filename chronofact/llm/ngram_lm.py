"""Perplexity by an interpolated modified Kneser-Ney bigram model.

Counting is done in Spark over all training texts: distinct words, then distinct pairs of word numbers, each dealt to
buckets by range as sorted arrays that are merged there. The buckets are files of sorted arrays in the shared folder,
which workers memory-map; queries are sorted too, so a lookup walks through a file instead of jumping about in it.

A word's number is its place among the sorted word hashes. A text is its words and one end; before the first word stands
a start that is never predicted. The number of buckets grows with the text; pairs of a very common first word are dealt
to several buckets by the second one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from chronofact.llm import text as T
from chronofact.llm.storage import mounted, new_path, stash, tidy, tune

_U = np.uint64
#: Stands for the end of a text among word hashes.
END = _U(0xE5D0_F7E7_7000_0001)
#: Bytes of text for a bucket of words and for one of pairs; distinct items that a task gathers before it deals them.
WORD_BYTES, PAIR_BYTES, GATHERED = 16 * 2**20, 8 * 2**20, 1_500_000
#: A word is very common from this many tokens on, or from one in MOST_COMMON of all; so at most MOST_COMMON words are.
COMMON, MOST_COMMON = 1_000_000, 10_000
#: Bucket files that a worker keeps open.
OPEN = 8192


def _tokens(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each text's followed by END, and tokens before each text (n + 1)."""
    hashes, _, _, at = T.words(*T.buffers(part), lower=True)
    n = len(at) - 1
    out = np.full(len(hashes) + n, END, np.uint64)
    begin = at[:-1] + np.arange(n)
    out[T.spread(begin, np.diff(at))] = hashes
    return out, np.append(begin, len(out))


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    both = np.concatenate(keys)
    order = np.argsort(both, kind="stable")
    both, count = both[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])[: len(both)])
    return both[first], np.add.reduceat(count, first) if len(first) else count


def _dealt(batches: Iterator[pa.RecordBatch], items, bucket_of, gathered: int) -> Iterator[pa.RecordBatch]:
    """Counts items by task and gives each bucket its sorted part: ``(bucket, keys, counts)``."""
    keys, counts, held = [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        own, n = _merge(keys, counts)
        bucket = bucket_of(own)
        if (bucket[1:] < bucket[:-1]).any():
            order = np.argsort(bucket, kind="stable")
            own, n, bucket = own[order], n[order], bucket[order]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)])
        size = np.diff(np.append(first, len(own)))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int64)), T.binaries(own, size), T.binaries(n.astype("<i8"), size)], names=["bucket", "keys", "counts"])

    for batch in batches:
        for part in T.pieces(batch, "text"):
            own, n = np.unique(items(part.column(0)), return_counts=True)
            keys.append(own)
            counts.append(n)
            held += len(own)
            if held > gathered:
                yield from flush()
                keys, counts, held = [], [], 0
    if held:
        yield from flush()


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    get = lambda name, kind: [np.frombuffer(x.as_py(), kind) for x in table.column(name)]
    return _merge(get("keys", np.uint64), get("counts", "<i8"))


def _save(folder: str, name: str, values: np.ndarray) -> None:
    """Another attempt of the task writes the same bytes; the file appears whole or not at all."""
    os.makedirs(folder, exist_ok=True)
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    values.tofile(draft)
    os.replace(draft, f"{folder}/{name}")


@lru_cache(OPEN)
def _saved(folder: str, name: str, kind) -> np.ndarray:
    """A bucket's array, mapped when it is first asked for; a bucket that got no item has no file."""
    path = f"{folder}/{name}"
    return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)


@dataclass(frozen=True)
class Words:
    """Where the word files are: a bucket for each range of hashes, and the number of its first word."""

    folder: str
    first: tuple[int, ...]

    @property
    def buckets(self) -> int:
        return len(self.first) - 1

    @property
    def size(self) -> int:
        return self.first[-1]


@dataclass(frozen=True)
class Common:
    """Very common words in order, in how many buckets the pairs that they begin are, and those pairs' statistics."""

    words: tuple[int, ...] = ()
    spread: tuple[int, ...] = ()
    stats: tuple[tuple[int, ...], ...] = ()

    def find(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which numbers are very common, and the place of those."""
        words = np.array(self.words, np.int64)
        if not len(words):
            return np.zeros(len(number), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(words, number), len(words) - 1)
        hit = words[at] == number
        return hit, at[hit]

    def bucket_of_pair(self, pairs: np.ndarray, size: int, buckets: int) -> np.ndarray:
        first = (pairs >> _U(32)).astype(np.int64)
        bucket = bucket_of_number(first, size, buckets)
        hit, at = self.find(first)
        if len(at):
            spread = np.array(self.spread, np.uint64)[at]
            bucket[hit] = (bucket[hit] + (T.mix(pairs[hit]) % spread).astype(np.int64)) % buckets
        return bucket


@dataclass(frozen=True)
class Model:
    words: Words
    pair_buckets: int
    tokens: int
    pairs: int
    #: Discounts of counts 1, 2 and 3 or more, of pairs and of single words (which count the words before them).
    pair_discount: tuple[float, ...]
    word_discount: tuple[float, ...]
    #: What the single words leave to words never seen, all together.
    rest: float
    common: Common


def bucket_of_hash(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def numbers(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number (-1: never seen) and count of each hash."""
    asked, which = np.unique(hashes, return_inverse=True)
    number, count = np.full(len(asked), -1, np.int64), np.zeros(len(asked), np.int64)
    for b, some in _by_bucket(bucket_of_hash(asked, words.buckets)) if words.buckets else ():
        keys = _saved(words.folder, f"hashes-{b}", np.uint64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, asked[some]), len(keys) - 1)
            hit = keys[at] == asked[some]
            number[some] = np.where(hit, at + words.first[b], -1)
            count[some] = np.where(hit, _saved(words.folder, f"counts-{b}", np.int64)[at], 0)
    return number[which], count[which]


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice]]:
    """Each bucket that occurs, and the places of its items: a slice where they stand together."""
    order = None
    if not len(bucket):
        return
    if (bucket[1:] < bucket[:-1]).any():
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)])
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
        yield int(bucket[lo]), slice(lo, hi) if order is None else order[lo:hi]


def _pairs_of(words: Words, part: pa.Array) -> np.ndarray:
    hashes, at = _tokens(part)
    own = numbers(words, hashes)[0]
    before = np.concatenate([[words.size], own[:-1]])[: len(own)]
    before[at[:-1][np.diff(at) > 0]] = words.size
    return before.astype(np.uint64) << _U(32) | own.astype(np.uint64)


def _counted(folder: str, buckets: int, size: int, common: Common):
    """Merges a bucket of pairs; leaves files by pair and by first word, and gives the counts of second words, and what
    it knows of very common first words."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, counts = _gathered(table)
        _save(folder, f"pairs-{bucket}", keys)
        _save(folder, f"pair-counts-{bucket}", counts)
        first, start = np.unique(keys >> _U(32), return_index=True)
        kinds = np.minimum(counts, 3)
        stats = np.stack([np.add.reduceat(x.astype(np.int64), start) for x in (counts, kinds == 1, kinds == 2, kinds == 3)], 1)
        hot = common.find(first.astype(np.int64))[0]
        _save(folder, f"before-{bucket}", first[~hot])
        _save(folder, f"before-stats-{bucket}", stats[~hot])
        shared = np.hstack([first[hot, None].astype(np.int64), stats[hot]]).tolist()
        second, n = np.unique(keys & _U(0xFFFFFFFF), return_counts=True)
        to = bucket_of_number(second, size, buckets)
        at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])[: len(to)])
        of = np.diff(np.append(at, len(second)))
        few = [int((counts == k).sum()) for k in range(1, 5)]
        return pa.table({"bucket": pa.array(to[at]), "keys": T.binaries(second, of), "counts": T.binaries(n.astype("<i8"), of), "few": pa.array([few] + [None] * (len(at) - 1), pa.list_(pa.int64())), "pairs": pa.array([len(keys)] + [0] * (len(at) - 1)), "common": pa.array([shared] + [None] * (len(at) - 1), pa.list_(pa.list_(pa.int64())))})

    return run


def bucket_of_number(number: np.ndarray, size: int, buckets: int) -> np.ndarray:
    return np.minimum(number.astype(np.int64) * buckets // max(1, size + 1), buckets - 1)


def _continued(folder: str):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, counts = _gathered(table)
        _save(folder, f"after-{bucket}", keys)
        _save(folder, f"after-counts-{bucket}", counts)
        return pa.table({"few": pa.array([[int((counts == k).sum()) for k in range(1, 5)]], pa.list_(pa.int64())), "kinds": pa.array([[int((counts == 1).sum()), int((counts == 2).sum()), int((counts > 2).sum())]], pa.list_(pa.int64()))})

    return run


def discounts(few: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of items counted once to four times; 0.5, 1, 1.5 without such."""
    n1, n2, n3, n4 = few
    if not all(few):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(float(np.clip(d, 0.01, k)) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def _sum(rows: list, name: str, size: int) -> list[int]:
    return [sum(r[name][k] for r in rows if r[name]) for k in range(size)]


def train(texts: DataFrame, gathered: int = GATHERED, very_common: int = COMMON, bucket_bytes: tuple[int, int] = (WORD_BYTES, PAIR_BYTES)) -> Model:
    """Counts the ``text`` column (null: empty) of all rows; the files stay in the shared folder, which must be mounted on
    every node. Word numbers have 32 bits: more than 2**32 distinct words are a ValueError."""
    spark = texts.sparkSession
    tune(spark)
    folder = mounted(new_path(spark, "ngrams"))
    os.makedirs(folder)
    texts = texts.select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    volume = texts.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    word_buckets, pair_buckets = (int(8 + volume // size) for size in bucket_bytes)
    schema = "bucket long, keys binary, counts binary"

    def dealt_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _dealt(batches, lambda part: _tokens(part)[0], lambda keys: bucket_of_hash(keys, word_buckets), gathered)

    def merged(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, counts = _gathered(table)
        _save(folder, f"hashes-{bucket}", keys)
        _save(folder, f"counts-{bucket}", counts)
        hot = np.flatnonzero(counts > max(very_common, volume // MOST_COMMON))  # a token has one byte at least
        pairs = np.stack([hot, counts[hot]], 1).tolist()
        return pa.table({"bucket": pa.array([bucket]), "words": pa.array([len(keys)]), "tokens": pa.array([int(counts.sum())]), "common": pa.array([pairs], pa.list_(pa.list_(pa.int64())))})

    rows = texts.mapInArrow(tidy(dealt_words), schema).groupBy("bucket").applyInArrow(merged, "bucket long, words long, tokens long, common array<array<long>>").collect()  # a row for each bucket
    found = {r["bucket"]: r["words"] for r in rows}
    words = Words(folder, tuple(np.cumsum([0, *(found.get(b, 0) for b in range(word_buckets))]).tolist()))
    if words.size >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    tokens = sum(r["tokens"] for r in rows)
    hot = sorted((words.first[r["bucket"]] + at, n) for r in rows for at, n in r["common"])
    starts = texts.count()
    if starts > max(very_common, volume // MOST_COMMON):
        hot.append((words.size, starts))  # the start of a text, before its first word
    each = max(1, tokens // pair_buckets)
    common = Common(tuple(w for w, _ in hot), tuple(min(pair_buckets, 1 + n // each) for _, n in hot))

    def dealt_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _dealt(batches, lambda part: _pairs_of(words, part), lambda keys: common.bucket_of_pair(keys, words.size, pair_buckets), gathered)

    counted = texts.mapInArrow(tidy(dealt_pairs), schema).groupBy("bucket").applyInArrow(_counted(folder, pair_buckets, words.size, common), f"{schema}, few array<long>, pairs long, common array<array<long>>")
    counted = stash(counted, "pair-counts")
    totals = counted.where("few is not null").select("few", "pairs", "common").collect()  # a row for each bucket
    after = counted.select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(_continued(folder), "few array<long>, kinds array<long>").collect()
    pairs, kinds = sum(r["pairs"] for r in totals), _sum(after, "kinds", 3)
    of_words = discounts(_sum(after, "few", 4))
    rest = sum(d * n for d, n in zip(of_words, kinds, strict=True)) / pairs if pairs else 1.0
    sums = dict.fromkeys(common.words, (0, 0, 0, 0))
    for word, *stats in (x for r in totals for x in r["common"]):
        sums[word] = tuple(a + b for a, b in zip(sums[word], stats, strict=True))
    common = Common(common.words, common.spread, tuple(sums.values()))
    return Model(words, pair_buckets, tokens, pairs, discounts(_sum(totals, "few", 4)), of_words, rest, common)


def _look(model: Model, asked: np.ndarray, bucket: np.ndarray, keys: str, values: str, width: int = 1) -> np.ndarray:
    """Values of sorted, distinct keys in the files of their buckets (0 where they are not)."""
    out = np.zeros((len(asked), width), np.int64)
    for b, some in _by_bucket(bucket):
        own = _saved(model.words.folder, f"{keys}-{b}", np.uint64)
        if len(own):
            at = np.minimum(np.searchsorted(own, asked[some]), len(own) - 1)
            found = _saved(model.words.folder, f"{values}-{b}", np.int64).reshape(-1, width)[at]
            out[some] = np.where((own[at] == asked[some])[:, None], found, 0)
    return out


def log_probabilities(model: Model, own: np.ndarray, before: np.ndarray) -> np.ndarray:
    """log10 of each word's probability after the word before it; -1: a word never seen."""
    single, which = np.unique(own, return_inverse=True)
    seen = single >= 0
    count = np.zeros(len(single), np.int64)
    place = lambda number: bucket_of_number(number, model.words.size, model.pair_buckets)
    count[seen] = _look(model, single[seen].astype(np.uint64), place(single[seen]), "after", "after-counts")[:, 0]
    cut = np.array([0.0, *model.word_discount])[np.minimum(count, 3)]
    low = (np.maximum(count - cut, 0) / max(1, model.pairs) + model.rest / (model.words.size + 1))[which]
    left, of = np.unique(before, return_inverse=True)
    stats = np.zeros((len(left), 4), np.int64)
    known = left >= 0
    stats[known] = _look(model, left[known].astype(np.uint64), place(left[known]), "before", "before-stats", 4)
    hot, at = model.common.find(left)
    if len(at):
        stats[hot] = np.array(model.common.stats, np.int64)[at]
    total = np.maximum(stats[:, 0], 1)
    rest = np.where(stats[:, 0] > 0, stats[:, 1:] @ np.array(model.pair_discount) / total, 1.0)
    pair, where = np.unique(np.maximum(before, 0).astype(np.uint64) << _U(32) | np.maximum(own, 0).astype(np.uint64), return_inverse=True)
    n = _look(model, pair, model.common.bucket_of_pair(pair, model.words.size, model.pair_buckets), "pairs", "pair-counts")[:, 0][where]
    n = np.where((own >= 0) & (before >= 0), n, 0)
    high = np.maximum(n - np.array([0.0, *model.pair_discount])[np.minimum(n, 3)], 0) / total[of]
    return np.log10(high + rest[of] * low)


def score(docs: DataFrame, model: Model, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` (by default ``doc_id``), ``n_tokens, n_known, train_tokens, base_score, score, perplexity`` for each
    row: tokens with the end, those seen in training, the training tokens, and log10-probabilities of the text by
    single words with 0.1 added to each count and by the model. Null texts are empty: their one token is the end.
    Repeated rows stay; other columns are not carried.
    """
    tune(docs.sparkSession)
    columns = columns or ["doc_id"]
    names = [*columns, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch, "__text"):
                hashes, at = _tokens(part.column(k))
                own, count = numbers(model.words, hashes)
                before = np.concatenate([[0], own[:-1]])[: len(own)]
                before[at[:-1]] = model.words.size
                plain = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.words.size + 1)))
                n = np.diff(at)
                sums = [np.add.reduceat(x, at[:-1]) for x in (count > 0, plain, log_probabilities(model, own, before))]
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(n), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(n), model.tokens)), pa.array(sums[1]), pa.array(sums[2]), pa.array(10 ** np.minimum(-sums[2] / n, 300))], names=names)

    rows = docs.select(*columns, F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("__text"))
    schema = t.StructType([*rows.select(*columns).schema.fields, *(t.StructField(c, t.LongType()) for c in names[k : k + 3]), *(t.StructField(c, t.DoubleType()) for c in names[k + 3 :])])
    return rows.mapInArrow(tidy(run), schema)


def held_out(id_col: str = "doc_id", every: int = 10):
    """Whether crc32 of the id as text, modulo ``every``, is 0; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0, F.lit(False))
