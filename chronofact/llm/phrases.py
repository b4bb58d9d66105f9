"""Repeated passages, found by sharded automata of the phrases that recurring passages hold.

Two equal windows of ``window`` words choose the same phrase of PHRASE words in them, the one of the least hash (the
last of several), so a window can only recur if its phrase does.

1. Recurring passages are confirmed: chosen phrases are counted; of windows that choose a phrase counted twice, the
   hashes are counted too, equal runs of them as one first.
2. The phrases of confirmed windows are compiled to Aho-Corasick automata, in shards of bounded size that are written
   once to the shared folder, each with the hashes of its windows.
3. All documents are streamed. A stretch of a text that may hold a phrase goes to the automaton of the shard in whose
   range that phrase would be, so no document passes all automata and no worker reads all shards; what the automaton
   locates there decides which windows are looked up, and the known ones are cut out of their texts.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from chronofact.llm import text as T
from chronofact.llm.storage import stash, tidy, tune

#: Words of a phrase, where windows are longer; bits of a word's hash that are its letter.
PHRASE, WORD = 10, 6
#: Bits of the table that says which phrases may recur: of bounded size whatever the corpus, as it is broadcast. Where it
#: fills up, more windows are counted than need be.
BITS = 26
#: Phrases and windows of a shard, and bytes of a row that holds a part of one.
SHARD_PHRASES, SHARD_WINDOWS, SHARD_ROW = 30_000, 500_000, 4 * 2**20
#: Texts that a task remembers, so that stretches of copies that it has seen are not sent again.
REMEMBERED = 200_000
_U = np.uint64
_BUCKET = 1 << 15  # bits in a bitmap of Spark's


def phrase_words(window: int) -> int:
    return min(PHRASE, window - 2)


def _chosen(phrases: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window within a text: its first word, and the first word of the phrase that it chooses."""
    span = window - phrase_words(window) + 1
    count = np.maximum(np.diff(at) - window + 1, 0)
    starts = T.spread(at[:-1], count)
    if not len(starts):
        return starts, starts
    rank = (phrases >> _U(32) << _U(32)) | (_U(0xFFFFFFFF) - (np.arange(len(phrases), dtype=np.uint64) & _U(0xFFFFFFFF)))
    least, width = rank, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    chosen = (_U(0xFFFFFFFF) - (least[starts] & _U(0xFFFFFFFF))).astype(np.int64)
    return starts, chosen


def phrase_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, from which the letters of the phrase can be told again."""
    m = max(0, len(hashes) - size + 1)
    packed = np.zeros(m, np.uint64)
    for i in range(size):
        packed = packed << _U(WORD) | hashes[i : i + m] & _U((1 << WORD) - 1)
    return T.mix(packed)


def letters(hashes: np.ndarray) -> np.ndarray:
    """A letter for each word."""
    return (hashes & _U((1 << WORD) - 1)).astype(np.uint8) + np.uint8(64)


def pattern(h: int, size: int) -> str:
    """The letters of a phrase."""
    packed = int(T.unmix(np.array([h], np.uint64))[0])
    return _text(letters(np.array([packed >> WORD * i for i in reversed(range(size))], np.uint64)))


def _text(written: np.ndarray) -> str:
    return written.tobytes().decode("ascii")


def _phrases(window: int):
    """``(h, n)`` for each phrase chosen in a batch, with its number of places there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch, 0):
                hashes, _, _, at = T.words(*T.buffers(part.column(0)), lower=False)
                phrases = phrase_hashes(hashes, phrase_words(window))
                chosen = _chosen(phrases, at, window)[1]
                places = chosen[np.flatnonzero(np.diff(chosen, prepend=-1))]  # places rise with the windows
                h, n = np.unique(phrases[places], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return run


def _bitmap(recurring: DataFrame) -> np.ndarray:
    """A bit for each value of the leading BITS bits of the phrases' hashes: whether any recurring phrase has it."""
    slot = F.shiftrightunsigned("h", 64 - BITS) + 1
    rows = recurring.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for r in rows:  # BITS bits in all
        lo = (r["bucket"] - 1) * _BUCKET // 8
        out[lo : lo + _BUCKET // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _may_recur(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> _U(64 - BITS)
    return (bits[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8) & 1).astype(bool)


@dataclass(frozen=True)
class _Windows:
    """Of texts: word hashes, words before each. Of windows whose phrase may recur: first word, the phrase's hash, and the
    window's own hash within its phrase, so that windows of different phrases are never taken for each other. Runs of
    neighbouring windows choose one phrase."""

    hashes: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    h: np.ndarray
    key: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, window: int, bits: np.ndarray) -> _Windows:
        hashes, _, _, at = T.words(*T.buffers(texts), lower=False)
        phrases = phrase_hashes(hashes, phrase_words(window))
        starts, chosen = _chosen(phrases, at, window)
        if len(starts):
            may = _may_recur(bits, phrases[chosen])
            starts, chosen = starts[may], chosen[may]
        none = np.zeros(0, np.uint64)
        h = phrases[chosen] if len(chosen) else none
        key = T.mix(T.rolling(hashes, window)[starts] ^ T.mix(h)) if len(starts) else none
        first = np.flatnonzero(np.diff(chosen, prepend=-1))
        return cls(hashes, at, starts, h, key, first, np.diff(np.append(first, len(chosen))))


def _runs(window: int, bits: Broadcast):
    """Runs of windows: the phrase's hash, and the windows' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch, 0):
                w = _Windows.of(part.column(0), window, bits.value)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(w.size)]), pa.int32()), pa.array(w.key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(w.h[w.first].view(np.int64)), lists], names=["h", "windows"])

    return run


def compile_shard(patterns: list[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_STRING)
    for p in patterns:
        automaton.add_word(p)
    automaton.make_automaton()
    return automaton


def _compiled(size: int, most_phrases: int, most_windows: int):
    """Cuts confirmed windows, sorted by phrase, into shards: the phrases' automaton and the sorted keys of the windows,
    in rows of bounded size. A phrase of very many windows goes on in further shards."""

    def shard(rows: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
        h, w = (rows.column(c).to_numpy().view(np.uint64) for c in ("h", "w"))
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        data = pickle.dumps((compile_shard([pattern(x, size) for x in h[first].tolist()]), np.sort(w)))
        low, high = int(h.view(np.int64)[0]), int(h.view(np.int64)[-1])
        for i, lo in enumerate(range(0, len(data), SHARD_ROW)):
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (number, i, low, high)] + [pa.array([data[lo : lo + SHARD_ROW]], pa.binary())], names=["number", "row", "low", "high", "data"])

    def cut(rows: pa.Table) -> int:
        h = rows.column("h").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return min(most_windows, int(first[most_phrases]) if len(first) > most_phrases else len(h))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, fresh = [], 0, 0
        for batch in batches:
            held.append(batch)
            fresh += batch.num_rows
            if fresh >= most_phrases:
                table, fresh = pa.Table.from_batches(held), 0
                while (upto := cut(table)) < table.num_rows:
                    yield from shard(table.slice(0, upto), number)
                    table, number = table.slice(upto), number + 1
                held = table.combine_chunks().to_batches()
        table = pa.Table.from_batches(held) if held else None
        while table is not None and table.num_rows:
            upto = cut(table)
            yield from shard(table.slice(0, upto), number)
            table, number = table.slice(upto), number + 1

    return run


@dataclass(frozen=True)
class Shard:
    """Where a compiled shard is, and the range of its phrases' hashes (as signed numbers)."""

    path: str
    number: int
    low: int
    high: int

    def load(self) -> tuple[ahocorasick.Automaton, np.ndarray]:
        files, path = pyarrow.fs.FileSystem.from_uri(self.path)
        rows = pyarrow.parquet.read_table(path, filesystem=files, columns=["row", "data"], filters=[("number", "=", self.number)], partitioning=None)
        return pickle.loads(b"".join(x.as_py() for x in rows.sort_by("row").column("data")))


def _stretches(window: int, bits: Broadcast):
    """A row for each run of windows: the hash of the phrase that it may hold, its text, the run's first word there, the
    stretch's letters and the windows' hashes. ``k1, k2`` stand for the text; of copies in a task one is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in T.pieces(batch, 2):
                fresh = []
                for k in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    fresh.append(k not in seen)
                    if len(seen) < REMEMBERED:
                        seen.add(k)
                part = part.filter(pa.array(fresh, pa.bool_()))
                w = _Windows.of(part.column(2), window, bits.value)
                owner = np.searchsorted(w.at, w.starts[w.first], "right") - 1
                rows, words = pa.array(owner), w.size + window - 1
                written = letters(w.hashes[T.spread(w.starts[w.first], words)])
                columns = [pa.array(w.h[w.first].view(np.int64)), part.column(0).take(rows), part.column(1).take(rows), pa.array(w.starts[w.first] - w.at[owner])]
                yield pa.RecordBatch.from_arrays([*columns, T.binaries(written, words), T.binaries(w.key, w.size)], names=["h", "k1", "k2", "start", "letters", "keys"])

    return run


def locate(automaton: ahocorasick.Automaton, written: np.ndarray, size: np.ndarray, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches of ``size`` words, one after another in ``written``: where phrases of the automaton start, as the
    stretch and the word in it."""
    first = np.cumsum(size + 1) - size - 1  # something that is no letter stands between stretches
    line = np.ones(int((size + 1).sum()), np.uint8)
    line[T.spread(first, size)] = written
    word = np.fromiter((e for e, _ in automaton.iter(_text(line))), np.int64) - phrase + 1
    stretch = np.searchsorted(first, word, "right") - 1
    return stretch, word - first[stretch]


def look_up(rows: pa.RecordBatch, window: int, automaton: ahocorasick.Automaton, known: np.ndarray) -> pa.RecordBatch:
    """Streams stretches through a shard's automaton; of those with windows around a located phrase that are known to
    recur: text, first word, and a bit for each window that is."""
    written, at = T.buffers(rows.column("letters"))
    keys, ends = T.buffers(rows.column("keys"))
    keys, first, number = np.frombuffer(keys.tobytes(), np.uint64), ends[:-1] // 8, np.diff(ends) // 8
    phrase = phrase_words(window)
    stretch, word = locate(automaton, written, np.diff(at), phrase)
    change = np.zeros(len(keys) + 1, np.int64)  # windows that hold a located phrase
    np.add.at(change, first[stretch] + np.clip(word - (window - phrase), 0, number[stretch]), 1)
    np.add.at(change, first[stretch] + np.minimum(word + 1, number[stretch]), -1)
    near = np.flatnonzero(np.cumsum(change)[:-1] > 0)
    place = np.minimum(np.searchsorted(known, keys[near]), len(known) - 1)
    hit = near[known[place] == keys[near]]
    owner = np.searchsorted(ends // 8, hit, "right") - 1
    mask = np.zeros(len(number), np.int64)
    np.bitwise_or.at(mask, owner, np.int64(1) << (hit - first[owner]))
    some = pa.array(np.flatnonzero(mask))
    return pa.RecordBatch.from_arrays([*(rows.column(c).take(some) for c in ("k1", "k2", "start")), pa.array(mask).take(some)], names=["k1", "k2", "start", "mask"])


def _located(window: int, shards: Broadcast):
    """Stretches come in the order of their phrases, as shards are: a worker reads a shard when its range comes by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = lru_cache(2)(Shard.load)
        ranges, reach = shards.value, np.array([s.high for s in shards.value], np.int64)
        for batch in batches:
            h = batch.column(0).to_numpy()
            for shard in ranges[int(np.searchsorted(reach, h[0])) :] if len(h) else ():
                if shard.low > h[-1]:
                    break
                lo, hi = np.searchsorted(h, shard.low), np.searchsorted(h, shard.high, "right")
                if lo < hi:
                    yield look_up(batch.slice(lo, hi - lo), window, *load(shard))

    return run


def _cut(window: int, carried: int, column: int, with_text: bool, names: list[str]):
    """Removes the covered words; the last column has the starts and masks of the text's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch, column):
                yield _without(part, window, carried, column, with_text, names)

    return run


def _without(part: pa.RecordBatch, window: int, carried: int, column: int, with_text: bool, names: list[str]) -> pa.RecordBatch:
    data, offsets = T.buffers(part.column(column))
    first, last, at = T.bounds(data, offsets)
    found = part.column(part.num_columns - 1)
    number = np.where(np.asarray(found.is_valid()), np.diff(np.asarray(found.offsets)), 0) if len(found) else np.zeros(0, np.int64)
    flat = found.flatten()
    begin, mask = np.asarray(flat.field("start"), np.int64) + np.repeat(at[:-1], number), np.asarray(flat.field("mask"), np.int64)
    change = np.zeros(len(first) + window + 1, np.int64)
    for bit in range(window - phrase_words(window) + 1):
        hit = begin[(mask >> bit) & 1 == 1] + bit
        np.add.at(change, hit, 1)
        np.add.at(change, hit + window, -1)
    keep = np.cumsum(change)[: len(first)] == 0
    before = np.concatenate([[0], np.cumsum(keep)])
    kept = before[at[1:]] - before[at[:-1]]
    first, size = first[keep], (last - first)[keep] + 1
    ends = np.cumsum(size)
    out = data[np.minimum(T.spread(first, size), max(0, len(data) - 1))]
    out[ends - 1] = 32
    ends = np.concatenate([[0], ends])
    bounds = [(int(ends[a]), max(int(ends[a]), int(ends[b]) - 1)) for a, b in zip(before[at[:-1]].tolist(), before[at[1:]].tolist(), strict=True)]
    texts = [out[a:b].tobytes() for a, b in bounds]
    words = np.diff(at)
    columns = [*part.columns[:carried], pa.array(words), pa.array(words - kept), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
    if with_text:
        columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
    return pa.RecordBatch.from_arrays(columns, names=names)


def recurring_windows(texts: DataFrame, window: int) -> DataFrame:
    """``h, w`` of each window (w) that starts at two places or more, with the phrase that it chooses. ``texts`` has one
    column."""
    spark = texts.sparkSession
    recurring = texts.mapInArrow(tidy(_phrases(window)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    bits = spark.sparkContext.broadcast(_bitmap(recurring))
    runs = texts.mapInArrow(tidy(_runs(window, bits)), "h long, windows array<long>").groupBy("h", "windows").agg(F.count("*").alias("n"))
    windows = runs.select("h", F.explode("windows").alias("w"), "n").groupBy("h", "w").agg(F.sum("n").alias("n")).where("n > 1")
    return windows.select("h", "w")


def compiled(windows: DataFrame, window: int, most_phrases: int = SHARD_PHRASES, most_windows: int = SHARD_WINDOWS) -> list[Shard]:
    """Writes the shards of the windows to the shared folder; only their places and ranges come to the driver."""
    number = windows.count()
    parts = max(1, -(-number // most_windows))
    ordered = windows.repartitionByRange(parts, "h", "w").sortWithinPartitions("h", "w")
    shards = stash(ordered.mapInArrow(tidy(_compiled(phrase_words(window), most_phrases, most_windows)), "number long, row long, low long, high long, data binary"), "shards")
    rows = shards.where("row = 0").select(F.col("_metadata.file_path").alias("path"), "number", "low", "high").collect()
    return sorted((Shard(r["path"], r["number"], r["low"], r["high"]) for r in rows), key=lambda s: (s.low, s.high, s.path, s.number))


def remove_repeats(docs: DataFrame, columns: list[str] | None = None, text_col: str = "text", window: int = 35, with_text: bool = False, shard: tuple[int, int] = (SHARD_PHRASES, SHARD_WINDOWS)) -> DataFrame:
    """``columns`` (by default ``doc_id``) of each row and ``n_words, n_removed, kept_sha256`` (and ``kept_text``).

    Removed is each word that is covered by ``window`` consecutive words of its text which start anywhere else too, in
    the same text or in another row's. ``kept_sha256``: of the kept words joined by one space. Null texts have no
    words; texts of fewer words than a window lose none. Rows with the same text are counted as so many texts, have
    equal results and all stay, whatever their ids. The shared folder must be one that workers can open by its URI.
    """
    if not 3 <= window < 63 + PHRASE:
        raise ValueError(f"window must be 3 to {62 + PHRASE}")
    spark = docs.sparkSession
    tune(spark)
    columns = columns or ["doc_id"]
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    windows = stash(recurring_windows(docs.select(text.alias("text")), window), "recurring")
    shards = spark.sparkContext.broadcast(compiled(windows, window, *shard))  # places and ranges
    bits = spark.sparkContext.broadcast(_bitmap(windows))  # of phrases that are known to recur
    ids = [F.xxhash64(text).alias("__k1"), F.xxhash64(F.lit(1), text).alias("__k2")]
    stretches = docs.select(*ids, text.alias("text")).mapInArrow(tidy(_stretches(window, bits)), "h long, k1 long, k2 long, start long, letters binary, keys binary")
    ordered = stretches.repartitionByRange("h", "k1", "start").sortWithinPartitions("h")
    found = ordered.mapInArrow(tidy(_located(window, shards)), "k1 long, k2 long, start long, mask long").groupBy("k1", "k2", "start").agg(F.bit_or("mask").alias("mask"))
    found = stash(found, "located")  # so that the stretches go before the texts are dealt
    covered = found.groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.collect_list(F.struct("start", "mask")).alias("__windows"))  # as many as a text has words at most
    rows, column = T.carried(docs.select("*", *ids), [*columns, "__k1", "__k2"], text_col)
    rows = rows.join(covered, ["__k1", "__k2"], "left").select(*(c for c in rows.columns if c not in ("__k1", "__k2")), "__windows")
    column = columns.index(text_col) if column < len(columns) else len(columns)
    names = [*columns, "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]
    schema = t.StructType([*rows.select(*columns).schema.fields, t.StructField("n_words", t.LongType()), t.StructField("n_removed", t.LongType()), t.StructField("kept_sha256", t.StringType()), *[t.StructField("kept_text", t.StringType())] * with_text])
    return rows.mapInArrow(tidy(_cut(window, len(columns), column, with_text, names)), schema)
