"""Concatenate-and-cut packing with global offsets by prefix sums over partition token totals.

First pass: each partition tokenises its texts, numbers its tokens from 0 and is written to the shared folder. The
partitions' totals (one number each) give every partition its global offset. Second pass: each document's range of
global positions is cut at multiples of the sequence length; a document over a cut gives a piece on either side.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.llm import text as T
from chronofact.llm.storage import stash, tidy, tune

#: Pre-tokens whose ids a worker keeps; beyond that it starts anew.
KEPT = 600_000
#: Pre-tokens that the library encodes at once; what it returns for each is much larger than the ids.
AT_ONCE = 4096
#: Code points that are split here; texts with others are left to the library.
_PLAIN = 0x2070
_LETTER, _NUMBER, _OTHER, _WHITE = range(4)


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each plain code point, and a random value for its part in a hash; 255: not plain."""
    kind = np.full(_PLAIN, 255, np.uint8)
    for c in [*range(0x250), *range(0x2010, 0x2028)]:
        kind[c] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER)
    kind[[*range(9, 14), 32, 0x85, 0xA0]] = _WHITE
    return kind, T.mix(np.arange(1, _PLAIN + 1, dtype=np.uint64)) | np.uint64(1)


class Tokens:
    """Ids of whole batches. A text is cut into the matches of the byte-level pattern by array operations, and the
    library encodes each distinct match once; a match's ids don't depend on what stands beside it."""

    def __init__(self, tokenizer: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.keys, self.start, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def one(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their number by text."""
        kind_of, value_of = _classes()
        raw = data.tobytes()
        whole = raw.decode()
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        if len(points) == len(data):
            at = offsets
        else:
            heads = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
            at = heads[offsets]
        kinds = kind_of[np.minimum(points, _PLAIN - 1)]
        odd = np.zeros(len(offsets) - 1, bool)
        strange = np.flatnonzero((kinds == 255) | (points >= _PLAIN))
        odd[np.searchsorted(at, strange, "right") - 1] = True
        for mark in self.special:
            if mark.encode() in raw:
                odd |= np.array([mark in whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
        first = _matches(points, kinds, at)
        owner = np.searchsorted(at, first, "right") - 1
        last = np.append(first[1:], len(points))[~odd[owner]]
        first, owner = first[~odd[owner]], owner[~odd[owner]]
        hashes, done = np.empty(len(first), np.uint64), 0
        while done < len(first):  # in chunks, as the powers are tables
            base = first[done]
            upto = max(int(np.searchsorted(last, base + T.CHUNK, "right")), done + 1)
            stop = int(last[upto - 1])
            total = np.zeros(stop - base + 1, np.uint64)
            np.cumsum(value_of[np.minimum(points[base:stop], _PLAIN - 1)] * T._power(T._BASE, stop - base), out=total[1:])
            a, b = first[done:upto] - base, last[done:upto] - base
            hashes[done:upto] = (total[b] - total[a]) * T._power(T._BASE_INV, stop - base)[a]
            done = upto
        keys, sample, which = np.unique(T.mix(hashes + (last - first).astype(np.uint64)), return_index=True, return_inverse=True)
        place = self.known(keys, lambda i: whole[first[sample[i]] : last[sample[i]]])[which]
        count = self.count[place]
        flat, number = self.ids[T.spread(self.start[place], count)], np.bincount(owner, count, len(odd)).astype(np.int64)
        if not odd.any():
            return flat, number
        own = {int(i): self.one(whole[at[i] : at[i + 1]]) for i in np.flatnonzero(odd)}
        parts, done = [], np.cumsum(number) - number
        for i in range(len(odd)):
            parts.append(own[i] if odd[i] else flat[done[i] : done[i] + number[i]])
        return np.concatenate(parts), np.array([len(p) for p in parts])

    def known(self, keys: np.ndarray, string) -> np.ndarray:
        """Places of the keys in the store, after those it lacks have been encoded."""
        if len(self.keys) > KEPT:
            self.forget()
        place = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            ids, counts = [self.ids], []
            for lo in range(0, len(new), AT_ONCE):
                some = [x.ids for x in self.library.encode_batch([string(i) for i in new[lo : lo + AT_ONCE].tolist()], add_special_tokens=False)]
                counts.append(np.array([len(x) for x in some]))
                ids.append(np.array([i for x in some for i in x], np.uint32))
            count = np.concatenate(counts)
            start = len(self.ids) + np.cumsum(count) - count
            self.ids = np.concatenate(ids)
            where = np.searchsorted(self.keys, keys[new])
            self.keys, self.start, self.count = (np.insert(old, where, now) for old, now in ((self.keys, keys[new]), (self.start, start), (self.count, count)))
            place = np.searchsorted(self.keys, keys)
        return place


def _matches(points: np.ndarray, kinds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First code point of each match of the byte-level pattern, in all texts.

    Runs of letters, numbers or other signs, each with one space before it; white space before a run gives up its last
    character; after a sign alone that is an apostrophe, a contraction ends where its letters end.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    begin = np.zeros(n + 1, bool)
    begin[at] = True
    begin, final = begin[:-1], begin[1:].copy()
    final[-1] = True
    white = kinds == _WHITE
    changed = begin.copy()
    changed[1:] |= kinds[1:] != kinds[:-1]
    after_space = np.zeros(n, bool)
    after_space[1:] = (points[:-1] == 32) & ~begin[1:]
    last_white = white & ~final
    last_white[:-1] &= ~white[1:]
    last_white[-1] = False
    start = (changed & ~white & ~after_space) | last_white | (white & changed)
    quotes = np.flatnonzero((points == 39) & start & ~final)
    quotes = quotes[changed[quotes] & (kinds[quotes + 1] == _LETTER) & ~begin[quotes + 1]] if len(quotes) else quotes
    for q in quotes.tolist():
        two = chr(points[q + 1]) + (chr(points[q + 2]) if q + 2 < n and not begin[q + 2] else " ")
        size = 2 if two[0] in "stmd" else 3 if two in ("re", "ve", "ll") else 0
        if size:
            start[q + 1] = False
            if q + size < n and not begin[q + size] and kinds[q + size] == _LETTER:
                start[q + size] = True
    return np.flatnonzero(start)


@lru_cache(2)
def _tokens(tokenizer: str) -> Tokens:
    return Tokens(tokenizer)


def token_table(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, part, start, n, ids)``: each row's ids with ``end`` after them as unsigned 16- or 32-bit integers, the
    partition that made them and where they start among its tokens."""
    tune(docs.sparkSession)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, done = _tokens(tokenizer), TaskContext.get().partitionId(), 0
        width = np.uint16 if tokens.library.get_vocab_size() <= 1 << 16 and end < 1 << 16 else np.uint32
        for batch in batches:
            for piece in T.pieces(batch, "text", 2**20):
                ids, number = tokens.batch(*T.buffers(piece.column(1)))
                out = np.full(len(ids) + len(number), end, width)
                full = number + 1
                begin = np.cumsum(full) - full
                out[T.spread(begin, number)] = ids
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.full(len(full), part)), pa.array(done + begin), pa.array(full), T.binaries(out, full)], names=["id", "part", "start", "n", "ids"])
                done += int(full.sum())

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), f"id {kind}, part long, start long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    Documents stand one after another without gaps, each closed by the id ``end``, and are cut every ``length`` tokens;
    only the last sequence can be shorter. Null and empty texts are the ``end`` id alone. Repeated rows are packed
    each; ids may be null. An empty table gives no piece. Other columns are not carried. ``ids_crc32`` is over
    unsigned 32-bit little-endian ids.
    """
    spark = docs.sparkSession
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    table = stash(token_table(docs, tokenizer, end, id_col, text_col), "tokens")
    totals = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, base = 0, {}
    for part, n in totals:
        base[part], before = before, before + n
    at = spark.sparkContext.broadcast(base)  # a number for each partition of the scan
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(3).to_numpy()
            place = batch.column(2).to_numpy() + np.array([at.value[p] for p in batch.column(1).to_pylist()], np.int64)
            cuts = (place + n - 1) // length - place // length + 1
            doc = np.repeat(np.arange(len(n)), cuts)
            sequence = T.spread(place // length, cuts)
            lo, hi = np.maximum(sequence * length, place[doc]), np.minimum((sequence + 1) * length, (place + n)[doc])
            data, offsets = T.buffers(batch.column(4))
            width = (offsets[-1] // max(1, int(n.sum()))) if len(n) else 2
            crc, own = [], []
            for d, a, b in zip(doc.tolist(), (lo - place[doc]).tolist(), (hi - place[doc]).tolist(), strict=True):
                ids = np.frombuffer(data[offsets[d] + a * width : offsets[d] + b * width], f"<u{width}").astype("<u4")
                crc.append(zlib.crc32(ids))
                if with_ids:
                    own.append(ids.astype(np.int64))
            columns = [batch.column(0).take(pa.array(doc)), pa.array(lo - place[doc]), pa.array(hi - lo), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(sequence), pa.array(lo - sequence * length)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.list_(pa.int64()))] * with_ids, names=names)

    longs = ", ".join(f"`{c}` long" for c in names[1:7])
    return table.mapInArrow(tidy(run), f"`{id_col}` {kind}, {longs}" + ", ids array<long>" * with_ids)
