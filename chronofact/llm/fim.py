"""Fill-in-the-middle transformation by a parallel scan of an automaton.

One automaton over the bytes of UTF-8 finds where tokens (``[A-Za-z]+|[^A-Za-z]``) begin and where a sentinel ends. A
chunk of text emits its function: for each state it may be entered in, the state it is left in, the tokens that begin in
it and the sentinels that end in it. Functions compose associatively, so chunks of giant documents are dealt out over all
tasks, one scan of their small functions gives each chunk's entry state, and the token at which a cut lies is selected in
the one chunk that holds it. A text of one chunk goes through the same steps where it is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.llm import text as T
from chronofact.llm.storage import tidy, tune

#: Bytes of a chunk; longer documents are scanned by several tasks.
CHUNK = 1 << 15
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

#: States: nothing open, in a run of letters, after "<", after "<" and a sentinel's letter.
_IDLE, _LETTERS, _OPEN, _NAMED = range(4)
#: Classes of bytes: others that begin a character, letters, sentinels' letters, "<", ">", bytes inside a character.
_OTHER, _LETTER, _NAME, _LESS, _MORE, _INSIDE = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[m[1] for m in (PREFIX, SUFFIX, MIDDLE)]] = _NAME
_CLASS[ord("<")], _CLASS[ord(">")] = _LESS, _MORE
_CLASS[0x80:0xC0] = _INSIDE
#: By state and class: the next state, whether a token begins, whether a sentinel ends.
_NEXT = np.array([[_NAMED if s == _OPEN and c == _NAME else _LETTERS if c in (_LETTER, _NAME) else _OPEN if c == _LESS else _IDLE for c in range(6)] for s in range(4)], np.uint8)
_BEGINS = np.array([[c != _INSIDE and not (s in (_LETTERS, _NAMED) and c in (_LETTER, _NAME)) for c in range(6)] for s in range(4)])
_ENDS = np.array([[s == _NAMED and c == _MORE for c in range(6)] for s in range(4)])
#: Two bytes settle the state, whatever it was before them.
_AFTER = _NEXT[_NEXT[0][:, None], np.arange(6)[None, :]]
assert all((_NEXT[_NEXT[s][:, None], np.arange(6)[None, :]] == _AFTER).all() for s in range(4))


def _states(classes: np.ndarray, entry: int) -> np.ndarray:
    """The state before each byte of a chunk that is entered in ``entry``, and after the last."""
    out = np.empty(len(classes) + 1, np.uint8)
    out[0] = entry
    if len(classes):
        out[1] = _NEXT[entry, classes[0]]
        out[2:] = _AFTER[classes[:-1], classes[1:]]
    return out


@dataclass
class Scan:
    """Functions of consecutive chunks: rows are chunks, columns the states they may be entered in."""

    to: np.ndarray
    tokens: np.ndarray
    marks: np.ndarray

    @classmethod
    def of(cls, chunk: np.ndarray) -> Scan:
        """The function of one chunk of bytes; entry states meet after two bytes, the rest is shared."""
        classes = _CLASS[chunk]
        head, rest = classes[:2], _states(classes, _IDLE)[2:-1]
        tokens = np.full(4, _BEGINS[rest, classes[2:]].sum() if len(classes) > 2 else 0, np.int64)
        marks = np.full(4, _ENDS[rest, classes[2:]].sum() if len(classes) > 2 else 0, np.int64)
        to = np.arange(4, dtype=np.uint8)
        for c in head:
            tokens, marks, to = tokens + _BEGINS[to, c], marks + _ENDS[to, c], _NEXT[to, c]
        if len(classes) > 2:
            to = np.full(4, _AFTER[classes[-2], classes[-1]], np.uint8)
        return cls(to[None], tokens[None], marks[None])

    def then(self, other: Scan) -> Scan:
        """Each row of this followed by that row of ``other``: the associative composition."""
        row = np.arange(len(self.to))[:, None]
        return Scan(other.to[row, self.to], self.tokens + other.tokens[row, self.to], self.marks + other.marks[row, self.to])

    def rows(self, at: slice) -> Scan:
        return Scan(self.to[at], self.tokens[at], self.marks[at])

    def prefixes(self) -> Scan:
        """Of each chunk the function of all chunks up to it, by compositions of runs of doubling length."""
        out, reach = Scan(self.to.copy(), self.tokens.copy(), self.marks.copy()), 1
        while reach < len(out.to):
            longer = out.rows(slice(None, -reach)).then(out.rows(slice(reach, None)))
            out = Scan(*(np.concatenate([old[:reach], new]) for old, new in zip((out.to, out.tokens, out.marks), (longer.to, longer.tokens, longer.marks), strict=True)))
            reach *= 2
        return out


def select(chunk: np.ndarray, entry: int, k: int) -> int:
    """The byte at which token ``k`` of those that begin in the chunk begins, counted from 0."""
    classes = _CLASS[chunk]
    return int(np.flatnonzero(_BEGINS[_states(classes, entry)[:-1], classes])[k])


def _cuts(digest: str, n: int) -> tuple[int, int]:
    a, b = int(digest[:8], 16) % (n + 1), int(digest[8:16], 16) % (n + 1)
    return min(a, b), max(a, b)


def restored(output: bytes, form: str) -> bytes:
    """The text that an output of the form was made of."""
    if form == "plain":
        return output
    first, second = (SUFFIX, MIDDLE) if form == "psm" else (PREFIX, MIDDLE)
    a = output.index(first, 3)
    b = output.index(second, a)
    one, two, middle = output[3:a], output[a + 3 : b], output[b + 3 :]
    return one + middle + two if form == "psm" else two + middle + one


def _placed(scan: Scan, digest: str) -> tuple[int, int, list[tuple[int, int, int]]]:
    """Of a whole text, by its chunks' functions: tokens, sentinels, and for both cuts the chunk, the state in which that
    is entered, and the token's number in it; chunk -1 is the text's end."""
    upto = scan.prefixes()
    total = upto.tokens[:, _IDLE]
    entry = np.concatenate([[_IDLE], upto.to[:-1, _IDLE]])
    n, out = int(total[-1]), []
    for k in _cuts(digest, n):
        at = int(np.searchsorted(total, k, "right"))
        out.append((at, int(entry[at]), k - int(total[at - 1] if at else 0)) if k < n else (-1, 0, 0))
    return n, int(upto.marks[-1, _IDLE]), out


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, mark, no, chunk`` to ``id, mark, no, f``: the chunk's function, twelve numbers."""
    for b in batches:
        data, at = T.buffers(b.column("chunk"))
        found = [Scan.of(data[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        f = np.concatenate([np.concatenate([s.to, s.tokens, s.marks], 1) for s in found]).astype(np.int64) if found else np.zeros((0, 12), np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * 12), pa.array(f.ravel()))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("mark"), b.column("no"), lists], names=["id", "mark", "no", "f"])


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document and chunk to ``id, mark, place``: tokens, sentinels and both cuts' places, eight numbers.
    A document's functions are held together: 96 bytes for each chunk of one cell of text."""
    key, own, f = None, None, []

    def row() -> pa.RecordBatch:
        x = np.array(f, np.int64)
        n, marks, cuts = _placed(Scan(x[:, :4].astype(np.uint8), x[:, 4:8], x[:, 8:]), own.column("h")[0].as_py())
        return pa.RecordBatch.from_arrays([own.column("id"), own.column("mark"), pa.array([[n, marks, *cuts[0], *cuts[1]]], pa.list_(pa.int64()))], names=["id", "mark", "place"])

    for b in batches:
        done = []
        for i, (now, x) in enumerate(zip(zip(b.column("id").to_pylist(), b.column("mark").to_pylist(), strict=True), b.column("f").to_pylist(), strict=True)):
            if now != key:
                if f:
                    done.append(row())
                key, own, f = now, b.slice(i, 1), []
            f.append(x)
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if f:
        yield row()


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, chunk: int = CHUNK, with_output: bool = False
) -> DataFrame:
    """Each text cut at two token borders and put together anew for learning to fill in the middle.

    One row for each row of ``df``: the id, ``n`` (tokens), ``form`` (``plain``, ``psm`` or ``spm``), ``prefix_chars`` and
    ``middle_chars`` (null if plain), ``output_sha256``, ``restored_sha256`` (of the text rebuilt from output and form),
    and, if asked for, ``output`` (binary). Cuts and forms come from the hash of ``<seed>:<id>``, a null id counting as
    empty; a null text is empty. A text that is empty or holds a sentinel stays plain, as do ``plain_percent`` of all.
    Repeated rows give repeated rows; other columns are not carried, so their names cannot clash.

    Documents of more than ``chunk`` bytes are dealt out in chunks, keyed by id, text and place, so that copies and very
    long texts spread; only their functions of twelve numbers come together. Such texts are shuffled twice, others never.
    """
    spark = df.sparkSession
    tune(spark)
    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    hash_of = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), hash_of.alias("h"))
    giant = docs.where(F.octet_length("text") > chunk).withColumn("mark", F.md5("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column("text")):
                data, key = text.as_buffer(), b.select(["id", "mark", "h"]).slice(i, 1)
                for first in range(0, data.size, 64 * chunk):
                    starts = range(first, min(data.size, first + 64 * chunk), chunk)
                    parts = [data.slice(s, min(chunk, data.size - s)).to_pybytes() for s in starts]
                    keys = [pa.concat_arrays([c] * len(parts)) for c in key.columns]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array([s // chunk for s in starts], pa.int64()), pa.array(parts, pa.binary())], names=["id", "mark", "h", "no", "chunk"])

    chunks = giant.mapInArrow(tidy(cut), f"id {kind}, mark string, h string, no long, chunk binary").repartition("id", "mark", "no")
    functions = chunks.drop("h").mapInArrow(tidy(_scanned), f"id {kind}, mark string, no long, f array<long>")
    functions = functions.groupBy("id", "mark", "no").agg(F.first("f").alias("f"))  # repeated rows have equal functions
    functions = functions.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256))
    places = functions.repartition("id", "mark").sortWithinPartitions("id", "mark", "no").mapInArrow(tidy(_composed), f"id {kind}, mark string, place array<long>")
    places = places.select(F.col("id").alias("of"), F.col("mark").alias("of_mark"), "place")
    met = giant.join(places.hint("merge"), F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark"))).select("id", "text", "h", "place")
    rows = docs.where(F.octet_length("text") <= chunk).withColumn("place", F.lit(None).cast("array<long>")).union(met)
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *["output"] * with_output]

    def one(text: np.ndarray, digest: str, place: list[int] | None) -> tuple:
        if place is None:
            n, marks, cuts = _placed(Scan.of(text), digest)
        else:
            n, marks, cuts = place[0], place[1], [tuple(place[2:5]), tuple(place[5:8])]
        whole = text.tobytes()
        if not whole or marks or int(digest[16:24], 16) % 100 >= 100 - plain_percent:
            form, output, chars = "plain", whole, (None, None)
        else:
            # A text of one chunk is that chunk; of a longer one, only the chunk that holds the cut is looked at.
            a, b = (len(whole) if at < 0 else at * chunk + select(text[at * chunk : (at + 1) * chunk] if place else text, entry, k) for at, entry, k in cuts)
            prefix, middle, suffix = whole[:a], whole[a:b], whole[b:]
            form = "spm" if int(digest[24:32], 16) % 100 < spm_percent else "psm"
            output = SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle if form == "spm" else PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
            chars = tuple(int(((text[i:j] & 0xC0) != 0x80).sum()) for i, j in ((0, a), (a, b)))
        again = hashlib.sha256(restored(output, form)).hexdigest()
        return n, form, *chars, hashlib.sha256(output).hexdigest(), again, *[output] * with_output

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for b in T.pieces(batch, "text"):
                data, at = T.buffers(b.column("text"))
                found = [one(data[i:j], h, place) for i, j, h, place in zip(at[:-1], at[1:], b.column("h").to_pylist(), b.column("place").to_pylist(), strict=True)]
                columns = list(zip(*found, strict=True)) if found else [()] * (len(names) - 1)
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=False))], names=names)

    out = f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return rows.mapInArrow(tidy(run), out + ", output binary" * with_output)
