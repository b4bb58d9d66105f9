"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.llm.storage import tidy, tune

#: Characters from which on a text is split before encoding, and about the size of its parts.
LONG = 1 << 16
#: A cut before one space that stands between two characters that are no white space: no match of the usual
#: byte-level patterns holds a space after its first character unless it holds white space alone, so none spans it.
_SAFE = regex.compile(r"(?<=\S)(?= \S)")
#: Runs of white space from this length on; the library's matcher overflows its stack on runs of about a million.
_RUN = regex.compile(r"\p{White_Space}{4096,}")


class Codec:
    def __init__(self, ranks: str, pattern: str) -> None:
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

    def parts(self, text: str) -> Iterator[str]:
        """The text, cut at safe boundaries if it is long."""
        done = 0
        while len(text) - done > LONG:
            cut = _SAFE.search(text, done + LONG)
            if not cut:
                break
            yield text[done : cut.start()]
            done = cut.start()
        yield text[done:] if done else text

    def encode(self, text: str) -> np.ndarray:
        ids: list[int] = []
        for part in self.parts(text):
            done = 0
            for run in _RUN.finditer(part):
                before = [m.start() for m in _SAFE.finditer(part, max(done, run.start() - LONG), run.start())]
                cut = before[-1] if before else done
                ids += self.encoding.encode_ordinary(part[done:cut])
                done = self._by_match(part, cut, run.end() - 1, ids)
            ids += self.encoding.encode_ordinary(part[done:] if done else part)
        return np.array(ids, "<u4")

    def _by_match(self, text: str, start: int, upto: int, ids: list[int]) -> int:
        """Encodes match after match up to one that ends at ``upto`` or later; where the last match ends."""
        done = start
        for match in self.pattern.finditer(text, start):
            if match.start() >= upto:
                break
            ids += self.encoding._encode_single_piece(match[0])
            done = match.end()
        return done

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


@lru_cache(2)
def codec(ranks: str, pattern: str) -> Codec:
    """One codec for each worker process; workers are used again for later tasks."""
    return Codec(ranks, pattern)


def bpe_encode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` for each row; a null text counts as empty and gives an empty array.

    Rows keep their number and repeated rows stay; other columns are not carried, so their names cannot clash.
    """
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype("<i4") for x in ids], pa.list_(pa.int32()))], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(tidy(run), f"{_typed(df, id_col)}, ids array<int>")


def bpe_decode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, bytes binary)``: the raw bytes, which need not be valid UTF-8; null ids count as none."""
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(np.array(x or [], "<u4")) for x in b.column(1).to_pylist()], pa.binary())], names=[id_col, "bytes"])

    return df.select(id_col, ids_col).mapInArrow(tidy(run), f"{_typed(df, id_col)}, bytes binary")


def bpe_digest(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, decodes the ids again and returns digests of both, without moving ids out of the worker.

    ``doc_id, n_tokens, ids_sha256`` (of little-endian unsigned 32-bit ids), ``decoded_sha256``. Null text: empty.
    """
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(ranks, pattern), lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            n, of_ids, of_bytes = [], [], []
            for text in b.column(1):
                ids = c.encode(text.as_py() or "")
                n.append(len(ids))
                of_ids.append(sha(ids.tobytes()))
                of_bytes.append(sha(c.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(id_col, text_col).mapInArrow(tidy(run), f"{_typed(df, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _typed(df: DataFrame, column: str) -> str:
    return f"`{column}` {df.select(F.col(column)).schema[0].dataType.simpleString()}"
