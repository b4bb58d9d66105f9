"""Packing against the tokenizer itself, and the pattern's matches against the regex."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
from tokenizers import Tokenizer

from chronofact.llm import packing
from chronofact.llm import text as T
from chronofact.llm.packing import Tokens, pack

import pyarrow as pa

FILE = P.path("byte_bpe_50k.json")
SIGNS = ["a", "B", "é", "ß", "ª", "1", "²", "!", "?", "'", "'s", "'ll", "'re", "'t", "'d", "'ve", "'m", "'S", " ", "  ", "\n", "\t", " ", "\u0085", "\x1c", "_", "—", "the", " and", "¿", "­"]


def texts(seed, n=300):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_ids_are_the_library_s(seed, monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 500)
    own, library = Tokens(FILE), Tokenizer.from_file(FILE)
    for k in range(4):
        some = texts(10 * seed + k) + ["", "x<|endoftext|>y", "日本 語 's", "emoji 😀 here", "'", "a'"]
        ids, number = own.batch(*T.buffers(pa.array(some)))
        ends = np.cumsum(number)
        for t, e, n in zip(some, ends, number, strict=True):
            assert ids[e - n : e].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_matches_are_the_pattern_s():
    for t in texts(99, 2000):
        if not t:
            continue
        points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        got = packing._matches(points, packing._classes()[0][np.minimum(points, packing._PLAIN - 1)], np.array([0, len(points)]))
        assert got.tolist() == [m.start() for m in regex.finditer(P.PATTERN, t)], repr(t)


def test_pack(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts(5, 60))] + [(100, None, 0), (101, ""), (102, "word " * 9000), (None, "x"), (7, "same"), (7, "same")]
    df = spark.createDataFrame([(r[0], r[1], "c") for r in rows], "doc_id long, text string, start string").repartition(5)
    library = Tokenizer.from_file(FILE)
    got = pack(df, FILE, with_ids=True).collect()
    sequences = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4")) and len(r.ids) == r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s, parts in sequences.items():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) == 2048 or s == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))
    want = sorted(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sorted(r.doc_tokens for r in got if r.start == 0) == want
    for i in (3, 100, 102):
        own = sorted((r.start, r.ids) for r in got if r.doc_id == i)
        assert [x for _, ids in own for x in ids] == library.encode(rows[[r[0] for r in rows].index(i)][1] or "", add_special_tokens=False).ids + [1]
    assert pack(df.limit(0), FILE).count() == 0
