"""URL rules, TIFF and BPE against the libraries, round trips and awkward rows."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex

from chronofact.llm import tiff
from chronofact.llm.bpe import LONG, Codec, bpe_decode, bpe_digest, bpe_encode
from chronofact.llm.urlrules import split_url, url_verdicts

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
ROWS = [(1, None), (1, "a  b"), (None, "x"), (2, ""), (2, ""), (3, "é'll \n\n x's 12ab " * 9000), (4, "a" * 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in ROWS], "doc_id long, text string, n_tokens string").repartition(3)


def test_url_rules(spark):
    urls = {None: (None, "allow"), "no scheme": (None, "allow"), "http://COM/": ("com/", "allow"), "http://a.Example.com/en/x?y=/": ("example.com/en/", "block"), "x://www.example.com/en/": ("www.example.com/en/", "allow"), "x://badexample.com/en/": ("com/", "allow"), "x://n.net/es/1": ("net/es/", "block"), "x://n.net/est/": (None, "allow"), "x://n.com": (None, "allow")}
    rows = list(urls.items()) + [("x://n.net/es/1", urls["x://n.net/es/1"])]
    df = spark.createDataFrame([(i if i else None, u, "z") for i, (u, _) in enumerate(rows)], "page_id long, url string, host string")
    got = {(r.page_id, r.rule, r.verdict) for r in url_verdicts(df, RULES).collect()}
    assert got == {(i if i else None, *want) for i, (_, want) in enumerate(rows)}
    assert url_verdicts(df.limit(0), RULES).count() == 0
    assert split_url("http://A.B:8/p/q#f?x") == ("a.b:8", "/p/q")


def test_no_rules_and_two_verdicts(spark):
    df = spark.createDataFrame([(1, "x://a.com/p"), (2, None)], "page_id long, url string")
    assert sorted(tuple(r) for r in url_verdicts(df, [], "block").collect()) == [(1, "a.com", "/p", None, "block"), (2, "", "", None, "block")]
    with pytest.raises(ValueError):
        url_verdicts(df, [("allow", "com/"), ("block", "com/")])


def test_url_rules_in_several_indexes(spark, monkeypatch):
    monkeypatch.setattr("chronofact.llm.urlrules.INDEX_RULES", 1)
    df = spark.createDataFrame([(1, "x://www.example.com/en/"), (2, "x://b.example.com/en/")], "page_id long, url string")
    assert {(r.page_id, r.verdict) for r in url_verdicts(df, RULES).collect()} == {(1, "allow"), (2, "block")}


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_round_trip(scheme, predictor, tile):
    rng = random.Random(scheme + predictor)
    for rows in (1, 40, 700):
        data = bytes(rng.choice(b"aaab \x00\xff") for _ in range(rows * 96)) + b"\x07" * 96
        pages = list(tiff.read_pages(tiff.write_tiff(data, 32, 3, scheme, predictor, page_rows=300, strip_rows=64, tile=tile)))
        assert b"".join(p.pixels for p in pages) == data
        assert [p.number for p in pages] == list(range(-(-(rows + 1) // 300)))


def test_lzw_clears_its_table():
    data = bytes(random.Random(5).randrange(256) for _ in range(20_000))
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def test_tiff_pages_and_errors(spark):
    good = tiff.write_tiff(bytes(range(192)) * 5, 64, 3, page_rows=2)
    df = spark.createDataFrame([(1, good), (2, None), (3, b""), (4, b"II*\0broken"), (None, good), (5, good[:-30])], "doc_id long, media binary")
    rows = tiff.tiff_pages(df).collect()
    assert sorted((r.doc_id, r.page) for r in rows if r.doc_id == 1) == [(1, 0), (1, 1), (1, 2)]
    assert [r.error is not None for r in rows if r.doc_id == 4] == [True]
    assert not [r for r in rows if r.doc_id in (2, 3)]


def entries(*tags, data=b"", order="<", size=8):
    """A file of one page with these tags; its data stands at byte 8."""
    body = struct.pack(order + "H", len(tags)) + b"".join(struct.pack(order + "HHII", t, 4, 1, v) for t, v in sorted(tags)) + b"\0" * 4
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(data)) + data + body


PAGE = [(256, 8), (257, 2), (258, 8), (273, 8), (278, 2), (279, 16)]


@pytest.mark.parametrize("change", [{278: 0}, {256: 0}, {257: 4_000_000_000}, {256: 4_000_000_000}, {273: 10**9}, {279: 1}, {259: 99}, {259: 8}, {259: 5}, {317: 9}, {258: 3}, {277: 0}, {277: 65535}, {322: 16}, {324: 8}])
def test_broken_media_give_an_error_row(spark, change):
    data = bytes(range(16))
    blob = entries(*(dict(PAGE) | change).items(), data=data)
    good = entries(*PAGE, data=data)
    rows = {r.doc_id: r for r in tiff.tiff_pages(spark.createDataFrame([(1, bytearray(blob)), (2, bytearray(good))], "doc_id long, media binary").coalesce(1)).collect()}
    assert rows[2].pixels == data and rows[2].error is None
    assert change == {322: 16} or (rows[1].error and rows[1].pixels is None)


def test_depths_and_predictors():
    def read(data, order="<", **tags):
        given = {int(k[1:]): v for k, v in tags.items()}
        return next(tiff.read_pages(entries(*({256: 4, 257: 2, 273: 8, 278: 2, 279: len(data)} | given).items(), data=data, order=order)))

    assert read(bytes([0b10100000, 0b01010000]), t258=1).pixels == bytes([1, 0, 1, 0, 0, 1, 0, 1])
    assert read(bytes([0b00000101, 0b00001010]), t266=2, t258=1).pixels == bytes([1, 0, 1, 0, 0, 1, 0, 1])
    assert read(bytes([0b00011011, 0b11100100])).bits == 1
    assert read(bytes([0b00011011, 0b11100100]), t258=2).pixels == bytes([0, 1, 2, 3, 3, 2, 1, 0])
    assert read(bytes([0x12, 0x34, 0xFE, 0xDC]), t258=4).pixels == bytes([1, 2, 3, 4, 15, 14, 13, 12])
    for order in "<>":
        for deep in (16, 32):
            want = np.array([[7, 5, 900, 1], [3, 2, 1, 60_000]], f"{order}u{deep // 8}")
            apart = np.concatenate([want[:, :1], want[:, 1:] - want[:, :-1]], 1).astype(want.dtype)
            assert read(apart.tobytes(), order, t258=deep, t317=2).pixels == want.tobytes()
        floats = np.array([[1.5, -2.25, 1e30, 0], [3, 4, 5, -6]], ">f4")
        planes = floats.view(np.uint8).reshape(2, 4, 4).transpose(0, 2, 1).reshape(2, 16)
        apart = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], 1)
        assert read(apart.tobytes(), order, t258=32, t317=3).pixels == floats.astype(order + "f4").tobytes()


def test_tiff_digest(spark, docs):
    rows = tiff.tiff_digest(docs, page_rows=40).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in rows) == sorted((i or 0, len((t or "").encode())) for i, t in ROWS)
    for r in rows:
        texts = [(t or "").encode() for i, t in ROWS if i == r.doc_id and len((t or "").encode()) == r.n_bytes]
        padded = texts[0].ljust(max(192, -(-len(texts[0]) // 192) * 192))
        media, seen = tiff.write_tiff(padded, 64, 3, page_rows=40), np.frombuffer(padded, np.uint8)
        bands = ",".join(map(str, np.bincount(seen // 32, minlength=8)))
        feature = f"pages={-(-len(padded) // (192 * 40))};rows={len(padded) // 192};sum={seen.sum()};min={seen.min()};max={seen.max()};bands={bands}"
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), feature)
    assert tiff.tiff_digest(docs.limit(0)).count() == 0


def test_bpe(docs, spark):
    ranks, c = P.path("byte_bpe_50k.tiktoken"), Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = sorted((i or 0, len(ids := c.encoding.encode_ordinary(t or "")), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_digest(docs, ranks, P.PATTERN).collect()) == want
    back = bpe_decode(bpe_encode(docs, ranks, P.PATTERN), ranks, P.PATTERN)
    assert sorted((r.doc_id or 0, bytes(r.bytes)) for r in back.collect()) == sorted((i or 0, (t or "").encode()) for i, t in ROWS)
    assert bpe_digest(docs.limit(0), ranks, P.PATTERN).count() == 0


def test_long_texts_are_cut_only_where_nothing_changes():
    c, rng = Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), random.Random(1)
    for _ in range(5):
        text = "".join(rng.choice([" ", "  ", "\n", "'s", "word", "12", "!?", "é", " \u3000x", "\u00a0"]) for _ in range(LONG))
        assert len(list(c.parts(text))) > 1
        assert c.encode(text).tolist() == c.encoding.encode_ordinary(text)


def test_long_white_space():
    c, word = Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), regex.compile(P.PATTERN)
    for text in (" " * 3_000_000, "\n" * 3_000_000 + "a", "\t " * 700_000 + "word", "x y" + " " * 1_500_000 + "\u3000word" + "\n" * 5000 + " b"):
        ids = c.encode(text)
        assert ids.tolist() == [i for m in word.finditer(text) for i in c.encoding._encode_single_piece(m[0])]
        assert c.decode(ids) == text.encode()
    rng = random.Random(2)
    for _ in range(30):
        text = "".join(rng.choice([" " * rng.randrange(9000), "\n" * rng.randrange(6000), "a", "b c", "\u00e9!", "'s", " 12", "\u3000" * 5000]) for _ in range(rng.randrange(9)))
        assert c.encode(text).tolist() == c.encoding.encode_ordinary(text)
