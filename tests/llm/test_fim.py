"""Fill-in-the-middle against a plain definition, and the automaton's functions against a walk byte by byte."""

import hashlib
import random
import re

import numpy as np
import pytest

from chronofact.llm import fim
from chronofact.llm.fim import Scan, fill_in_middle, restored, select


def brute(i, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, len(w), "plain", None, None, sha(text), sha(text)
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return i, len(w), form, len(p), len(m), sha(out), sha(text)


def texts():
    rng = random.Random(7)
    pool = ["a", "Zb", "P", "S", "<", ">", "<P", "<P>", " ", "é", "\U0001f600", "\n", "1", "<<", "S>", "\x00"]
    few = [p for p in pool if "<" not in p]
    out = [None, "", "é", "<", "<P>", "x<P>y", "<PP>", "<p>", "a" * 5000, "é" * 4001, "<" * 300, " <S" * 100 + "> "]
    return out + ["".join(rng.choices(pool if n % 3 else few, k=rng.choice([1, 2, 3, 40, 900]))) for n in range(150)] + ["ab1 é<" * 700 + "<M>", "ab1 é<" * 700]


@pytest.mark.parametrize("chunk", [7, 64, 1 << 15])
def test_same_as_definition(spark, chunk):
    rows = list(enumerate(texts())) + [(None, "a b c " * 99), (None, "a b c " * 99), (None, None), (3, "a b c " * 99), (3, "a b c " * 99), (3, "a b d " * 99)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n string").repartition(3)
    got = sorted(map(tuple, fill_in_middle(df, chunk=chunk).collect()), key=repr)
    assert got == sorted((brute(i, t) for i, t in rows), key=repr)
    assert all(r[5] == r[6] or r[2] != "plain" for r in got)


def test_one_text_many_times(spark):
    """A giant text that a third of all rows hold, under ids of their own and under one id."""
    text = "Ein Satz, noch einer; " * 400
    rows = [(i, text) for i in range(60)] + [(1000, text)] * 60 + [(2000 + i, f"kurz {i}") for i in range(60)]
    got = sorted(map(tuple, fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), chunk=256).collect()))
    assert got == sorted(brute(i, t) for i, t in rows)


def test_outputs_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([("k1", "alpha beta gamma delta"), ("k2", "<M>"), (None, None)], "key string, body string")
    for r in fill_in_middle(df, "key", "body", with_output=True).collect():
        text = {"k1": b"alpha beta gamma delta", "k2": b"<M>", None: b""}[r.key]
        assert restored(bytes(r.output), r.form) == text and hashlib.sha256(bytes(r.output)).hexdigest() == r.output_sha256
    assert fill_in_middle(df.limit(0), "key", "body").count() == 0


def test_functions_compose(monkeypatch):
    rng = random.Random(3)
    for _ in range(200):
        data = np.frombuffer("".join(rng.choices(["a", "P", "<", ">", "é", " "], k=rng.randrange(1, 60))).encode(), np.uint8)
        cuts = sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(5))})
        parts = [Scan.of(data[a:b]) for a, b in zip(cuts, cuts[1:])]
        one, two = parts[0], parts[-1]
        for p in parts[1:]:
            one = one.then(p)
        for p in parts[-2::-1]:
            two = p.then(two)
        whole, stacked = Scan.of(data), Scan(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("to", "tokens", "marks"))).prefixes().rows(slice(-1, None))
        for f in ("to", "tokens", "marks"):
            assert (getattr(whole, f) == getattr(one, f)).all() and (getattr(one, f) == getattr(two, f)).all() and (getattr(one, f) == getattr(stacked, f)).all()
        for entry in range(4):
            state, begins, marks = entry, [], 0
            for k, c in enumerate(fim._CLASS[data]):
                begins += [k] * bool(fim._BEGINS[state, c])
                marks += bool(fim._ENDS[state, c])
                state = fim._NEXT[state, c]
            assert (whole.to[0, entry], whole.tokens[0, entry], whole.marks[0, entry]) == (state, len(begins), marks)
            assert [select(data, entry, k) for k in range(len(begins))] == begins
