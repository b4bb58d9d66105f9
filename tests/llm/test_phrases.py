"""Removal of repeated passages against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chronofact.llm import phrases
from chronofact.llm.phrases import remove_repeats


def brute(rows, window=35):
    split = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passages = [words(rng.choice([34, 35, 36, 50, 120])) for _ in range(8)]
    rows = []
    for i in range(120):
        text = words(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            text += rng.choice(passages) + words(rng.randrange(40))
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(text)))
    return rows + [(200, "a b " * 100), (201, None), (202, ""), (203, " \r\n"), (204, rows[5][1]), (204, rows[5][1]), (None, rows[7][1]), (205, "z " * 35), (206, "q " * 36), (207, "é " * 5000)]


@pytest.mark.parametrize("bounds", [{}, {"shard": (5, 1000)}, {"shard": (1000, 17)}])
def test_against_brute_force(spark, bounds):
    rows = corpus(sum(bounds.get("shard", ())))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words long").repartition(4)
    got = remove_repeats(df, with_text=True, **bounds).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert remove_repeats(df.limit(0)).count() == 0


def test_text_among_the_columns(spark):
    rows = [(1, "a b c " * 20, "x"), (2, None, "y"), (3, "d e", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_text string")
    got = remove_repeats(df.withColumnRenamed("kept_text", "other"), ["other", "text", "doc_id"]).collect()
    assert sorted((r.doc_id, r.text, r.other) for r in got) == rows
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 60, 60), (2, 0, 0), (3, 2, 0)]


def test_shards_are_bounded_and_hold_every_window(spark):
    rows = corpus(3)
    windows = phrases.recurring_windows(spark.createDataFrame(rows, "doc_id long, text string").select("text"), 35)
    split = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    recurring = sum(n > 1 for n in seen.values())
    assert windows.count() == recurring > 100
    shards = phrases.compiled(windows, 35, 6, 50)
    loaded = [s.load() for s in shards]
    assert sum(len(known) for _, known in loaded) == recurring
    assert all(len(a) <= 6 and len(known) <= 50 for a, known in loaded) and len(shards) > 4


def test_automata_locate_phrases():
    """Every occurrence in a stretch is found, and none that goes over a stretch's end."""
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 40, dtype=np.uint64)[rng.integers(0, 40, 3000)]
    hashes[2000:2010] = hashes[100:110]
    n, patterns = phrases.phrase_words(35), [100, 7, 2990]
    phrase = phrases.phrase_hashes(hashes, n)
    assert [phrases.pattern(int(phrase[p]), n) for p in patterns] == [phrases._text(phrases.letters(hashes[p : p + n])) for p in patterns]
    automaton = phrases.compile_shard([phrases.pattern(int(phrase[p]), n) for p in patterns])
    size = np.array([50, 1850, 1093])
    first = np.cumsum(size) - size
    stretch, word = phrases.locate(automaton, phrases.letters(hashes[:2993]), size, n)
    code = hashes & np.uint64(63)
    want = {i for a, m in zip(first, size, strict=True) for i in range(a, a + m - n + 1) if any((code[i : i + n] == code[p : p + n]).all() for p in patterns)}
    assert {100, 2000, 7} <= want and set((first[stretch] + word).tolist()) == want


def test_what_no_automaton_locates_is_not_removed():
    """Windows are looked up around located phrases only, and only known ones count."""
    texts = pa.array([b"a b c d e f g " * 12, b"x"])
    every = np.full(1 << phrases.BITS >> 3, 255, np.uint8)

    class Bits:
        value = every

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([3, 4]), texts], names=["k1", "k2", "text"])
    (rows,) = phrases._stretches(35, Bits)(iter([batch]))
    w = phrases._Windows.of(texts, 35, every)
    known = np.sort(w.key)
    full = phrases.compile_shard([phrases.pattern(x, phrases.phrase_words(35)) for x in np.unique(w.h).tolist()])
    out = phrases.look_up(rows, 35, full, known)
    found = {s + i for s, m in zip(out.column(2).to_pylist(), out.column(3).to_pylist(), strict=True) for i in range(30) if m >> i & 1}
    assert found == set(w.starts.tolist()) and set(out.column(0).to_pylist()) == {1}
    assert not phrases.look_up(rows, 35, phrases.compile_shard(["!"]), known).num_rows
    assert not phrases.look_up(rows, 35, full, known[:1] + np.uint64(1)).num_rows


@pytest.mark.parametrize("window", [3, 8, 72])
def test_other_windows(spark, window):
    rows = corpus(9)
    assert sorted((tuple(r) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window).collect()), key=str) == brute(rows, window)
