"""Personal data: base spans against the plain expressions, the trees on held-out cases, awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from chronofact.llm import pii
from chronofact.llm.pii import KINDS, Trees, base_spans, boost, calibrated, find_personal, luhn, proposals, redacted, train

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PATTERNS[kind], text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 16 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 8 <= len(d) <= 15):
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_those_of_the_expressions():
    rng = random.Random(4)
    pool = ["1", "23", "456", "4111111111111111", "255", "0001", ".", ".", " ", "-", "+", "(", ")", "@", "a", "b.c", "é", "\n", "..", "%", "_", "٣"]
    for n in range(6000):
        text = "".join(rng.choices(pool, k=rng.choice([5, 20, 60])))
        assert base_spans(text) == brute(text), text
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_linear_on_long_runs():
    for unit in ("a", "1", "1.", "1 ", "+1", "+", "@", "a@", "a@b.", "1.2.3.", "::", "a at ", "(", "1:"):
        text = unit * (300_000 // len(unit))
        assert base_spans(text) is not None and sum(1 for _ in proposals(text)) < 3_000_000


WORDS = "the of reading wenig pour and house lines that eine donde con at noon more is it".split()


def sentence(rng, item):
    return " ".join(rng.choices(WORDS, k=rng.randint(4, 30))) + (f" {item} " if item else " ") + " ".join(rng.choices(WORDS, k=rng.randint(3, 30)))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    texts = [sentence(rng, pii._personal(rng, rng.choice(KINDS)) if n % 2 else "") for n in range(900)]
    return train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))


def test_planted_and_clean(model):
    """Cases of the test's own making: number run together with others, disguises, and what only looks like it."""
    rng = random.Random(2)
    found = wrong = total = 0
    for n in range(400):
        card, ip, phone = pii._card(rng, True), pii._personal(rng, "ip"), f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        item, want = rng.choice([(f"{card} {ip}", ("card", card)), (f"{rng.randint(0, 255)} {card}", ("card", card)), (f"{phone} {ip}", ("phone", phone)), (f"{phone} {card}", ("phone", phone)), ("max.muster (at) mail dot example dot com", ("email", "max.muster (at) mail dot example dot com")), (ip.replace(".", "[.]"), ("ip", ip.replace(".", "[.]")))])
        text = sentence(rng, item)
        base = base_spans(text)
        spans = {(k, text[a:b]) for k, a, b in base + model.added(text, base)}
        total += 1
        found += want in spans
        clean = sentence(rng, rng.choice(["", pii._card(rng, False), "2024-05-06 12:30", "300.400.1.2", "978-3-16-148410-0", "12,345.67", 'token = "98e4c802c54c4021aa36798284236820092bfe6c"', "version 1.2.3", "see you at noon.de facto", "1234567"]))
        wrong += bool(model.added(clean, base_spans(clean)))
    assert found >= 0.9 * total and wrong <= 0.02 * total, (found, wrong, total)


ROWS = [(1, None), (1, "a@b.co 1.2.3.4"), (None, "a@b.co"), (2, ""), (2, ""), (3, "x +49 30 1234567 y " * 3000), (4, "4451718024887799 27.65.93.188"), (5, "é\U0001f600 a@b.co")]


def test_rows(spark, model):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in ROWS], "doc_id long, text string, spans string, n_ip int").repartition(3)
    got = find_personal(df, model, with_redacted=True).collect()
    assert len(got) == len(ROWS)
    want = sorted(((i, *(sum(s[0] == k for s in brute(t or "")) for k in KINDS), hashlib.sha256(pii.written(brute(t or "")).encode()).hexdigest()) for i, t in ROWS), key=repr)
    assert sorted((tuple(r)[:6] for r in got), key=repr) == want
    for r in got:
        base = [pii.written([s]) for t in (t for i, t in ROWS if i == r.doc_id) for s in brute(t or "")]
        assert len(r.spans.split(",")) - (not r.spans) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added
        assert set(filter(None, r.spans.split(","))) & set(base) or not base or not r.spans
    by = {r.doc_id: r for r in got if r.doc_id in (4, 5)}
    assert "card:0:16" in by[4].spans and by[5].redacted == "é\U0001f600 [EMAIL]"
    assert find_personal(df.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    empty = train(df)
    assert not empty.trees and empty.added("4451718024887799 27.65.93.188", []) == []
    assert [r.spans for r in find_personal(df, empty).collect()] == ["", ""]


def test_model_is_the_same_on_any_partitions_and_copies(spark):
    rng = random.Random(3)
    rows = [(sentence(rng, pii._personal(rng, rng.choice(KINDS))),) for _ in range(120)]
    one = train(spark.createDataFrame(rows, "text string").repartition(1))
    two = train(spark.createDataFrame(rows[::-1] + rows[:1] * 200, "text string").repartition(5))
    assert one.least == two.least and all((one.trees[k].border == two.trees[k].border).all() and (one.trees[k].value == two.trees[k].value).all() for k in one.trees)


def test_trees_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 4] > 0)).astype(float)
    trees = boost(x[:2000], y[:2000], np.ones(2000))
    assert ((trees.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    slow = [trees.start] * 50
    for feature, border, value in zip(trees.feature, trees.border, trees.value):
        for r in range(50):
            node = 0
            while node < 15:
                node = 2 * node + 1 + bool(x[r, feature[node]] > border[node])
            slow[r] += value[node - 15]
    assert np.allclose(trees.margin(x[:50]), slow)
    assert calibrated(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.ones(4), 0.9) == 3.0
    assert calibrated(np.array([0.0, 1]), np.zeros(2), np.ones(2), 0.9) == float("inf")
    assert isinstance(trees, Trees)


def test_redacted():
    assert redacted("call +49 1 a@b.c now", [("phone", 5, 10), ("email", 11, 16)]) == "call [PHONE] [EMAIL] now"
    assert redacted("abcdef", [("ip", 1, 4), ("card", 2, 5)]) == "a[IP]f"
