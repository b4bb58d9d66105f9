"""Language identification: held-out accuracy, awkward rows, and that probabilities sum to one."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofact.llm import langid
from chronofact.llm.langid import identify, learnable, train

SYLLABLES = {"xa": ["lo", "ra", "mi", "te"], "yb": ["ör", "schi", "ant", "kel"], "zc": ["né", "oux", "ille", "qua"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, text(rng, lang, rng.randrange(3, 60)), lang if i % 9 else None, "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string").repartition(4)


def test_held_out(docs):
    held, labelled = learnable(docs)
    got = identify(docs.withColumn("held_out", held), labelled, columns=["doc_id", "held_out", "lang"]).collect()
    test = [r for r in got if r.held_out and r.lang]
    assert len(test) > 50 and np.mean([r.lang == r.lang_pred for r in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and not any(r.rejected for r in got)


def test_awkward_rows(spark, docs):
    _, labelled = learnable(docs)
    rng = random.Random(3)
    odd = [(1, None), (2, ""), (3, "123 !!"), (None, text(rng, "yb", 30)), (4, text(rng, "zc", 300_000)), (4, text(rng, "zc", 9)), (5, "ы" * 200)]
    df = spark.createDataFrame(odd, "doc_id long, text string")
    got = sorted(((r.doc_id, r.lang_pred, r.rejected) for r in identify(df, labelled).collect()), key=str)
    assert [x for x in got if x[0] in (1, 2, 3)] == [(1, "und", True), (2, "und", True), (3, "und", True)]
    assert [x for x in got if x[0] == 4] == [(4, "zc", False)] * 2 and (None, "yb", False) in got
    assert [x[2] for x in got if x[0] == 5] == [True]
    assert identify(df, labelled.where(F.lit(False))).where("lang_pred = 'und' and rejected").count() == len(odd)
    assert identify(df.limit(0), labelled).count() == 0


def test_probabilities_sum_to_one(docs):
    """Over a language's own letters, of which one is left out where nothing but a space would be no text."""
    models = train(learnable(docs)[1])
    for i, lang in enumerate(models.languages):
        letters = sorted({c for x in SYLLABLES[lang] for c in x} | {" "})
        for before in ["lora", "örschi", "né o", "r"]:
            of = lambda texts: models.entropy(texts)[0][:, i] * [len(x) for x in texts]
            total = (2.0 ** (of([before]) - of([before + c for c in letters]))).sum()
            assert 0.9 < total < 1 + 1e-3, (lang, before, total)


def test_neighbours_make_no_difference(docs, monkeypatch):
    models = train(learnable(docs)[1])
    rng = random.Random(5)
    some = [text(rng, "xa", 40), None, "1", text(rng, "zc", 7), "", text(rng, "yb", 300)]
    a, n = models.entropy(some)
    for i, x in enumerate(some):
        alone, m = models.entropy([x])
        assert (alone[0] == a[i]).all() and m[0] == n[i]
    monkeypatch.setattr(langid, "CHUNK", 16)
    b, m = models.entropy(some)
    assert np.allclose(a, b, atol=1e-5) and (n == m).all()


class Plain:
    """Interpolated Kneser-Ney of one language by its definition, on strings."""

    def __init__(self, texts, order):
        self.order, counts = order, Counter()
        for x in texts:
            padded = "\x00" * (order - 1) + normal(x)
            counts.update(padded[i : i + order] for i in range(len(padded) - order + 1))
        self.counts = {order: counts}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discount, self.total, self.kinds = {}, Counter(), Counter()
        for k, own in self.counts.items():
            one, two = (sum(n == c for n in own.values()) for c in (1, 2))
            self.discount[k] = one / (one + 2 * two) if one and two else 0.5
            for g, n in own.items():
                self.total[g[:-1]] += n
                self.kinds[g[:-1]] += 1

    def p(self, gram):
        context, k = gram[:-1], len(gram)
        lower = self.p(gram[1:]) if k > 1 else 1 / (len(self.counts[1]) + 1)
        if not self.total[context]:
            return lower
        d = self.discount[k]
        return max(self.counts[k][gram] - d, 0) / self.total[context] + d * self.kinds[context] / self.total[context] * lower

    def bits(self, x):
        padded = "\x00" * (self.order - 1) + normal(x)
        return -sum(math.log2(self.p(padded[i : i + self.order])) for i in range(len(padded) - self.order + 1)) / len(normal(x))


def normal(x):
    out = "".join(c if c.isalpha() else " " for c in x.lower())
    return "".join(c for i, c in enumerate(out) if c != " " or (i and out[i - 1] != " "))


@pytest.mark.parametrize("order", [1, 3, 5])
def test_against_dictionaries(docs, monkeypatch, order):
    labelled = learnable(docs)[1]
    fold = F.pmod(F.xxhash64(F.lit(1), "__hash"), F.lit(langid.CALIBRATION))
    rows = labelled.where("lang is not null").withColumn("fold", fold).collect()
    models = train(labelled, order)
    rng = random.Random(1)
    held = [text(rng, x, n) for x in SYLLABLES for n in (1, 5, 40)] + ["\u044b lora 7\u044b", "ra"]
    got = models.entropy(held)[0]
    assert models.languages == sorted(SYLLABLES)
    for i, lang in enumerate(models.languages):
        plain = Plain([r.text for r in rows if r.lang == lang and r.fold], order)
        assert np.allclose(got[:, i], [plain.bits(x) for x in held], rtol=1e-5)


def test_few_texts_are_measured_by_models_of_the_others(spark, docs):
    rng = random.Random(11)
    some = [(7000 + i, text(rng, "xa", 30).replace("a", "q"), "rare") for i in range(12)] + [(8000, "kjkjkj", "once")]
    labelled = learnable(docs.select("doc_id", "text", "lang").union(spark.createDataFrame(some, "doc_id long, text string, lang string")))[1]
    models = train(labelled)
    limit = dict(zip(models.languages, models.limit, strict=True))
    assert np.isfinite(limit["rare"]) and limit.get("once", np.inf) == np.inf
    fresh = spark.createDataFrame([(i, text(rng, "xa", 20).replace("a", "q")) for i in range(40)], "doc_id long, text string")
    got = identify(fresh, labelled).collect()
    assert all(r.lang_pred == "rare" for r in got) and sum(r.rejected for r in got) <= 2


def test_rows_of_one_id_are_drawn_apart(spark, docs):
    one = docs.selectExpr("1 as doc_id", "text", "lang")
    got = identify(one, learnable(one)[1]).collect()
    assert sum(r.lang_pred == "und" for r in got) == 0
