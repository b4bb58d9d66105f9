"""The pipeline on a small corpus: every stage's decisions, held against brute force on that stage's own input."""

import random

import pytest

import corpus_pipeline
from tests.llm import test_minhash, test_phrases


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    syllables = {"xa": ["lo", "ra", "mi", "te"], "yb": ["ör", "schi", "ant", "kel"]}
    words = lambda lang, n: ["".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(2, 5))) for _ in range(n)]
    passage, rows, labels = words("xa", 60), [], []
    for i in range(500):
        lang = rng.choice(["xa", "yb"])
        text = words(lang, rng.randrange(20, 80))
        bad = i % 7 == 0
        if bad:
            for k in range(3):
                text[k * 5] = "vilest" if lang == "xa" else "nasty" + text[k * 5]
        if i % 11 == 0:
            text += passage
        rows.append((i, " ".join(text), lang, "s", 0))
        labels.append((i, 1, int(bad)))
        if i % 13 == 0:
            rows.append((1000 + i, " ".join([*text[:-1], "lomi"]), lang, "s", 0))
    rows += [(3000, "ы" * 300, None, "s", 0), (3001, None, None, "s", 0), (None, " ".join(words("xa", 30)), None, None, None)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        before, after = [tuple(r) for r in docs.collect()], [tuple(r) for r in out.collect()]
        if name == "toxicity":
            gone = {r[0] for r in before} - {r[0] for r in after}
            toxic = {r[0] for r in before if r[1] and ("vilest" in r[1] or "nasty" in r[1])}
            assert len(gone ^ toxic) <= 2
        elif name == "language":
            assert {r[0] for r in before} - {r[0] for r in after} == {3000, 3001}
        elif name == "near_duplicates":
            kept = {i for i, _, _, keep in test_minhash.brute([r[:2] for r in before]) if keep}
            assert {r[0] for r in after} == kept and len(after) == len(kept) < len(before)
        elif name == "repeats":
            want = {i: (n, gone) for i, n, gone, _ in test_phrases.brute([r[:2] for r in before])}
            assert any(gone for _, gone in want.values())
            assert {r[0]: len(r[1].split()) for r in after} == {i: n - gone for i, (n, gone) in want.items()}
            assert all(r[4] == len(r[1]) for r in after)
        else:
            assert {r[0] for r in after} == {r[0] for r in before}
        seen.append(name)
        if name != "packing":
            docs = spark.createDataFrame(after, docs.schema)
    assert seen == [n for n, _ in corpus_pipeline.STAGES]


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_empty_tables_and_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clash = {c: "'z'" for c in ("kept", "score", "toxic", "rejected", "lang_pred", "n_words", "kept_text", "start", "id", "text2")}
    more = docs.selectExpr("*", *(f"{v} as {c}" for c, v in clash.items()))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        out = stage(spark, more, folder)
        if name != "packing":
            assert out.columns == more.columns and {r.kept for r in out.select("kept").collect()} == {"z"}, name
