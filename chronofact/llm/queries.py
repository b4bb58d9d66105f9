"""Queries of the training-data operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.llm import ngram_lm, pii
from chronofact.llm.bpe import bpe_digest
from chronofact.llm.centroids import centroid_clusters
from chronofact.llm.embed_join import near_vectors
from chronofact.llm.fim import fill_in_middle
from chronofact.llm.langid import identify, learnable
from chronofact.llm.minhash import near_duplicates
from chronofact.llm.packing import pack
from chronofact.llm.phrases import remove_repeats
from chronofact.llm.tiff import tiff_digest
from chronofact.llm.toxicity import toxicity
from chronofact.llm.urlrules import url_verdicts

#: The rules of the URL query: verdict and host with path.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out, labelled = learnable(docs)
    return identify(docs.withColumn("held_out", held_out), labelled, columns=["doc_id", "held_out"])


def op3_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", ngram_lm.held_out())
    return ngram_lm.score(docs, ngram_lm.train(docs.where("not held_out")), columns=["doc_id", "held_out"])


def categories(labels: DataFrame) -> DataFrame:
    """The chain's labels: low quality first, as junk is what a toxicity model without it takes for toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = categories(_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    return toxicity(_table(spark, sf_dir, "documents", "doc_id", "text"), labels, ["low_quality", "toxic"])


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op8_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff_digest(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return pii.find_personal(docs, pii.train(docs))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_minhash": op1_minhash, "op2_langid": op2_langid, "op3_ngrams": op3_ngrams, "op4_toxicity": op4_toxicity, "op5_packing": op5_packing, "op6_url_rules": op6_url_rules, "op7_vectors": op7_vectors, "op8_phrases": op8_phrases, "op9_tiff": op9_tiff, "op10_bpe": op10_bpe, "op11_pii": op11_pii, "op12_centroids": op12_centroids, "op13_fim": op13_fim}

_RULE_ROWS = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in URL_RULES)

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Distinct 5-word shingles, links, and the smallest document that links reach.
_NEAR_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
one AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least USING (doc_id)"""

#: Pairs by cosine in double precision, and the smallest vector that links reach.
_VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, y FROM reach JOIN links ON x = other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
number AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN number USING (vec_id)"""

#: Windows of 35 words that occur twice, and the words that they cover.
_REPEAT_SQL = """
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS g FROM words),
twice AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
covered AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS gone FROM windows JOIN twice USING (g) GROUP BY doc_id),
cut AS (SELECT words.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS kept FROM words LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM cut"""

#: Ten rounds of assignment and floored means, one after another.
_ROUNDS = "".join(f"""
a{r} AS MATERIALIZED (SELECT vec_id, v, min({{'d': d, 'k': k}}) AS best FROM (SELECT vec_id, n, kept.v, k, list_sum(list_transform(range(1, 65), lambda i: (kept.v[i] - c{r}.v[i]) * (kept.v[i] - c{r}.v[i])))::BIGINT AS d FROM kept, c{r}) GROUP BY vec_id, n, v),
m{r} AS (SELECT k, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS v FROM (SELECT best.k AS k, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) AS dims(i) GROUP BY 1, 2) GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (k)),""" for r in range(10))
_CENTROID_SQL = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, v FROM kept ORDER BY sha256('3:' || vec_id) LIMIT 8),{_ROUNDS}
last AS MATERIALIZED (SELECT vec_id, min({{'d': d, 'k': k}}) AS best FROM (SELECT vec_id, n, k, list_sum(list_transform(range(1, 65), lambda i: (kept.v[i] - c10.v[i]) * (kept.v[i] - c10.v[i])))::BIGINT AS d FROM kept, c10) GROUP BY vec_id, n)
SELECT vec_id, best.k::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c10.v, ',')) AS centroid_sha256
FROM last JOIN c10 ON c10.k = best.k"""

#: Tokens, two cuts and a form from the id's hash, and the text put together anew.
_FIM_SQL = """
WITH words AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w FROM documents),
hashed AS (SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM words),
cut AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(w[1:least(x, y)], '') AS p, array_to_string(w[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(w[greatest(x, y) + 1:], '') AS s FROM hashed),
made AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(o) AS output_sha256, sha256(t) AS restored_sha256 FROM made"""

ORACLE_SQL: dict[str, str] = {
    "op7_vectors": _VECTOR_SQL,
    "op12_centroids": _CENTROID_SQL,
    "op13_fim": _FIM_SQL,
    "op8_phrases": _REPEAT_SQL,
    "op1_minhash": _NEAR_SQL,
    "op6_url_rules": f"""
WITH rules(verdict, rule, rhost, rpath) AS (VALUES {_RULE_ROWS}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM cut JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM cut LEFT JOIN hit USING (page_id)""",
}
