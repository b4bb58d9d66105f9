"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another; each later model also sees the earlier categories' probabilities, and is
trained on out-of-fold ones, so that it learns how good they are and not how well the earlier model knows its own rows.
A fold's own labels have no part in its probabilities, not even in the choice of features. Features are words and word beginnings that go with a label, by presence and by density, and a few shares of character
classes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofact.llm import text as T
from chronofact.llm.storage import give_back, stash, tidy, tune

#: Bound of the sample of labelled rows that the models are fitted on: about so many, chosen by a hash of their id. Of
#: each the driver gets at most the chosen features (SELECTED for each category and fold), 8 bytes each.
TRAIN_ROWS = 6000
#: Bits of a feature's number; bytes of word beginnings; folds; steps and weight decay of a fit.
BITS, PREFIXES, FOLDS, STEPS, DECAY = 20, (4, 5, 6, 7, 8), 5, 200, 1e-3
#: A model keeps at most so many features, of those whose chi-squared statistic against the label is so great.
SELECTED, SURE = 500, 40.0
#: Shares of character classes, after which come the earlier categories' probabilities.
_DENSE = 4
#: Densities count up to so many percent of a text's words.
DENSEST = 5.0
#: Bytes of text that are hashed at once; each word has a hash for itself and for each of its beginnings.
PIECE = 1 << 19

_APART = np.ones(256, bool)
_APART[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of each word (a row), words before each text (n + 1), and each text's shares."""
    hashes, _, _, at = T.words(data, offsets, True, _APART, PREFIXES)
    numbers = (T.mix(hashes + np.arange(1 + len(PREFIXES), dtype=np.uint64)) >> np.uint64(64 - BITS)).astype(np.int32)
    size = np.maximum(np.diff(offsets), 1)

    def share(of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    dense = np.stack([share(upper), share(digit), share(_APART[data] & ~digit), np.log1p(np.diff(at)) / 10], 1)
    return numbers, at, dense


def _features_of(part: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: its row, distinct features, their densities in percent, and the shares."""
    numbers, at, dense = features(*T.buffers(part.column(0)))
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        own, n = np.unique(numbers[a:b], return_counts=True)
        yield i, own, 100 * n / max(1, b - a), dense[i]


def _fold(own: np.ndarray) -> tuple[int, int]:
    """A mark of a text by all its features, and its fold: equal texts share one."""
    mark = zlib.crc32(own.tobytes())
    return mark, mark % FOLDS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(feature, fold, total, hits)``: in how many of a fold's texts a feature is, and in how many with each label."""
    for batch in batches:
        for part in T.pieces(batch, "text", PIECE):
            y = np.array(part.column(1).to_pylist(), np.int64)
            keys, text = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, own, _, _ in _features_of(part):
                keys.append(own.astype(np.int64) * FOLDS + _fold(own)[1])
                text.append(np.full(len(own), i))
            key, which = np.unique(np.concatenate(keys), return_inverse=True)
            of = y[np.concatenate(text)] if len(y) else np.zeros((0, 1), np.int64)
            hits = np.stack([np.bincount(which, of[:, k], len(key)) for k in range(of.shape[1])], 1).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * hits.shape[1]), pa.array(hits.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(key // FOLDS), pa.array(key % FOLDS), pa.array(np.bincount(which, minlength=len(key))), lists], names=["feature", "fold", "total", "hits"])


def _folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in T.pieces(batch, "text", PIECE):
            folds = [_fold(own)[1] for _, own, _, _ in _features_of(part)]
            yield pa.RecordBatch.from_arrays([pa.array(folds, pa.int64()), part.column(1)], names=["fold", "y"])


def _sampled(union: np.ndarray):
    """Of each training text: its labels, a hash of all its features, those in ``union`` with densities, and shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch, "text", PIECE):
                rows = []
                for _, own, values, dense in _features_of(part):
                    hit = np.isin(own, union, assume_unique=True)
                    rows.append((_fold(own)[0], own[hit].astype("<i4").tobytes(), values[hit].astype("<f4").tobytes(), dense))
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
                columns = zip(*rows, strict=True) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], names=["y", "mark", "own", "values", "dense"])

    return run


def fit_linear(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and intercept of a logistic regression, by full gradient steps with momentum and adaptive size."""
    if y.min() == y.max():
        return np.append(np.zeros(x.shape[1]), 8.0 if y[0] else -8.0)
    # a few columns at a time, as deviations are taken in double precision
    deviation = np.concatenate([x[:, k : k + 64].std(0, dtype=np.float64) for k in range(0, x.shape[1], 64)])
    scale = np.maximum(deviation, 0.05).astype(np.float32)
    x = np.divide(x, scale, dtype=np.float32, casting="same_kind")
    w, b = np.zeros(x.shape[1], np.float32), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g, gb = x.T @ (p - y).astype(np.float32) / len(y) + DECAY * w, float((p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.98 * vb + 0.02 * gb * gb
        rate, fix, fix2 = 0.05, 1 - 0.9**step, 1 - 0.98**step
        w -= rate * (m / fix) / (np.sqrt(v / fix2) + 1e-6)
        b -= rate * (mb / fix) / (np.sqrt(vb / fix2) + 1e-6)
    return np.append(w / scale, b)


def _sure(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """One category: its features' numbers, and weights of their presence, their density, the dense inputs, and 1."""

    chosen: np.ndarray
    weights: np.ndarray


@dataclass
class Chain:
    categories: list[str]
    models: list[Model]
    #: From this probability of the last category on, a text is rejected.
    threshold: float

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities: a row for each text, a column for each category; 0 for texts without letters."""
        numbers, at, dense = features(data, offsets)
        some = np.flatnonzero(np.diff(at) > 0)
        out = np.zeros((len(at) - 1, len(self.models)))
        for k, model in enumerate(self.models):
            m = len(model.chosen)
            place_of = np.full(1 << BITS, -1, np.int16)
            place_of[model.chosen] = np.arange(m)
            place = place_of[numbers]
            word, _ = hit = np.nonzero(place >= 0)
            text = np.searchsorted(at, word, "right") - 1
            pair, n = np.unique(text * max(1, m) + place[hit], return_counts=True)
            text, feature = pair // max(1, m), pair % max(1, m)
            dense_at = np.minimum(100 * n / np.diff(at)[text], DENSEST)
            z = np.bincount(text, model.weights[feature] + model.weights[m + feature] * dense_at, minlength=len(out)) if m else np.zeros(len(out))
            z = z + np.hstack([dense, out[:, :k]]) @ model.weights[2 * m : -1] + model.weights[-1]
            out[some, k] = _sure(z[some])
        return out


def _select(counts: DataFrame, sizes: dict[int, tuple[int, list[int]]], categories: int) -> dict[tuple[int, int], np.ndarray]:
    """For each category and fold (-1: none) the features whose presence tells most about the label in all other folds:
    those of 5 texts at least by chi-squared; SELECTED of each leave the executors.

    ``sizes``: of each fold its texts, and those with each label.
    """
    sums = [F.array(*(F.sum(F.when(F.col("fold") == f, value)) for f in range(FOLDS))) for value in [F.col("total"), *(F.col("hits")[k] for k in range(categories))]]
    wide = stash(counts.groupBy("feature").agg(*(s.alias(f"c{i}") for i, s in enumerate(sums))), "feature-counts")
    number = lambda column, out: sum((F.coalesce(F.col(column)[f], F.lit(0)) for f in range(FOLDS) if f != out), F.lit(0)).cast("double")
    gains = []
    for k in range(categories):
        for out in range(-1, FOLDS):
            a = sum(y[k] for f, (_, y) in sizes.items() if f != out)
            b = sum(n for f, (n, _) in sizes.items() if f != out) - a
            n, x = number("c0", out), number(f"c{k + 1}", out)
            gain = F.pow(x * (b - (n - x)) - (n - x) * (a - x), F.lit(2.0)) * float(a + b) / F.greatest(float(a) * float(b) * n * (a + b - n), F.lit(1.0))
            gains.append(F.when((n >= 5) & (gain >= SURE), F.struct(F.lit(k).alias("k"), F.lit(out).alias("out"), gain.alias("gain"))))
    sure = wide.select("feature", F.explode(F.array_compact(F.array(*gains))).alias("g")).select("feature", "g.*")
    place = F.row_number().over(W.partitionBy("k", "out").orderBy(F.col("gain").desc(), "feature"))
    found: dict[tuple[int, int], list[int]] = {}
    for r in sure.withColumn("place", place).where(F.col("place") <= SELECTED).select("k", "out", "feature").collect():
        found.setdefault((r["k"], r["out"]), []).append(r["feature"])
    return {(k, out): np.array(sorted(found.get((k, out), [])), np.int64) for k in range(categories) for out in range(-1, FOLDS)}


def _inputs(rows: list[np.ndarray], values: list[np.ndarray], dense: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Presence and density of the chosen features, and the dense inputs; in single precision, as the driver holds them."""
    m = len(chosen)
    x = np.zeros((len(rows), 2 * m + dense.shape[1]), np.float32)
    x[:, 2 * m :] = dense
    for i, (r, v) in enumerate(zip(rows, values, strict=True)):
        _, place, where = np.intersect1d(chosen, r, assume_unique=True, return_indices=True)
        x[i, place], x[i, m + place] = 1, np.minimum(v[where], DENSEST)
    return x


def train_chain(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Chain:
    """Fits the chain on about ``train_rows`` labelled texts, chosen by a hash of their id.

    ``labels``: an id and a 0/1 column for each category; rows with a null in any of them are not learned from, of
    repeated ids the greatest label and the least text count. Without labels, or of a category with one value only, the
    probability is that of the label (0 without any). The threshold gives the best F1 of out-of-fold predictions.
    """
    tune(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), *(F.col(c).cast("int").alias(c) for c in categories)).na.drop().groupBy("id").agg(*(F.max(c).alias(c) for c in categories))
    part = min(1.0, train_rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(part * 1_000_000))  # about train_rows rows
    y_of = F.array(*(F.col(c) for c in categories)).alias("y")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).where("text is not null").join(F.broadcast(sample), "id")
    texts = texts.groupBy("id", y_of).agg(F.min("text").alias("text"))  # a hot id is one text before it is shuffled
    texts = stash(texts.select("text", "y"), "labelled")
    counts = texts.mapInArrow(tidy(_counted), "feature long, fold long, total long, hits array<long>").groupBy("feature", "fold")
    counts = counts.agg(F.sum("total").alias("total"), F.array(*(F.sum(F.col("hits")[k]) for k in range(len(categories)))).alias("hits"))
    sizes: dict[int, tuple[int, list[int]]] = {}
    marked = texts.mapInArrow(tidy(_folds), "fold long, y array<int>").groupBy("fold").agg(F.count("*").alias("n"), F.array(*(F.sum(F.col("y")[k]) for k in range(len(categories)))).alias("y"))
    for r in marked.collect():
        sizes[r["fold"]] = (r["n"], r["y"])
    chosen_of = _select(counts, sizes, len(categories))
    union = np.unique(np.concatenate(list(chosen_of.values())))
    rows = texts.mapInArrow(tidy(_sampled(union)), "y array<int>, mark long, own binary, values binary, dense array<double>").collect()  # bounded by the sample
    rows = sorted(rows, key=lambda r: (r["mark"], r["dense"], r["y"]))  # whatever order they come in
    own, values = [np.frombuffer(r["own"], "<i4").astype(np.int64) for r in rows], [np.frombuffer(r["values"], "<f4") for r in rows]
    dense = np.array([r["dense"] for r in rows]).reshape(-1, _DENSE)
    fold = np.array([r["mark"] % FOLDS for r in rows], np.int64)
    models, threshold = [], 0.5
    for k in range(len(categories)):
        y = np.array([r["y"][k] for r in rows], np.float64)
        if not len(y) or y.min() == y.max():
            models.append(Model(np.zeros(0, np.int64), np.append(np.zeros(_DENSE + k), 8.0 if len(y) and y[0] else -8.0)))
            out = np.full(len(y), y[0] if len(y) else 0.0)
        else:
            given = lambda chosen: _inputs(own, values, dense, chosen)  # noqa: B023, E731
            models.append(Model(chosen_of[k, -1], fit_linear(given(chosen_of[k, -1]), y)))
            out = np.zeros(len(y))
            for f in range(FOLDS):
                test = fold == f
                if test.any() and not test.all():
                    x = given(chosen_of[k, f])
                    of_fold = fit_linear(x[~test], y[~test])
                    out[test] = _sure(x[test] @ of_fold[:-1] + of_fold[-1])
            order = np.argsort(-out, kind="stable")
            hits = np.cumsum(y[order])
            f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
            best = int(f1.argmax())
            after = out[order[best + 1]] if best + 1 < len(y) else 0.0
            threshold = float(np.clip((out[order[best]] + after) / 2, 0.2, 0.8))
        dense = np.hstack([dense, out[:, None]]) if len(y) else dense
    return Chain(categories, models, threshold)


def toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (by default the id), ``p_<category>`` for each category in the chain's order, ``score`` (that of the
    last), ``toxic`` and ``kept`` (not toxic) for each row.

    Whole texts are scored. Null texts and texts without letters have probability 0 and are kept. Repeated rows stay,
    ids may be null; input columns that are not asked for are not carried.
    """
    chain = train_chain(docs, labels, categories, id_col, text_col, train_rows)
    spark = docs.sparkSession
    give_back()
    model = spark.sparkContext.broadcast(chain)  # SELECTED features for each category at most
    columns = columns or [id_col]
    rows, column = T.carried(docs, columns, text_col)
    names = [*columns, *(f"p_{c}" for c in categories), "score", "toxic", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch, column, PIECE):
                p = model.value.predict(*T.buffers(part.column(column)))
                bad = p[:, -1] >= model.value.threshold
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *(pa.array(c) for c in p.T), pa.array(p[:, -1]), pa.array(bad), pa.array(~bad)], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema)
    return rows.mapInArrow(tidy(run), f"{kinds}, " + ", ".join(f"`{c}` double" for c in names[len(columns) : -2]) + ", toxic boolean, kept boolean")
