"""Language identification by interpolated Kneser-Ney character models.

For each language, character n-grams are counted in Spark over a bounded sample of its texts. The models stand side by
side in sorted hash arrays: an n-gram of any language has one place and a log-probability by language; what a language
hasn't seen there is filled from its shorter n-grams. The language of the least cross-entropy per character wins. A
text is rejected if it is nearer to random letters than to the calibration texts of that language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from chronofact.llm import text as T
from chronofact.llm.storage import give_back, tidy, tune

#: Bounds of the sample of labelled texts for each language: about so many texts and bytes, chosen by a hash of id and
#: text. What they hold comes to the driver and is broadcast.
TRAIN_ROWS, TRAIN_BYTES = 400, 4 * 2**20
#: Characters of an n-gram; a part of the sample in which cross-entropies are calibrated, as one in so many.
ORDER, CALIBRATION = 5, 5
#: A text of n characters may be worse than the limit by so many bits, divided by the root of n.
SLACK = 4.0
#: Characters scored at once.
CHUNK = 1 << 18
_U = np.uint64
_START = 0x110000  # stands before a text


def _points(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with every run of what is no letter as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(points, 0x10FFFF)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, points, np.uint32(32))[keep]


_letter_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _letter_table:
        import sys

        _letter_table.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letter_table[0]


def gram_hashes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length 1 ... order: the hash of the n-gram that ends at each character, with start marks before it."""
    n = len(points)
    padded = np.concatenate([np.full(order - 1, _START, np.uint64), points.astype(np.uint64)])
    out, h = [], np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(order):
            # from the last character back, so that a suffix's hash is the state before one more character
            h = T.mix(h * _U(0x9E3779B97F4A7C15) + padded[order - 1 - k : order - 1 - k + n] + _U(1))
            out.append(h)
    return out


@dataclass
class Models:
    """By length of the n-gram: sorted hashes, and the log2-probability of its last character by language. By length
    of the context: sorted hashes, and log2 of the weight that it leaves to shorter n-grams (0 where it isn't seen)."""

    languages: list[str]
    order: int
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    rests: list[np.ndarray]
    #: By language: log2-probability of a character that no language has seen, and from which cross-entropy on a text
    #: is rejected: half way from the calibration texts' ninth decile to random letters (infinite without such texts).
    unseen: np.ndarray
    limit: np.ndarray
    #: By language: distinct characters.
    letters: np.ndarray

    def __post_init__(self) -> None:
        self.tables = {name: [_leading(k) for k in arrays] for name, arrays in (("keys", self.keys), ("contexts", self.contexts))}

    def find(self, name: str, level: int, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes in a sorted array, -1 where they are not; a table of leading bits narrows the search."""
        keys, (shift, begin) = getattr(self, name)[level], self.tables[name][level]
        top = (hashes >> shift).astype(np.int64)
        place, end = begin[top], begin[top + 1]
        out, open_ = np.full(len(hashes), -1, np.int64), np.flatnonzero(place < end)
        while len(open_):
            here = keys[place[open_]]
            hit = here == hashes[open_]
            out[open_[hit]] = place[open_[hit]]
            open_ = open_[here < hashes[open_]]
            place[open_] += 1
            open_ = open_[place[open_] < end[open_]]
        return out

    def entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character by language, and the number of characters (0: no letter), of each text. Each text starts
        anew behind start marks; what stands beside it makes no difference."""
        points = [_points(x) if x else np.zeros(0, np.uint32) for x in texts]
        size = np.array([len(p) if (p != 32).any() else 0 for p in points], np.int64)
        bits = np.zeros((len(texts), len(self.languages)))
        for i in np.flatnonzero(size > CHUNK):
            for lo in range(0, size[i], CHUNK):
                before = points[i][max(0, lo - self.order + 1) : lo]
                own = np.concatenate([before, points[i][lo : lo + CHUNK]])
                bits[i] += self._bits(own)[len(before) :].sum(0, dtype=np.float64)
        short = np.flatnonzero((size > 0) & (size <= CHUNK))
        if len(short):
            mark = np.full(self.order - 1, _START, np.uint32)
            each = self._bits(np.concatenate([x for i in short for x in (mark, points[i])])).astype(np.float64)
            ends = np.cumsum(size[short] + self.order - 1)
            edges = np.stack([ends - size[short], ends], 1).ravel()
            bits[short] = np.add.reduceat(np.vstack([each, np.zeros((1, bits.shape[1]))]), edges, axis=0)[::2]
        return bits / np.maximum(size, 1)[:, None], size

    def _bits(self, points: np.ndarray) -> np.ndarray:
        grams = gram_hashes(points, self.order)
        out = np.zeros((len(points), len(self.languages)), np.float32)
        open_ = np.arange(len(points))
        for level in range(self.order - 1, -1, -1):
            place = self.find("keys", level, grams[level][open_])
            hit = place >= 0
            out[open_[hit]] += self.logs[level][place[hit]]
            open_ = open_[~hit]
            if level and len(open_):
                before = np.where(open_ > 0, grams[level - 1][open_ - 1], _marks(level))
                place = self.find("contexts", level, before)
                seen = place >= 0
                out[open_[seen]] += self.rests[level][place[seen]]
        out[open_] += self.unseen
        return -out


def _leading(keys: np.ndarray) -> tuple[np.uint64, np.ndarray]:
    bits = max(1, int(len(keys)).bit_length())
    return _U(64 - bits), np.searchsorted(keys >> _U(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _discounts(counts: np.ndarray) -> float:
    one, two = (counts == 1).sum(), (counts == 2).sum()
    return float(one / (one + 2 * two)) if one and two else 0.5


def _model(grams: dict[str, np.ndarray], order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of one language, by length: sorted n-gram hashes, their interpolated probabilities, and sorted context hashes
    with the weight that they leave to shorter n-grams.

    ``grams``: distinct longest n-grams, ``h<k>`` the hash of the suffix of length k, ``c<k>`` that of an n-gram's
    context of length k (its k characters before the last), ``n`` their counts. Shorter n-grams are counted by the
    number of distinct characters that stand before them.
    """
    levels, lower = [], None
    for k in range(1, order + 1):
        if k == order:
            hashes, context, count, below = grams[f"h{k}"], grams[f"c{k - 1}"], grams["n"].astype(float), grams[f"h{k - 1}"] if k > 1 else None
        else:
            _, first = np.unique(grams[f"h{k + 1}"], return_index=True)
            hashes, at, count = np.unique(grams[f"h{k}"][first], return_index=True, return_counts=True)
            context, count, below = grams[f"c{k - 1}"][first][at], count.astype(float), grams[f"h{k - 1}"][first][at] if k > 1 else None
        d = _discounts(count)
        contexts, of = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(of, count), np.bincount(of)
        rest = d * kinds / total
        if k == 1:
            base = np.full(len(hashes), 1 / (len(hashes) + 1))
        else:
            base = lower[1][np.searchsorted(lower[0], below)]
        p = np.maximum(count - d, 0) / total[of] + rest[of] * base
        order_of = np.argsort(hashes)
        levels.append((hashes[order_of], p[order_of], contexts, rest))
        lower = levels[-1]
    return levels


def _fill(own: list, level: int, suffixes: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
    """Probabilities in one language of n-grams of length level + 1, seen in it or not."""
    vocabulary = len(own[0][0]) + 1
    p = np.full(len(suffixes[0]), own[0][3][0] / vocabulary)
    for k in range(level + 1):
        hashes, probability, context, rest = own[k]
        if k:
            at = np.minimum(np.searchsorted(context, contexts[k]), len(context) - 1)
            p = np.where(context[at] == contexts[k], rest[at], 1.0) * p
        at = np.minimum(np.searchsorted(hashes, suffixes[k]), len(hashes) - 1)
        p = np.where(hashes[at] == suffixes[k], probability[at], p)
    return p


def _build(columns: dict[str, np.ndarray], of: np.ndarray, languages: list[str], order: int) -> Models:
    """Models of those languages that have any n-gram; rows of one n-gram count together."""
    grams = {}
    for lang in languages:
        mine = np.flatnonzero(of == lang)
        if len(mine):
            _, first, which = np.unique(columns[f"h{order}"][mine], return_index=True, return_inverse=True)
            grams[lang] = {c: v[mine[first]] for c, v in columns.items()} | {"n": np.bincount(which, columns["n"][mine])}
    languages = list(grams)
    own = {lang: _model(grams[lang], order) for lang in languages}
    every = {c: np.concatenate([g[c] for g in grams.values()]) if grams else v[:0] for c, v in columns.items()}
    all_keys, logs, all_contexts, rests = [], [], [], []
    for k in range(order):
        seen = np.unique(every[f"c{k}"])
        rest = np.zeros((len(seen), len(languages)), np.float32)
        for i, x in enumerate(languages):
            rest[np.searchsorted(seen, own[x][k][2]), i] = np.log2(own[x][k][3])
        all_contexts.append(seen)
        rests.append(rest)
        hashes, first = np.unique(every[f"h{k + 1}"], return_index=True)
        suffixes, contexts = [every[f"h{j + 1}"][first] for j in range(k + 1)], [every[f"c{j}"][first] for j in range(k + 1)]
        all_keys.append(hashes)
        logs.append(np.log2(np.stack([_fill(own[x], k, suffixes, contexts) for x in languages], 1)).astype(np.float32) if languages else np.zeros((0, 0), np.float32))
    unseen = np.array([np.log2(own[x][0][3][0] / (len(own[x][0][0]) + 1)) for x in languages], np.float32)
    return Models(languages, order, all_keys, logs, all_contexts, rests, unseen, np.full(len(languages), np.inf), np.array([len(own[x][0][0]) for x in languages]))


def train(labelled: DataFrame, order: int = ORDER, train_rows: int = TRAIN_ROWS, hash_col: str = "__hash", train_bytes: int = TRAIN_BYTES) -> Models | None:
    """Fits the models on ``(lang, text, __hash)``; rows with a null language or text are not learned from. None
    without any usable row.

    Of each language about ``train_rows`` texts and ``train_bytes`` bytes are used, those of the least hash. One text in
    ``CALIBRATION`` sets the limit of cross-entropies instead of being counted; of a language with few texts all are
    counted, and each part of them is measured by a model of the other parts. A language with one text has no limit.
    """
    tune(labelled.sparkSession)
    labelled = labelled.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    stats = {r["lang"]: r for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    if not stats:
        return None
    languages, spread = sorted(stats), 1_000_000
    rate = {x: min(1.0, train_rows / stats[x]["n"], train_bytes / stats[x]["bytes"]) for x in languages}
    few = [x for x in languages if stats[x]["n"] * rate[x] < 4 * CALIBRATION]
    limits = F.create_map(*(x for lang in languages for x in (F.lit(lang), F.lit(int(np.ceil(spread * rate[lang]))))))
    sample = labelled.where(F.pmod(F.xxhash64(hash_col), F.lit(spread)) < limits[F.col("lang")]).withColumn("fold", F.pmod(F.xxhash64(F.lit(1), hash_col), F.lit(CALIBRATION)))
    names = [f"h{k + 1}" for k in range(order)]
    learned = sample.withColumn("part", F.when(F.col("lang").isin(few), F.col("fold")).when(F.col("fold") > 0, -1)).where("part is not null")
    keys = ["lang", "part", *names, *(f"c{k}" for k in range(order))]
    grams = learned.select("lang", "part", "text").mapInArrow(tidy(_grams(order)), f"lang string, {', '.join(f'{c} long' for c in keys[1:])}, n long")
    table = grams.groupBy(*keys).agg(F.sum("n").alias("n")).toArrow()
    of = table.column("lang").combine_chunks().to_numpy(zero_copy_only=False)
    part = table.column("part").to_numpy()
    columns = {c: table.column(c).to_numpy() if c == "n" else table.column(c).to_numpy().view(np.uint64) for c in [*keys[2:], "n"]}
    models = _build(columns, of, languages, order)
    others = [_build({c: v[part != f] for c, v in columns.items()}, of[part != f], few, order) if few else None for f in range(CALIBRATION)]
    shared = labelled.sparkSession.sparkContext.broadcast((models, others))  # its size is bounded by the sample

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        main, apart = shared.value
        for batch in batches:
            bits = []
            for lang, fold, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by = apart[fold] if lang in few else main
                bits.append(float(by.entropy([text])[0][0, by.languages.index(lang)]) if lang in by.languages else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.float64())], names=["lang", "bits"])

    seen = sample.where(F.col("lang").isin(few) | (F.col("fold") == 0)).select("lang", "fold", "text").mapInArrow(tidy(measured), "lang string, bits double")
    for r in seen.where("bits is not null").groupBy("lang").agg(F.percentile_approx("bits", 0.9).alias("bits")).collect():
        if r["lang"] in models.languages:
            i = models.languages.index(r["lang"])
            models.limit[i] = (r["bits"] + np.log2(models.letters[i])) / 2
    return models


def _grams(order: int):
    """Longest n-grams of each text with the hashes of their suffixes and contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grams = gram_hashes(_points(text), order)
                # the context of length k ends one character earlier; of the first character it is all start marks
                before = [np.concatenate([[_marks(k)], g[:-1]]) for k, g in enumerate(grams[:-1], 1)]
                _, first, n = np.unique(grams[-1], return_index=True, return_counts=True)
                contexts = [np.zeros(len(first), np.uint64), *(c[first] for c in before)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), part)), *(pa.array(g[first].view(np.int64)) for g in grams), *(pa.array(c.view(np.int64)) for c in contexts), pa.array(n)], names=["lang", "part", *(f"h{k + 1}" for k in range(order)), *(f"c{k}" for k in range(order)), "n"])

    return run


def _marks(k: int) -> np.uint64:
    return gram_hashes(np.array([_START], np.uint32), k)[-1][0]


def identify(docs: DataFrame, labelled: DataFrame, text_col: str = "text", columns: list[str] | None = None, order: int = ORDER, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``columns`` (by default ``doc_id``), ``lang_pred``, ``score``, ``bits`` and ``rejected`` for each row of ``docs``.

    ``labelled``: ``lang``, ``text`` and ``__hash`` (what the sample is drawn by). Whole texts are read; nothing but
    the text is an input of a prediction. ``lang_pred`` is ``und``, the score 0 and the row rejected if the text is
    null or has no letter, or if there was nothing to learn from. The score is the language's share of the likelihood
    of up to 40 characters at the text's rate. ``rejected``: nearer to random letters than to its language's texts.
    """
    tune(docs.sparkSession)
    models = train(labelled, order, train_rows)
    give_back()
    shared = docs.sparkSession.sparkContext.broadcast(models)  # its size is bounded by the sample
    columns = columns or ["doc_id"]
    names = [*columns, "lang_pred", "score", "bits", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch, column, 1 << 19):
                yield _judged(part, shared.value, len(columns), column, names)

    rows, column = T.carried(docs, columns, text_col)
    schema = t.StructType([*rows.select(*columns).schema.fields, t.StructField("lang_pred", t.StringType()), t.StructField("score", t.DoubleType()), t.StructField("bits", t.DoubleType()), t.StructField("rejected", t.BooleanType())])
    return rows.mapInArrow(tidy(run), schema)


def _judged(part: pa.RecordBatch, models: Models | None, carried: int, column: int, names: list[str]) -> pa.RecordBatch:
    texts = [x.decode(errors="replace") if isinstance(x, bytes) else x for x in part.column(column).to_pylist()]
    if models is None:
        out = [["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts)]
    else:
        bits, size = models.entropy(texts)
        best = bits.argmin(1)
        least = bits[np.arange(len(texts)), best]
        score = 1 / np.exp2(np.minimum(size, 40)[:, None] * (least[:, None] - bits)).sum(1)
        odd = least > models.limit[best] + SLACK / np.sqrt(np.maximum(size, 1))
        known = size > 0
        out = [[models.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, np.clip(score, 0, 1), 0.0), [float(x) if k else None for x, k in zip(least, known, strict=True)], ~known | odd]
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([*part.columns[:carried], *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names=names)


def learnable(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[Column, DataFrame]:
    """Whether a row is held out (crc32 of its id as text, modulo 4, is 2), and the rows to learn from."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return held, docs.where(~held).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("__hash"))
