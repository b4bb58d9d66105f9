"""MinHash near-duplicates by an LSH forest.

Each of ``TREES`` trees sorts all distinct shingle sets by a label: the signature from the tree's own position on. Sets
that share the tree's first ``DEPTH`` minima form a region, contiguous in that order. A region of more than ``LEAF`` sets
is followed to the depth at which its parts are small, each part as deep as it needs; all promising pairs of a part, and
each set with those next to it, which have the longest common prefix with it, are candidates. They are confirmed on full
shingle sets, and links are contracted to components. In regions that had to be split, every promising pair of sets that
are still in different components is confirmed as well, block against block, so depth decides about order, not results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.llm import text as T
from chronofact.llm.components import connected_components, spanning_stars
from chronofact.llm.storage import stash, tidy, tune

#: Values of a signature; trees; minima that a region shares at least. A pair of similarity 0.75 shares a region of
#: some tree with probability 1 - (1 - 0.75**3)**21 > 0.99998.
VALUES, TREES, DEPTH = 64, 21, 3
#: Signature values that a candidate pair must share; a pair of similarity 0.75 has fewer about once in a million.
AGREE = 32
#: Sets of a part of a region, all pairs of which are looked at; places in the order up to which sets are neighbours.
LEAF, NEAR = 32, 3
#: Sets of a block, of which two are compared at a time; rows of one region that a worker holds while it streams.
BLOCK, HELD = 1024, 8192

_U = np.uint64
_random = np.random.default_rng(7)
_FLIP = _random.integers(0, 2**32, VALUES, dtype=np.uint64).astype(np.uint32)
_TIMES = _random.integers(0, 2**31, VALUES, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text one after another (repeats included) and their number by text."""
    hashes, _, _, at = T.words(data, offsets, lower=True)
    count = np.diff(at)
    runs, full = T.rolling(hashes, k), count >= k
    number = np.where(full, count - k + 1, (count > 0).astype(np.int64))
    out = np.empty(int(number.sum()), np.uint64)
    begin = np.cumsum(number) - number
    out[T.spread(begin[full], number[full])] = runs[T.spread(at[:-1][full], number[full])]
    for i in np.flatnonzero(~full & (count > 0)):
        out[begin[i]] = T.rolling(hashes[at[i] : at[i + 1]], int(count[i]))[0] + _U(count[i])
    return out, number


def _base(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch, "text"):
                yield _signed(part, k)

    return run


def _signed(part: pa.RecordBatch, k: int) -> pa.RecordBatch:
    hashes, number = shingles(*T.buffers(part.column(1)), k)
    size, one, two = np.zeros(len(number), np.int64), np.zeros(len(number), np.uint64), np.zeros(len(number), np.uint64)
    begin = np.cumsum(number) - number
    for i in np.flatnonzero(number):
        own = np.unique(hashes[begin[i] : begin[i] + number[i]])
        size[i], one[i], two[i] = len(own), own.sum(), T.mix(own).sum()
    some = np.flatnonzero(number)
    least = np.full((len(number), VALUES), 0xFFFFFFFF, np.uint32)
    if len(some):
        low = (hashes >> _U(32)).astype(np.uint32)
        for j in range(VALUES):
            least[some, j] = np.minimum.reduceat((low ^ _FLIP[j]) * _TIMES[j], begin[some])
    wide = T.mix(least.astype(np.uint64) + _U(1))
    keys = np.zeros((len(number), TREES), np.uint64)
    for t in range(TREES):
        for d in range(DEPTH):
            keys[:, t] = T.mix(keys[:, t] * _U(31) + wide[:, t * DEPTH + d] + _U(t))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(number) + 1, dtype=np.int32) * TREES), pa.array(keys.view(np.int64).ravel()))
    return pa.RecordBatch.from_arrays(
        [part.column(0), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists, T.binaries((wide >> _U(56)).astype(np.uint8).ravel(), np.full(len(number), VALUES))],
        names=["id", "n", "s1", "s2", "keys", "signature"],
    )


def _parts(labels: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """First rows of the parts of sorted rows: each region's subtrees at the least depth at which they have LEAF sets or
    fewer. ``begin`` marks the regions' first rows; equal labels stay together."""
    differ = labels[1:] != labels[:-1]
    shared = np.concatenate([[-1], np.where(differ.any(1), differ.argmax(1), VALUES)])
    cut = begin.copy()
    for depth in range(DEPTH, VALUES + 1):
        first = np.flatnonzero(cut)
        size = np.diff(np.append(first, len(labels)))
        deeper = np.repeat(size > LEAF, size) & ~cut & (shared < depth)
        cut |= deeper
        if not (size > LEAF).any():
            break
    return cut


def _candidates(keys: np.ndarray, labels: np.ndarray, n: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of regions and the keys of those of which not all pairs are seen; rows are sorted by key and label."""
    none = np.zeros(0, np.int64)
    if not len(keys):
        return none, none, none
    begin = np.concatenate([[True], keys[1:] != keys[:-1]])
    part, region = np.cumsum(_parts(labels, begin)), np.cumsum(begin)
    left, right = [none], [none]
    for step in range(1, LEAF):
        i = np.flatnonzero(part[step:] == part[:-step]) if step > NEAR else np.flatnonzero(region[step:] == region[:-step])
        if not len(i):
            break
        j = i + step
        fits = 100 * np.minimum(n[i], n[j]) >= 75 * np.maximum(n[i], n[j])
        i, j = i[fits], j[fits]
        alike = (labels[i] == labels[j]).sum(1) >= AGREE
        left.append(i[alike])
        right.append(j[alike])
    i, j = np.concatenate(left), np.concatenate(right)
    a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
    pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
    return pairs[:, 0], pairs[:, 1], keys[begin][np.bincount(region)[1:] > LEAF]


def _found(a: np.ndarray, b: np.ndarray, left: np.ndarray) -> pa.RecordBatch:
    """Rows of pairs, then a row for each key of a region with pairs left."""
    none, no = pa.nulls(len(left), pa.int64()), pa.nulls(len(a), pa.int64())
    columns = [(pa.array(a), none), (pa.array(b), none), (no, pa.array(left))]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in columns], names=["a", "b", "key"])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams a sorted partition; holds one batch and at most HELD rows of the region that goes on after it.

    The partition's first and last region may go on in other partitions, so they count as having pairs left.
    """
    held, edges = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        labels, _ = T.buffers(batch.column(1))
        now = [batch.column(0).to_numpy(), labels.reshape(-1, VALUES), batch.column(2).to_numpy(), batch.column(3).to_numpy()]
        edges = [edges[0] if edges else now[0][0], now[0][-1]]
        if held:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if len(now[0]) - cut > HELD:  # the region has pairs left anyway
            cut = len(now[0]) - NEAR
            yield _found(*_candidates(*now))
        else:
            yield _found(*_candidates(*(x[:cut] for x in now)))
        held = [x[cut:] for x in now]
    if held:
        a, b, left = _candidates(*held)
        yield _found(a, b, np.concatenate([left, edges]))


def _across(k: int, percent: int, confirm: bool):
    """Compares the sets of each group: those of one side with those of the other, or all where there is one side only.

    A pair is looked at if it is promising, its components differ, and the group's region is the first that both share.
    Without ``confirm``: the rows that have such a pair; with it, and texts in the last column: links between components.
    Rows are sorted by group; holds one batch and one group, which is at most two blocks.
    """
    names = ["a", "b"] if confirm else ["group", "key", "side", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in T.pieces(batch, "text") if confirm else [batch]:
                if not part.num_rows:
                    continue
                now = [part.column(c).to_numpy() for c in range(6)]
                now += [part.column(6).flatten().to_numpy().reshape(-1, TREES), T.buffers(part.column(7))[0].reshape(-1, VALUES)]
                if confirm:
                    hashes, number = shingles(*T.buffers(part.column(8)), k)
                    own = np.empty(len(number), object)
                    own[:] = [np.unique(hashes[e - c : e]) for e, c in zip(np.cumsum(number), number, strict=True)]
                    now.append(own)
                if held:
                    now = [np.concatenate(x) for x in zip(held, now, strict=True)]
                cut = np.flatnonzero(now[0][1:] != now[0][:-1]) + 1
                out = [_group([x[lo:hi] for x in now], percent) for lo, hi in zip([0, *cut[:-1]], cut, strict=False)]
                held = [x[cut[-1] :] for x in now] if len(cut) else now
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _group(held, percent)], names=names)

    return run


def _group(rows: list[np.ndarray], percent: int) -> tuple[np.ndarray, ...]:
    group, key, side, ids, roots, n, keys, labels, *own = rows
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    roots, used, left, right = roots.copy(), np.zeros(len(ids), bool), [], []
    for i in one:
        other = two if len(two) else one[one > i]
        other = other[(roots[other] != roots[i]) & (100 * np.minimum(n[other], n[i]) >= 75 * np.maximum(n[other], n[i]))]
        other = other[(labels[other] == labels[i]).sum(1) >= AGREE]
        other = other[keys[i][(keys[other] == keys[i]).argmax(1)] == key[i]]
        if not len(other):
            continue
        if not own:
            used[i] = used[other] = True
            continue
        x, size = own[0][i], np.array([len(own[0][j]) for j in other])
        y = np.concatenate(own[0][other])
        same = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
        both = np.add.reduceat(same.astype(np.int64), np.cumsum(size) - size)
        other = other[(both > 0) & (100 * both >= percent * (len(x) + size - both))]
        if len(other):
            found, first = np.unique(roots[other], return_index=True)
            left.append(np.full(len(first), ids[i]))
            right.append(ids[other[first]])
            roots[np.isin(roots, found)] = roots[i]
    if own:
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    return group[used], key[used], side[used].astype(np.int64), ids[used]


def _remaining(source: DataFrame, sets: DataFrame, roots: DataFrame, keys: DataFrame, k: int, percent: int) -> DataFrame:
    """Stars ``a, b`` of the links among all promising pairs of different components in the regions with these keys.

    Components of more than BLOCK sets of a region are cut into blocks that are not compared with each other; the rest
    of the region is cut into blocks too, and every two of all these blocks, and each of the rest alone, are a group.
    Long texts count as several sets. Texts go to groups, not to pairs, and only those that have a pair there.
    """
    regions = sets.select("id", "n", F.explode("keys").alias("key")).join(keys, "key")
    regions = regions.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    regions = stash(regions, "regions")
    parts = regions.groupBy("key", "root").agg(F.expr("sum(greatest(1, n / 1024))").alias("size"))
    rest = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum(F.when(F.col("size") <= BLOCK, F.col("size"))).alias("rest")).where("parts > 1")
    parts = parts.join(rest, "key").withColumn("own", F.expr(f"if(size > {BLOCK}, root, null)"))
    rows = regions.join(parts, ["key", "root"]).withColumn("block", F.expr(f"pmod(xxhash64(id), ceil(if(own is null, rest, size) / {BLOCK}))"))
    rows = stash(rows.select("key", "id", "root", "own", F.concat_ws(":", "own", "block").alias("block")), "blocks")
    blocks = rows.select("key", "own", "block").distinct()
    one, two = (blocks.select("key", F.col("own").alias(f"own_{c}"), F.col("block").alias(c)) for c in ("one", "two"))
    groups = one.join(two, "key").where("one <= two and coalesce(own_one <> own_two, true)")
    sides = F.when(F.col("one") == F.col("two"), F.array("one")).otherwise(F.array("one", "two"))
    dealt = groups.select("key", F.xxhash64("key", "one", "two").alias("group"), F.posexplode(sides).alias("side", "block")).join(rows, ["key", "block"])
    heads = sets.select("id", "n", "keys", "signature").join(rows.select("id", "root").distinct(), "id")
    columns = ["group", "key", "side", "id", "root", "n", "keys", "signature"]
    dealt = dealt.select("group", "key", F.col("side").cast("long"), "id").join(heads, "id").select(*columns)
    paired = dealt.repartition("group").sortWithinPartitions("group").mapInArrow(tidy(_across(k, percent, False)), "group long, key long, side long, id long")
    paired = stash(paired, "paired")
    texts = stash(source.join(paired.select("id").distinct().hint("merge"), "id", "left_semi"), "paired-texts")
    full = paired.join(heads, "id").join(texts.hint("merge"), "id").select(*columns, "text")
    return full.repartition("group").sortWithinPartitions("group").mapInArrow(tidy(_stars_of(_across(k, percent, True))), "a long, b long")


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch, "left"):
                sides, keep = [shingles(*T.buffers(part.column(c)), k) for c in (2, 3)], []
                ends = [np.cumsum(number) for _, number in sides]
                for i in range(part.num_rows):
                    x, y = (np.unique(h[e[i] - c[i] : e[i]]) for (h, c), e in zip(sides, ends, strict=True))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _stars_of(links):
    """A task's links, contracted where they are found."""
    return lambda batches: spanning_stars(links(batches))


def _links(source: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Stars of the pairs that full shingle sets confirm."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = stash(source.join(ends.hint("merge"), "id", "left_semi"), "candidate-texts")
    sided = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")).hint("merge"), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")).hint("merge"), "b")
    return sided.select("a", "b", "left", "right").mapInArrow(tidy(_stars_of(_confirm(k, percent))), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Texts are linked if their sets of distinct k-word shingles (A-Z lower-cased; a text of fewer words is one shingle)
    have a Jaccard similarity of ``percent`` / 100 or more. ``component_id``: smallest id that links reach; ``kept``:
    it is the row's own. Null and wordless texts and rows without an id are linked with nothing; the latter have a
    null component and are kept. Ids should be unique: repeated rows stay, each with its own text's component. Equal
    sets are one node, so copies are never paired with each other. Other columns are not carried.
    """
    tune(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    base = stash(source.mapInArrow(tidy(_base(k)), "id long, n long, s1 long, s2 long, keys array<long>, signature binary"), "signatures")
    linkable = base.where("n > 0 and id is not null")
    sets = linkable.groupBy("s1", "s2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("signature").alias("signature"), F.count("*").alias("copies"))
    sets = stash(sets, "sets")
    labels = sets.select(F.posexplode("keys").alias("t", "key"), "signature", "n", "id").select("key", F.expr(f"concat(substring(signature, {DEPTH} * t + 1, {VALUES}), substring(signature, 1, {DEPTH} * t))").alias("label"), "n", "id")
    ordered = labels.repartitionByRange("key", "label").sortWithinPartitions("key", "label", "id")
    found = stash(ordered.mapInArrow(tidy(_regions), "a long, b long, key long").distinct(), "candidates")
    pairs, keys = found.where("a is not null").select("a", "b"), found.where("a is null").select("key")
    roots = connected_components(_links(source, pairs, k, percent), contracted=True)
    more = _remaining(source, sets, roots, keys, k, percent)
    roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), contracted=True)
    moved = sets.select("s1", "s2", "id", "copies").join(roots.withColumnRenamed("node", "id"), "id", "left").where("copies > 1 or root is not null").select("s1", "s2", F.coalesce("root", "id").alias("root"))
    rows = base.select("id", "n", "s1", "s2").withColumn("linkable", F.expr("n > 0 and id is not null")).join(moved.withColumn("linkable", F.lit(True)), ["linkable", "s1", "s2"], "left")
    component = F.coalesce("root", "id")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
