"""Near duplicates by n-gram Jaccard: a count-vector R-tree join.

A document is the set of its distinct word shingles; two link if the Jaccard similarity of
their sets reaches a threshold.  Equal sets are one class and one point from then on.

1. Routing.  In any fixed order of all shingles, two sets that link share one of the first
   few of each (so few that the rest could not reach the threshold).  The order is by hash, with
   shingles that are frequent within parts of the input last, so that common passages don't
   bring together what is otherwise unlike.  Classes that share such a shingle meet in a
   *bucket*; buckets of the same classes are one.
2. Count vectors.  The shingles of a set are hashed into groups, a power of two that grows
   with the set, so that a group holds a few; the counts are a point.  The sum of the
   coordinate minima of two points bounds their overlap.  A point with twice the groups is
   folded by adding its halves, and sets that link at 80 % differ by no more (at fewer, it is
   folded as often as their sizes allow).
3. R-tree.  The points of a bucket are packed into a tree by size and coordinates; nodes
   hold the coordinate maxima and the range of sizes, and a point descends only where the
   bound can reach the overlap that its size asks for.
4. Verification on the sets themselves, in two passes: first the best neighbour of each
   point, which joins most of each family; then all surviving pairs whose classes are not
   joined yet.  No family is expanded into all its pairs.
5. Crowds.  Buckets of more than ``cell`` classes that are mostly of the same classes are put
   together, since a large family shares many frequent shingles and would be compared once for
   each.  They are cut into cells by size and hash, and pairs of cells of possible sizes are
   joined, so no bucket need fit into a task.  The sets travel with the points: what the tree
   leaves is verified in the task, and only links that join something come out.
6. Connected components of the verified links, by alternating star contractions.

Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import held, lightened, quoted, released, sliced
from glossa.llm.suffix import Hashes, raw_texts
from glossa.session import cut_lineage

SIZE = 5
PERCENT = 80
GROUPS = 64
PER_GROUP = 4
FREQUENT = 64
HOT_LIMIT = 1_000_000
CELL = 256
#: Shingles of a cell of a crowd, and those that are compared at a time.
CELL_SHINGLES = 1_000_000
COLUMNS = 8_192
LEAF = 8
FANOUT = 8
RANGE_ROWS = 1_000_000
CHUNK_SHINGLES = 2_000_000
_U = np.uint64
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_STEP = _U(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _STEP
    x = (x ^ (x >> _U(29))) * _STEP
    return x ^ (x >> _U(32))


def shingle_sets(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``size`` are one shingle, no words none."""
    raw, borders = raw_texts(texts)
    if not len(raw):
        return [np.array([], _U)] * (len(borders) - 1)
    inside = _IN_WORD[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[borders] = True
    starts = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | first[:-1]))
    stops = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | first[1:])) + 1
    words = Hashes(_LOWER[raw]).of(starts, stops)
    rows = np.searchsorted(starts, borders)
    n = len(words)
    joined = np.zeros(max(0, n - size + 1), _U)
    for k in range(size):
        joined = _mixed(joined + words[k : n - size + 1 + k] * _U(2 * k + 1)) if len(joined) else joined
    out = []
    for low, high in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if high - low >= size:
            out.append(np.unique(joined[low : high - size + 1]))
        elif high > low:
            whole = np.array([high - low], _U)
            for k in range(low, high):
                whole = _mixed(whole + words[k : k + 1])
            out.append(whole)
        else:
            out.append(np.array([], _U))
    return out


def needed_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap of sets of sizes a and b with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def _prefix_size(n: int, percent: int) -> int:
    """Shingles that a set must show so that a partner shares one: its overlap is at least percent of its size."""
    return n - -(-percent * n // 100) + 1


def count_vector(shingles: np.ndarray) -> np.ndarray:
    groups = max(GROUPS, 1 << (len(shingles) // PER_GROUP).bit_length())
    return np.bincount((shingles >> _U(8)).astype(np.int64) & (groups - 1), minlength=groups)


def folded(vectors: np.ndarray, groups: int) -> np.ndarray:
    while vectors.shape[1] > groups:
        half = vectors.shape[1] // 2
        vectors = vectors[:, :half] + vectors[:, half:]
    return vectors


def _packed_vector(v: np.ndarray) -> bytes:
    """The counts in as few bytes as they need, behind one byte that tells how many."""
    kind = np.dtype(np.min_scalar_type(int(v.max(initial=0))))
    return bytes([kind.itemsize]) + v.astype(kind).tobytes()


def _vector(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.dtype(f"u{raw[0]}"), offset=1).astype(np.int32)


def frequent_shingles(keyed: DataFrame, size: int, frequent: int) -> np.ndarray:
    """Sorted shingles to be put last: counted over all rows where they occur twice within a part of the input.

    This order decides how much work routing makes, never what it finds.  At most
    ``HOT_LIMIT`` shingles, the most frequent ones, are broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lightened()
        sets, total = [], 0

        def counted() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(sets), return_counts=True)
            often = n > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(values[often].astype(np.int64)), pa.array(n[often].astype(np.int64))], ["shingle", "n"]
            )

        for batch in (part for b in batches for part in sliced(b)):
            sets += shingle_sets(batch.column("text"), size)
            total += sum(map(len, sets[-len(batch) :]))
            if total >= CHUNK_SHINGLES:
                yield counted()
                sets, total = [], 0
        if sets:
            yield counted()

    counts = keyed.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    often = counts.filter(F.col("n") > frequent).orderBy(F.desc("n"), "shingle").limit(HOT_LIMIT)
    return np.sort(often.toPandas()["shingle"].to_numpy(np.int64).astype(_U))


def _points(keyed: DataFrame, hot: np.ndarray, size: int, percent: int) -> DataFrame:
    """(doc_id, tag, n, cls, cold, hot, vector): set size, class, the prefix in its two parts, packed, and the point."""
    shared = keyed.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lightened()
        last = shared.value
        for batch in (part for b in batches for part in sliced(b)):
            n, cls, cold, warm, vector = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), size):
                spot = np.minimum(np.searchsorted(last, s), max(0, len(last) - 1))
                late = last[spot] == s if len(last) else np.zeros(len(s), bool)
                keep = _prefix_size(len(s), percent) if len(s) else 0
                early = s[~late][:keep]
                n.append(len(s))
                cls.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
                cold.append(early.tobytes())
                warm.append(s[late][: keep - len(early)].tobytes())
                vector.append(_packed_vector(count_vector(s)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("tag"),
                    pa.array(n, pa.int64()),
                    pa.array(cls, pa.int64()),
                    *[pa.array(x, pa.binary()) for x in (cold, warm, vector)],
                ],
                ["doc_id", "tag", "n", "cls", "cold", "hot", "vector"],
            )

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {kind}, tag long, n long, cls long, cold binary, hot binary, vector binary")


def _cold_buckets(points: DataFrame, ranges: int) -> DataFrame:
    """(bucket, cls) of shingles that are not frequent, shuffled as packed ranges of shingles.

    Such a shingle is in few sets of any part of the input, which bounds what a range holds.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x, _U) for x in batch.column("cold").to_pylist()]
            if not (total := sum(map(len, parts))):
                continue
            shingles = np.concatenate(parts)
            cls = np.repeat(batch.column("cls").to_numpy(), [len(p) for p in parts])
            at = (_mixed(shingles) % _U(ranges)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            at, shingles, cls = at[order], shingles[order], cls[order]
            cut = np.flatnonzero(np.diff(at, prepend=-1))
            stop = np.append(cut[1:], total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(at[cut]),
                    pa.array([shingles[a:b].tobytes() for a, b in zip(cut, stop, strict=True)], pa.binary()),
                    pa.array([cls[a:b].tobytes() for a, b in zip(cut, stop, strict=True)], pa.binary()),
                ],
                ["range", "shingles", "classes"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shingles, classes = None, [], []

        def buckets() -> pa.RecordBatch:
            s, c = np.frombuffer(b"".join(shingles), _U), np.frombuffer(b"".join(classes), np.int64)
            order = np.lexsort((c, s))
            s, c = s[order], c[order]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
            s, c = s[new], c[new]
            cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            m = np.diff(np.append(cut, len(s)))
            # Two sums of hashed classes name a bucket.
            mixed = _mixed(c.astype(_U))
            name = _mixed(np.add.reduceat(mixed, cut) ^ _mixed(np.add.reduceat(mixed * mixed, cut)))
            _, pick = np.unique(name, return_index=True)
            chosen = np.zeros(len(cut), bool)
            chosen[pick] = True
            rows = np.repeat(chosen & (m > 1), m)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(name, m)[rows].astype(np.int64)), pa.array(c[rows])], ["bucket", "cls"]
            )

        for batch in batches:
            for at, s, c in zip(*(batch.column(k).to_pylist() for k in ("range", "shingles", "classes")), strict=True):
                if current is not None and at != current:
                    yield buckets()
                    shingles, classes = [], []
                current = at
                shingles.append(s)
                classes.append(c)
        if current is not None:
            yield buckets()

    dealt = points.select("cls", "cold").mapInArrow(deal, "range long, shingles binary, classes binary")
    met = dealt.repartition("range").sortWithinPartitions("range").mapInArrow(meet, "bucket long, cls long")
    return met.distinct()


def _hot_buckets(points: DataFrame) -> DataFrame:
    """(bucket, cls) of frequent shingles, of sets that have too few others."""

    @F.pandas_udf("array<long>")
    def unpacked(raw):
        return raw.map(lambda x: np.frombuffer(x, np.int64))

    rows = points.filter(F.length("hot") > 0).select("cls", F.explode(unpacked("hot")).alias("shingle")).distinct()
    part = lambda seed: F.sum(F.pmod(F.xxhash64("cls", F.lit(seed)), F.lit(1 << 31)))
    named = rows.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("m"), F.struct(F.count(F.lit(1)), F.min("cls"), part(1), part(2)).alias("name")
    )
    chosen = named.filter("m > 1").groupBy("name").agg(F.min("shingle").alias("shingle")).select("shingle")
    return rows.join(chosen, "shingle", "left_semi").select(F.col("shingle").alias("bucket"), "cls")


def _parted(buckets: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """(bucket, cls) of the buckets of at most ``cell`` classes, and of the larger ones."""
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > cell)
    large = cut_lineage(buckets.join(sizes, "bucket"))
    if large.isEmpty():
        return buckets, large.drop("m")
    return buckets.join(sizes, "bucket", "left_anti"), cut_lineage(_merged(large))


def _merged(large: DataFrame) -> DataFrame:
    """(bucket, cls): the buckets of ``large`` (bucket, cls, m: its classes), like ones put together.

    A bucket goes to that which is the largest one of half its classes or more, unless the latter
    would grow to more than twice its size.  Buckets that are put together hold all pairs of
    each, so this decides how much work is made, never what is found.
    """
    top = large.groupBy("cls").agg(F.max(F.struct("m", "bucket")).alias("top"))
    votes = large.join(top, "cls").groupBy("bucket", "m", F.col("top.bucket").alias("to")).agg(F.count(F.lit(1)).alias("n"))
    most = votes.groupBy("bucket", "m").agg(F.max(F.struct("n", "to")).alias("best"))
    goes = cut_lineage(most.select("bucket", "m", F.when(2 * F.col("best.n") >= F.col("m"), F.col("best.to")).otherwise(F.col("bucket")).alias("to")))
    for _ in range(2):
        onward = goes.select(F.col("bucket").alias("to"), F.col("to").alias("next"))
        goes = goes.join(onward, "to").select("bucket", "m", F.col("next").alias("to"))
    goes = cut_lineage(goes)
    moved = large.join(goes.select("bucket", "to"), "bucket")
    grown = moved.groupBy("to").agg(F.count_distinct("cls").alias("size"))
    fits = grown.join(goes.select(F.col("bucket").alias("to"), "m"), "to").select("to", (F.col("size") <= 2 * F.col("m")).alias("fits"))
    name = F.when(F.col("fits"), F.col("to")).otherwise(F.col("bucket"))
    return moved.join(fits, "to").select(name.alias("bucket"), "cls").distinct()


def _cells(large: DataFrame, active: DataFrame, cell: int, percent: int) -> DataFrame:
    """(key, left, same, cls): the classes of each pair of cells of a large bucket that is to be joined.

    A cell is a range of sizes and a hash, with some ``2 * cell`` classes and at most about
    ``CELL_SHINGLES`` shingles; only cells of the same or neighbouring ranges can hold links.
    """
    # Sizes of linked sets differ by no more than a range is wide.
    factor = max(1.25, 100 / percent)
    step = F.floor(F.log(F.col("n")) / F.log(F.lit(factor + 1e-9))).cast("int")
    rows = large.join(active.select("cls", "n"), "cls").select("bucket", "cls", "n", step.alias("step"))
    many = F.greatest(F.ceil(F.count(F.lit(1)) / (2 * cell)), F.ceil(F.sum("n") / CELL_SHINGLES)).cast("int")
    # A range is a quarter wider than the one before, so a bucket has a few dozen.
    ranges = rows.groupBy("bucket", "step").agg(many.alias("many")).groupBy("bucket").agg(
        F.collect_list(F.struct("step", "many")).alias("ranges")
    )
    own = F.filter("ranges", lambda r: r["step"] == F.col("step"))[0]["many"]
    near = F.filter("ranges", lambda r: F.abs(r["step"] - F.col("step")) <= 1)
    placed = rows.join(ranges, "bucket").select(
        "bucket", "cls", "step", F.pmod(F.xxhash64("cls"), own).cast("int").alias("slot"), F.explode(near).alias("other")
    )
    spread = placed.withColumn("slot2", F.explode(F.sequence(F.lit(0), F.col("other.many") - 1)))
    here, there = F.struct("step", "slot"), F.struct(F.col("other.step").alias("step"), F.col("slot2").alias("slot"))
    low, high = F.least(here, there), F.greatest(here, there)
    return spread.select(F.xxhash64("bucket", low, high).alias("key"), (here == low).alias("left"), (low == high).alias("same"), "cls")


def tree_levels(sizes: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
    """Packed R-tree: the order of the points, and from the leaves up (first, stop, least size, largest size, maxima)."""
    order = np.lexsort((*vectors.T[:4], sizes))
    n, v = sizes[order], vectors[order]
    first = np.arange(0, len(n), leaf)
    levels = [(first, np.minimum(first + leaf, len(n)), np.minimum.reduceat(n, first), np.maximum.reduceat(n, first), np.maximum.reduceat(v, first))]
    while len(levels[-1][0]) > 1:
        _, _, low, high, top = levels[-1]
        first = np.arange(0, len(low), fanout)
        levels.append((first, np.minimum(first + fanout, len(low)), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.maximum.reduceat(top, first)))
    return order, levels


def _children(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = stop - first
    owner = np.repeat(np.arange(len(first)), n)
    return owner, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[owner]


def tree_join(sizes, vectors, queries, q_sizes, percent: int, block: int = 1 << 14):
    """(query, point, bound) of all pairs whose bound and sizes allow a link."""
    order, levels = tree_levels(sizes, vectors)
    tops = [*[level[4] for level in levels[::-1]], vectors[order]]
    lows = [*[level[2] for level in levels[::-1]], sizes[order]]
    highs = [*[level[3] for level in levels[::-1]], sizes[order]]
    found = []
    for at in range(0, len(queries), 512):
        q = np.arange(at, min(at + 512, len(queries)))
        owner = np.repeat(q, len(tops[0]))
        node = np.tile(np.arange(len(tops[0])), len(q))
        bound = np.zeros(0)
        for depth in range(len(tops)):
            fits = (100 * lows[depth][node] <= (100 * 100 * q_sizes[owner]) // percent) & (100 * highs[depth][node] >= percent * q_sizes[owner])
            owner, node = owner[fits], node[fits]
            bound = np.zeros(len(owner), np.int64)
            for b in range(0, len(owner), block):
                part = slice(b, b + block)
                bound[part] = np.minimum(queries[owner[part]], tops[depth][node[part]]).sum(axis=1)
            enough = bound >= needed_overlap(q_sizes[owner], lows[depth][node], percent)
            owner, node, bound = owner[enough], node[enough], bound[enough]
            if depth < len(levels):
                level = levels[::-1][depth]
                up, node = _children(level[0][node], level[1][node])
                owner = owner[up]
        found.append((owner, order[node], bound))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.array([], np.int64),) * 3


def _by_groups(n: np.ndarray, v: list[np.ndarray], tree: np.ndarray, asks: np.ndarray, percent: int):
    """Pairs (ask, tree, bound) over trees of points with equally many groups; asks have as many, or as the sizes of links allow."""
    # 2 ** doublings is at least 100 / percent, by which the sizes and so the groups of two sets that link may differ.
    doublings = next(k for k in range(1, 8) if percent << k >= 100)
    groups = np.array([len(x) for x in v])
    found = [(np.array([], np.int64),) * 3]
    for g in np.unique(groups[tree]).tolist():
        own = tree[groups[tree] == g]
        for h in (g * 2**k // 2**doublings for k in range(2 * doublings + 1)):
            ask = asks[groups[asks] == h]
            if len(ask):
                a, b = (folded(np.stack([v[i] for i in x]), min(g, h)) for x in (own, ask))
                q, p, bound = tree_join(n[own], a, b, n[ask], percent)
                found.append((ask[q], own[p], bound))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _keyed_runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The rows of each key, in batches that are sorted by it."""
    key, rows = None, []
    for batch in batches:
        for at, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if rows and at != key:
                yield rows
                rows = []
            key = at
            rows.append(row)
    if rows:
        yield rows


def _pair_batches(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes as batches of (a, b) with a < b."""
    pairs, size = [], 0

    def batch_of() -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for some in found:
        pairs.append(some)
        size += len(some[0])
        if size > 100_000:
            yield batch_of()
            pairs, size = [], 0
    if pairs:
        yield batch_of()


def _candidates(buckets: DataFrame, spots: DataFrame, percent: int, best_only: bool) -> DataFrame:
    """(a, b) with a < b: pairs of classes of different labels that may link; only each point's best one if wanted.

    ``buckets`` are those that fit into a task; ``spots`` has cls, n, label and vector.
    """

    def joined(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        n, cls, label = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        if len(cls) < 2 or (label == label[0]).all():
            return cls[:0], cls[:0]
        every = np.arange(len(cls))
        q, p, bound = _by_groups(n, [_vector(r[3]) for r in rows], every, every, percent)
        use = (label[q] != label[p]) & ((q < p) | best_only)
        q, p, bound = q[use], p[use], bound[use]
        if best_only and len(q):
            # The neighbour that may be most similar; ties go to the smaller class.
            share = bound / (n[q] + n[p] - bound)
            order = np.lexsort((cls[p], -share, q))
            first = order[np.concatenate([[True], q[order][1:] != q[order][:-1]])]
            q, p = q[first], p[first]
        return cls[q], cls[p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pair_batches(joined(rows) for rows in _keyed_runs(batches, ("bucket", "n", "cls", "label", "vector")))

    dealt = buckets.join(spots, "cls").select("bucket", "n", "cls", "label", "vector").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def overlaps(sets: list[np.ndarray], q: np.ndarray, p: np.ndarray, columns: int = COLUMNS, block: int = 1 << 14) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, by bit rows over the shingles that several of them hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, shingle, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = holders > 1
    number, use = np.cumsum(shared) - 1, shared[shingle]
    owner, column = owner[use], number[shingle[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros(len(q), np.int64)
    for low in range(0, int(shared.sum()), columns):
        part = slice(*np.searchsorted(column, [low, low + columns]))
        width = min(columns, int(shared.sum()) - low)
        bits = np.zeros((len(sets), -(-width // 64) * 64), bool)
        bits[owner[part], column[part] - low] = True
        bits = np.packbits(bits, axis=1).view(_U)
        for at in range(0, len(q), block):
            some = slice(at, at + block)
            total[some] += np.bitwise_count(bits[q[some]] & bits[p[some]]).sum(axis=1, dtype=np.int64)
    return total


def spanning(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """Numbers of edges that connect whatever all edges (a, b) connect, fewer than ``nodes``."""
    root, left, chosen = np.arange(nodes), np.arange(len(a)), [np.array([], np.int64)]
    while True:
        x, y = root[a[left]], root[b[left]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        left, low, high = left[low < high], low[low < high], high[low < high]
        if not len(left):
            return np.concatenate(chosen)
        # Each root goes to one smaller root, so no circle arises.
        high, at = np.unique(high, return_index=True)
        chosen.append(left[at])
        root[high] = low[at]
        while (root[root] != root).any():
            root = root[root]


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(cls, n, shingles, vector) of each class: its set, packed, and its point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in sliced(b)):
            sets = shingle_sets(batch.column("text"), size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("cls"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                    pa.array([_packed_vector(count_vector(s)) for s in sets], pa.binary()),
                ],
                ["cls", "n", "shingles", "vector"],
            )

    return texts.select("cls", "text").mapInArrow(run, "cls long, n long, shingles binary, vector binary").dropDuplicates(["cls"])


def _crowd_links(cells: DataFrame, sets: DataFrame, percent: int, all_links: bool) -> DataFrame:
    """(a, b) with a < b: pairs of classes of the cells that link; only those that span what they connect, if not all."""

    def joined(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        left, same = np.array([r[0] for r in rows], bool), rows[0][1]
        n, cls = (np.array([r[k] for r in rows], np.int64) for k in (2, 3))
        if len(cls) < 2 or (not same and (left.all() or not left.any())):
            return cls[:0], cls[:0]
        tree, asks = (np.arange(len(cls)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        q, p, _ = _by_groups(n, [_vector(r[5]) for r in rows], tree, asks, percent)
        if same:
            q, p = q[q < p], p[q < p]
        both = overlaps([np.frombuffer(r[4], _U) for r in rows], q, p)
        linked = 100 * both >= percent * (n[q] + n[p] - both)
        q, p = q[linked], p[linked]
        if not all_links:
            some = spanning(q, p, len(cls))
            q, p = q[some], p[some]
        return cls[q], cls[p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "left", "same", "n", "cls", "shingles", "vector")
        yield from _pair_batches(joined(rows) for rows in _keyed_runs(batches, names))

    dealt = cells.join(sets, "cls").select("key", "left", "same", "n", "cls", "shingles", "vector")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that link, by their sets."""
    a = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for x in batches for y in sliced(x, "text_a") for p in sliced(y, "text_b")):
            good = []
            for s, t in zip(shingle_sets(batch.column("text_a"), size), shingle_sets(batch.column("text_b"), size), strict=True):
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * both >= percent * (len(s) + len(t) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(cls, label): the smallest class that each class of an edge (a, b) is connected with.

    Large-star and small-star rounds; all rows of a node are aggregated, never gathered.
    """
    edges = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            roots = edges.select(F.col("v").alias("cls"), F.col("v").alias("label")).distinct()
            return edges.select(F.col("u").alias("cls"), F.col("v").alias("label")).unionByName(roots)
        state = now


def _labelled(spots: DataFrame, labels: DataFrame) -> DataFrame:
    return spots.drop("label").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tag"] == b["tag"])


def _routed(keyed: DataFrame, size: int, percent: int, frequent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, buckets, active): all points, the buckets, and one row of each class that is in one."""
    hot = frequent_shingles(keyed, size, frequent)
    points = cut_lineage(_points(keyed, hot, size, percent))
    filled = points.filter("n > 0")
    postings = filled.agg(F.sum(F.length("cold")).alias("b")).first()["b"] or 0
    ranges = max(1, postings // (8 * RANGE_ROWS), keyed.sparkSession.sparkContext.defaultParallelism * 4)
    buckets = cut_lineage(_cold_buckets(filled, int(ranges)).unionByName(_hot_buckets(filled)))
    of_class = filled.groupBy("cls").agg(F.max("n").alias("n"), F.max("vector").alias("vector"), F.min(F.struct("doc_id", "tag")).alias("one"))
    return points, buckets, cut_lineage(of_class.join(buckets.select("cls").distinct(), "cls", "left_semi"))


def _wanted(pairs: DataFrame, large: DataFrame) -> DataFrame:
    """(cls, crowded): the classes of ``pairs`` and of large buckets, and whether they are in one of the latter."""
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
    both = ends.withColumn("crowded", F.lit(False)).unionByName(large.select("cls", F.lit(True).alias("crowded")))
    return both.groupBy("cls").agg(F.max("crowded").alias("crowded"))


def _texts_of(keyed: DataFrame, active: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, crowded, text) of the wanted classes; as many rows as ``keyed`` has repeated ones."""
    ones = active.join(wanted, "cls").select("cls", "crowded", "one.*")
    return keyed.join(ones, _same_row(keyed, ones)).select("cls", "crowded", keyed["text"])


def link_classes(
    keyed: DataFrame, size: int = SIZE, percent: int = PERCENT, frequent: int = FREQUENT, cell: int = CELL
) -> tuple[DataFrame, DataFrame]:
    """(members, labels): doc_id, tag, n, cls of every row of ``keyed``, and (cls, label) of classes with links."""
    points, buckets, active = _routed(keyed, size, percent, frequent)
    spots = active.select("cls", "n", "vector", F.col("cls").alias("label"))
    small, large = _parted(buckets, cell)

    best = cut_lineage(_candidates(small, spots, percent, best_only=True))
    # Every class that has a surviving pair at all has a best one: these and the crowds are all the texts that are needed.
    wanted = cut_lineage(_wanted(best, large))
    texts = cut_lineage(_texts_of(keyed, active, wanted))
    links = _verified(best, texts, size, percent)
    if not large.isEmpty():
        links = links.unionByName(_crowd_links(_cells(large, active, cell, percent), _sets(texts.filter("crowded"), size), percent, all_links=False))
    links = cut_lineage(links)
    labels = components(links)
    rest = _candidates(small, _labelled(spots.join(wanted, "cls", "left_semi"), labels), percent, best_only=False)
    more = _verified(rest, texts, size, percent)
    # What the first links have joined is a star for each component by now, which takes fewer rounds than the links.
    joined = labels.select(F.col("cls").alias("a"), F.col("label").alias("b"))
    return points.select("doc_id", "tag", "n", "cls"), components(joined.unionByName(more))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(quoted(text_col), F.lit(""))
    return docs.select(quoted(id_col).alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def all_links(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    percent: int = PERCENT,
    frequent: int = FREQUENT,
    cell: int = CELL,
) -> tuple[DataFrame, DataFrame]:
    """(members, links): doc_id, n_shingles and cls of every row, and (a, b), a < b, of all pairs of classes that link.

    Rows of one class have equal sets and link, too, but for those without words.  Unlike
    components, links may be as many as the square of a family's classes.
    """
    keyed = _keyed(docs, id_col, text_col)
    points, buckets, active = _routed(keyed, size, percent, frequent)
    spots = active.select("cls", "n", "vector", F.col("cls").alias("label"))
    small, large = _parted(buckets, cell)
    pairs = cut_lineage(_candidates(small, spots, percent, best_only=False))
    texts = cut_lineage(_texts_of(keyed, active, _wanted(pairs, large)).dropDuplicates(["cls"]))
    crowds = _crowd_links(_cells(large, active, cell, percent), _sets(texts.filter("crowded"), size), percent, all_links=True)
    links = cut_lineage(_verified(pairs, texts, size, percent).unionByName(crowds).distinct())
    members = points.select("doc_id", F.col("n").alias("n_shingles"), "cls")
    return members, links


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id and n_links of every row: with how many other rows it links, equal ones included."""
    members, links = all_links(docs, id_col, text_col, **options)
    rows = members.filter("n_shingles > 0").groupBy("cls").agg(F.count(F.lit(1)).alias("rows"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(rows.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("rows").alias("near"))
    of_class = rows.join(near, "cls", "left").select("cls", (F.col("rows") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return members.join(of_class, "cls", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    ``component_id`` is the smallest id that a row's set is connected with by links; equal
    sets are linked.  Rows without words are linked with nothing and are their own
    component.  Null texts have no words.  Null ids come last.  Repeated rows are equal
    sets.  Other columns are ignored; an empty table gives no rows.
    """
    members, labels = link_classes(_keyed(docs, id_col, text_col), **options)
    ids = members.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    rooted = ids.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    family = rooted.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(family, "label").select("cls", "component_id")
    return members.join(of_class, "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, whole and as it came: the one with the smallest id.

    Rows without words are all kept.  Of rows that share the smallest id of a component,
    one is kept.
    """
    text = F.coalesce(quoted(text_col), F.lit(""))
    rows = held(docs, doc_id=quoted(id_col), tag=F.xxhash64(text))
    members, labels = link_classes(_keyed(docs, id_col, text_col), **options)
    # Rows that share a class share the label; the place within it is settled on (id, tag) alone.
    grouped = members.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    first = grouped.filter("n > 0").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag")).alias("one"))
    kept = first.select("one.doc_id", "one.tag").withColumn("single", F.lit(True))
    blank = grouped.filter("n = 0").select("doc_id", "tag").distinct().withColumn("single", F.lit(False))
    chosen = kept.unionByName(blank)
    joined = rows.join(chosen, _same_row(rows, chosen)).select(rows["_row"], rows["doc_id"], rows["tag"], "single")
    place = F.row_number().over(Window.partitionBy("doc_id", "tag").orderBy("doc_id"))
    return released(joined.withColumn("place", place).filter("not single or place = 1"))
