"""Removal of long repeated strings by threshold-bounded interval expansion.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else as well.

1. Anchors.  Of the short grams in a window of ``length`` bytes, the one with the smallest
   hash (the leftmost of equal ones) is its anchor, so equal windows have equal anchors at
   the same place.  Windows in a row with one anchor form a *stretch*; a stretch is one
   row with hashes of its anchor and of its whole text.
2. Stretches that occur twice as a whole are repeated throughout; counting them needs no text.
3. Of the other stretches, only those whose anchor also occurs in a different stretch
   can hold repeated windows.  Windows at nearly the same distance from their anchor share
   a core; windows whose core no other stretch has are unique.  The texts of the others,
   one per distinct stretch, go to the anchor's task.
4. There a suffix array and the Burrows-Wheeler transform of the batch are built, and
   common prefixes are derived by breadth-first backward extension: intervals of rank of
   all strings of length l give those of length l + 1, and each new right border has a
   common prefix of l.  The search stops at ``length``: borders that are not reached by
   then have common prefixes of at least ``length``, and the windows beside them repeat.
5. An anchor with very many such texts doesn't go to one task: its windows are
   compared by aggregating their hashes.

Every window is judged on the input; matches never cross rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import held, lightened, quoted, sliced
from glossa.session import cut_lineage

LENGTH = 400
GRAM = 32
GROUP = 24
CROWD = 1_000
BATCH_BYTES = 1_500_000
#: Text that a task compares, several batches; some 1.5 seconds for each batch.
TASK_BYTES = 4 * BATCH_BYTES
#: Text that is hashed at a time; a byte of it takes about 90 bytes of memory.
SLICE_BYTES = 128_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


_TABLES: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, ``n`` at least: one pair of tables a worker, which grows when it must."""
    if not _TABLES or len(_TABLES[0]) < n:
        tables = []
        for base in (_BASE, _INVERSE):
            powers = np.full(n, _U(base), _U)
            powers[0] = 1
            tables.append(np.multiply.accumulate(powers))
        _TABLES[:] = tables
    return _TABLES


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return (x ^ (x >> _U(32))) * _U(0x94D049BB133111EB)


class Hashes:
    """Hashes of substrings of a byte array, from prefix sums."""

    def __init__(self, raw: np.ndarray):
        self.up, self.down = _powers(1 << int(len(raw) + 1).bit_length())
        self.sums = np.zeros(len(raw) + 1, _U)
        np.cumsum((raw.astype(_U) + _U(1)) * self.up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.down[start])


def raw_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and their borders; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    low, high = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.array([], np.uint8)
    return raw, offsets - low


def stretches(raw: np.ndarray, borders: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """row, first window (bytes from the row's start), shape, anchor hash and text hash of each stretch.

    The shape is the number of further windows times ``length`` plus the place of the anchor.
    """
    width = length - gram + 1
    n = len(raw) - gram + 1
    long_rows = np.flatnonzero(np.diff(borders) >= length)
    if not len(long_rows):
        none = np.array([], np.int64)
        return {"row": none, "first": none, "shape": none, "anchor": none, "print": none}
    hashes = Hashes(raw)
    grams = hashes.of(np.arange(n), np.arange(gram, len(raw) + 1))
    order = (grams & _U(0xFFFFFFFF00000000)) | np.arange(n, dtype=_U)
    blocks = np.concatenate([order, np.full(-n % width, ~_U(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - width + 1
    least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & _U(0xFFFFFFFF)
    # Windows inside one row, and where the anchor or the row changes.
    inside = np.zeros(windows + 1, np.int8)
    inside[borders[long_rows]] = 1
    ends = borders[long_rows + 1] - length + 1
    starts_at = np.flatnonzero(inside)
    valid = np.zeros(windows + 1, np.int32)
    np.add.at(valid, starts_at, 1)
    np.add.at(valid, ends, -1)
    valid = np.cumsum(valid)[:windows] > 0
    change = np.ones(windows, bool)
    change[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    change[starts_at] = True
    first = np.flatnonzero(change & valid)
    stop = np.ones(windows, bool)
    stop[:-1] = change[1:] | ~valid[1:]
    last = np.flatnonzero(stop & valid)
    at = least[first].astype(np.int64)
    row = np.searchsorted(borders, first, side="right") - 1
    shape = (last - first) * length + at - first
    return {
        "row": row,
        "first": first - borders[row],
        "shape": shape,
        "anchor": grams[at].astype(np.int64),
        "print": (hashes.of(first, last + length) ^ _mixed(shape.astype(_U))).astype(np.int64),
    }


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their next ``depth`` symbols at least, by doubling; later symbols don't count.

    A round sorts the positions that are still tied; the rank of a tie is the place of its first.
    """
    n, packed = len(text), 6
    key = np.zeros(n, np.int64)
    for i in range(packed):
        key *= 512
        key[: n - i] += text[i:] if i else text
    size, order, rank = packed, np.argsort(key), np.empty(n, np.int64)
    slots, ordered = np.arange(n), key[order]
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(slots)))
        rank[order[slots]] = np.repeat(slots[heads], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        if size >= depth or not len(slots):
            return order
        at = order[slots]
        ahead = at + size
        key = rank[at] * (n + 1)
        inside = ahead < n
        key[inside] += rank[ahead[inside]] + 1
        by_key = np.argsort(key)
        order[slots], ordered = at[by_key], key[by_key]
        size *= 2


def bounded_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each rank, whether its suffix shares ``length`` symbols or more with the one before.

    Breadth-first over the intervals of all strings by increasing length, extended
    backward on the transform; a border is final when it is first reached.
    """
    n = len(text)
    bwt = text[order - 1].astype(np.int64)  # position 0 wraps around to the end mark
    symbols = np.unique(bwt)
    by_symbol = np.argsort(bwt.astype(np.int16), kind="stable")  # of each symbol, in order of rank
    places = bwt[by_symbol] * n + by_symbol
    onward = np.empty(n, np.int64)  # where the suffix that is longer by the symbol before stands
    onward[by_symbol] = np.arange(n)
    run = np.cumsum(np.diff(bwt, prepend=bwt[:1]) != 0)

    open_border = np.ones(n + 1, bool)
    open_border[[0, n]] = False
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        # Most intervals have one symbol before all their suffixes and move on as they are.
        even = run[low] == run[high - 1]
        mixed_low, mixed_high = low[~even], high[~even]
        # Symbols before the suffixes of the others: all symbols for wide ones, else those that stand there.
        wide = mixed_high - mixed_low > len(symbols)
        symbol = np.tile(symbols, int(wide.sum())) * n
        wide_low = np.searchsorted(places, symbol + np.repeat(mixed_low[wide], len(symbols)))
        wide_high = np.searchsorted(places, symbol + np.repeat(mixed_high[wide], len(symbols)))
        narrow = np.flatnonzero(~wide)
        counts = (mixed_high - mixed_low)[narrow]
        owner = np.repeat(narrow, counts)
        at = mixed_low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        _, pick, many = np.unique(owner * 512 + bwt[at], return_index=True, return_counts=True)
        narrow_low = onward[at[pick]]
        new_low = np.concatenate([onward[low[even]], wide_low, narrow_low])
        new_high = np.concatenate([onward[high[even] - 1] + 1, wide_high, narrow_low + many])
        # Strings of one length have intervals of their own, so no border is reached twice here.
        fresh = (new_high > new_low) & open_border[new_high]
        low, high = new_low[fresh], new_high[fresh]
        open_border[high] = False
        if not len(low):
            break
    return open_border[:n]


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Starts of the windows of each text that occur at another place of the texts, too."""
    sizes = np.array([len(t) for t in texts])
    text = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    for start, t in zip(starts, texts, strict=True):
        text[start : start + len(t)] = np.frombuffer(t, np.uint8).astype(np.int64) + 1
    order = suffix_order(text, length + 2)
    shared = bounded_prefixes(text, order, length)
    both = shared | np.concatenate([shared[1:], [False]])
    repeated = np.zeros(len(text), bool)
    repeated[order[both]] = True
    return [
        np.flatnonzero(repeated[start : start + max(0, size - length + 1)]) for start, size in zip(starts, sizes, strict=True)
    ]


def _spans(at: np.ndarray) -> list[dict[str, int]]:
    """Runs of consecutive numbers as {lo, hi}."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    return [
        {"lo": int(a), "hi": int(b)} for a, b in zip(at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])], strict=True)
    ]


_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _anchored(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lightened()
        for batch in (part for b in batches for part in sliced(b, limit=SLICE_BYTES)):
            raw, borders = raw_texts(batch.column("text"))
            found = stretches(raw, borders, length, gram)
            take = pa.array(found["row"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(take),
                    batch.column("tag").take(take),
                    *[pa.array(found[c], pa.int64()) for c in ("first", "shape", "anchor", "print")],
                ],
                ["doc_id", "tag", "first", "shape", "anchor", "print"],
            )

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {kind}, tag long, first long, shape long, anchor long, print long")


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tag"] == b["tag"])


def cores(raw: np.ndarray, at: int, length: int, group: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of each window by its distance from the anchor at ``at``, and the core hash of each group in turn."""
    groups = (at - np.arange(len(raw) - length + 1)) // group
    own = np.unique(groups)[::-1]
    start = at - own * group
    return groups, Hashes(raw).of(start, start + length - group + 1)


def _texts(keyed: DataFrame, wanted: DataFrame, length: int, group: int) -> DataFrame:
    """(anchor, print, at, bytes, cores) of the wanted stretches, the bytes compressed."""
    fields = ("first", "shape", "anchor", "print")
    by_row = wanted.groupBy("doc_id", "tag").agg(F.collect_list(F.struct(*fields)).alias("wanted"))
    core_list = pa.list_(pa.struct([("group", pa.int32()), ("core", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in sliced(b, limit=SLICE_BYTES)):
            found, texts, shared = [], [], []
            for text, stretch_list in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                whole = text.encode("utf-8", "surrogatepass")
                for s in stretch_list:
                    more, s["at"] = divmod(s["shape"], length)
                    raw = whole[s["first"] : s["first"] + more + length]
                    groups, hashed = cores(np.frombuffer(raw, np.uint8), s["at"], length, group)
                    own = dict.fromkeys(groups.tolist())
                    found.append(s)
                    texts.append(zlib.compress(raw, 1))
                    shared.append([{"group": g, "core": h} for g, h in zip(own, hashed.astype(np.int64).tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array([s[c] for s in found], pa.int64()) for c in ("anchor", "print", "at")],
                    pa.array(texts, pa.binary()),
                    pa.array(shared, core_list),
                ],
                ["anchor", "print", "at", "bytes", "cores"],
            )

    joined = keyed.join(by_row, _same_row(keyed, by_row)).select(keyed["text"], "wanted")
    return joined.mapInArrow(
        run, "anchor long, print long, at long, bytes binary, cores array<struct<group:int,core:bigint>>"
    )


def _narrowed(texts: DataFrame, length: int, group: int) -> DataFrame:
    """(anchor, print, start, bytes): the runs of windows of each text whose core another stretch has, too."""
    each = texts.select("anchor", "print", F.explode("cores").alias("c")).select("anchor", "print", "c.*")
    shared = each.groupBy("anchor", "group", "core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    hits = each.join(shared, ["anchor", "group", "core"], "left_semi").groupBy("anchor", "print").agg(
        F.collect_set("group").alias("groups")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, prints, starts, out = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("anchor", "print", "at", "bytes", "groups"))
            for anchor, key, at, packed, groups in zip(*columns, strict=True):
                raw = zlib.decompress(packed)
                of_window = (at - np.arange(len(raw) - length + 1)) // group
                for span in _spans(np.flatnonzero(np.isin(of_window, groups))):
                    anchors.append(anchor)
                    prints.append(key)
                    starts.append(span["lo"])
                    out.append(raw[span["lo"] : span["hi"] + length])
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(x, pa.int64()) for x in (anchors, prints, starts)], pa.array(out, pa.binary())],
                ["anchor", "print", "start", "bytes"],
            )

    joined = texts.join(hits, ["anchor", "print"]).select("anchor", "print", "at", "bytes", "groups")
    return joined.mapInArrow(run, "anchor long, print long, start long, bytes binary")


def _expanded(contexts: DataFrame, length: int, tasks: int) -> DataFrame:
    """(anchor, print, spans) by suffix arrays over batches of whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            found = repeated_windows(texts, length)
            rows = [(a, p, _spans(at + start)) for (a, p, start), at in zip(keys, found, strict=True) if len(at)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], _SPANS),
                ],
                ["anchor", "print", "spans"],
            )

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("anchor", "print", "start", "bytes"))
            for anchor, key, start, raw in zip(*columns, strict=True):
                if size >= BATCH_BYTES and keys[-1][0] != anchor:
                    yield flush()
                    keys, texts, size = [], [], 0
                keys.append((anchor, key, start))
                texts.append(raw)
                size += len(raw)
        if keys:
            yield flush()

    # Few bytes are much work here, so their number would be too small if it followed the size of the shuffle.
    dealt = contexts.repartition(tasks, "anchor").sortWithinPartitions("anchor", "print", "start")
    return dealt.mapInArrow(run, "anchor long, print long, spans array<struct<lo:int,hi:int>>")


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """(anchor, print, spans) by counting window hashes, for anchors with too many texts for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("anchor", "print", "start", "bytes"))
            for anchor, key, start, raw in zip(*columns, strict=True):
                at = np.arange(len(raw) - length + 1)
                hashed = Hashes(np.frombuffer(raw, np.uint8)).of(at, at + length).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), anchor)), pa.array(np.full(len(at), key)), pa.array(at + start), pa.array(hashed)],
                    ["anchor", "print", "at", "window"],
                )

    windows = contexts.mapInArrow(run, "anchor long, print long, at long, window long")
    often = windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    hits = windows.join(often, ["anchor", "window"], "left_semi")
    # A stretch has fewer windows than `length`.
    starts = hits.groupBy("anchor", "print").agg(F.collect_set(F.col("at").cast("int")).alias("starts"))
    return starts.select("anchor", "print", F.transform("starts", lambda at: F.struct(at.alias("lo"), at.alias("hi"))).alias("spans"))


def covered(
    keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, crowd: int = CROWD
) -> DataFrame:
    """(doc_id, tag, covered): byte ranges [from, to) of each row to be removed; rows without any are left out.

    ``keyed`` has doc_id, tag (a hash of the text, so that rows are told apart by id and
    text) and text.
    """
    anchors = cut_lineage(_anchored(keyed, length, gram))
    classes = cut_lineage(
        anchors.groupBy("anchor", "print").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "tag", "first", "shape")).alias("one")
        )
    )
    # Anchors of one stretch only, and those of stretches that all repeat, need no comparison.
    kinds = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    compared = classes.join(kinds.filter("kinds > 1 and least = 1"), "anchor").select("anchor", "print", "one.*")
    texts = cut_lineage(_texts(keyed, compared, length, group))
    contexts = cut_lineage(_narrowed(texts, length, group))
    crowds = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("anchor")
    load = contexts.agg(F.sum(F.length("bytes"))).first()[0] or 0
    tasks = max(keyed.sparkSession.sparkContext.defaultParallelism, load // TASK_BYTES)
    parts = _expanded(contexts.join(crowds, "anchor", "left_anti"), length, tasks).unionByName(
        _counted(contexts.join(crowds, "anchor", "left_semi"), length)
    )
    whole = classes.filter("n > 1").select(
        "anchor",
        "print",
        F.array(F.struct(F.lit(0).alias("lo"), F.floor(F.col("one.shape") / length).cast("int").alias("hi"))).alias("spans"),
    )
    # A stretch that repeats as a whole has its verdict already.
    verdicts = whole.unionByName(parts.join(classes.filter("n = 1"), ["anchor", "print"], "left_semi"))
    ranges = anchors.join(verdicts, ["anchor", "print"]).select("doc_id", "tag", "first", F.explode("spans").alias("span"))
    # A set: repeated rows have equal ranges, and a text bounds how many there are.
    return ranges.groupBy("doc_id", "tag").agg(
        F.collect_set(
            F.struct((F.col("first") + F.col("span.lo")).alias("from"), (F.col("first") + F.col("span.hi") + length).alias("to"))
        ).alias("covered")
    )


def _merged(ranges: list[dict[str, int]] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted((r["from"], r["to"]) for r in ranges or ()):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for span in spans for x in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(quoted(text_col), F.lit(""))
    return docs.select(quoted(id_col).alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def removal_digests(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    Null texts are empty.  Rows with equal texts of ``length`` bytes or more lose all of it,
    repeated rows included.  Other columns are ignored; an empty table gives no rows.
    """
    keyed = _keyed(docs, id_col, text_col)
    gone = covered(keyed, length, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in sliced(b, limit=SLICE_BYTES)):
            n, removed, spans, prints = [], [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("covered").to_pylist(), strict=True):
                raw, merged = text.encode("utf-8", "surrogatepass"), _merged(ranges)
                n.append(len(raw))
                removed.append(sum(b - a for a, b in merged))
                spans.append(len(merged))
                prints.append(hashlib.sha256(_kept(raw, merged)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, removed, spans)], pa.array(prints, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    kind = keyed.schema["doc_id"].dataType.simpleString()
    joined = keyed.join(gone, _same_row(keyed, gone), "left").select(keyed["doc_id"], keyed["text"], "covered")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options
) -> DataFrame:
    """All rows with the repeated bytes cut out of the text; other columns stay as they are.

    Bytes of a character that was cut apart are left out, too.  A text without repeats
    (null included) stays as it is; a text of repeats only becomes empty.
    """
    text = F.coalesce(quoted(text_col), F.lit(""))
    rows = held(docs, doc_id=quoted(id_col), tag=F.xxhash64(text), text=text)
    gone = covered(rows.select("doc_id", "tag", "text"), length, **options)

    @F.pandas_udf("string")
    def shortened(texts, ranges):
        out = [
            _kept(t.encode("utf-8", "surrogatepass"), _merged(None if r is None else list(r))).decode("utf-8", "ignore")
            for t, r in zip(texts, ranges, strict=True)
        ]
        return texts.__class__(out)

    joined = rows.join(gone, _same_row(rows, gone), "left")
    new_text = F.when(F.col("covered").isNull(), F.col("_row")[text_col]).otherwise(shortened("text", "covered"))
    columns = [new_text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns]
    return joined.select(*columns)
