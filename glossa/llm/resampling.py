"""Importance resampling towards a target distribution, with bit-sliced exact weights.

Hashed word runs fill ``buckets`` buckets.  A bucket's gain is the scaled logarithm of how
much likelier the target texts hit it than the corpus does, from the counts of all texts
of both.  A document's weight is the sum of gains over its features.

The weights are added up from bits.  Bit k of the bucket counts of a document is one plane
of ``buckets`` bits; bit j of the gains (two's complement, so the top plane counts
negative) is another.  Where a plane of counts AND a plane of gains are set, they add
2^(j + k) to the weight, so population counts of all pairs of planes give it exactly, in
whole numbers.

Documents are drawn without replacement: the highest weights plus Gumbel noise that
depends on the document id and the seed alone.  Their ranks come from sorted ranges.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import quoted, ranked, sliced
from glossa.session import cut_lineage

BUCKETS = 10_000
SEED = 2024
SCALE = 1000
PERCENT = 10
MIN_WORDS = 20
SLICE_BYTES = 1_000_000
#: Rows whose planes are made at a time: 1,000 rows of 10,000 bits are 1.25 MB a plane.
SLICE_ROWS = 1_000
#: Features up to this many bytes are hashed together, longer ones one by one.
SHORT = 64

_BYTES = np.arange(256, dtype=np.uint8)
_LETTER = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Lower-case letters, digits and all bytes from 128 on; 0 for what stands between words.
_WORD_BYTES = np.where(_LETTER, _LOWER, 0).astype(np.uint8)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans of ``data``, byte by byte for all spans at once."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    begin, size = starts[order], sizes[order]
    n_long = int(np.searchsorted(-size, -SHORT, side="left"))
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for i in range(int(size[n_long]) if n_long < len(size) else 0):
        upto = int(np.searchsorted(-size, -i, side="left"))  # the spans that have a byte i
        part = crc[n_long:upto]
        crc[n_long:upto] = _CRC[(part ^ data[begin[n_long:upto] + i]) & 0xFF] ^ (part >> 8)
    out = np.empty(len(order), np.uint32)
    out[order[n_long:]] = ~crc[n_long:]
    for at in order[:n_long].tolist():
        out[at] = zlib.crc32(data[starts[at] : ends[at]])
    return out


def features(texts: pa.Array, grams: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of the texts, and the number of words of each text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = " ".join(t or "" for t in texts.to_pylist()).encode()
    low = _WORD_BYTES[np.frombuffer(joined, np.uint8)]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = low != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    rows = np.searchsorted(np.cumsum(sizes + 1), starts, side="right")
    # The same words with exactly one blank between them, so that a run of words is one span.
    length = ends - starts
    keep = inside[1:-1].copy()
    keep[ends[ends < len(keep)]] = True
    data = np.where(low == 0, np.uint8(32), low)[keep]
    last = np.cumsum(length + 1) - 1
    first = last - length
    found = []
    for k in range(1, grams + 1):
        n = max(len(starts) - k + 1, 0)
        same = rows[:n] == rows[k - 1 : k - 1 + n]
        found.append((rows[:n][same], checksums(data, first[:n][same], last[k - 1 : k - 1 + n][same]) % np.uint32(buckets)))
    n_words = np.bincount(rows, minlength=len(texts))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int64), n_words


def bucket_totals(df: DataFrame, text_col: str = "text", grams: int = 1, buckets: int = BUCKETS) -> dict[int, int]:
    """Features in each bucket over all texts: at most ``buckets`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in sliced(batch, limit=SLICE_BYTES):
                totals += np.bincount(features(part.column("text"), grams, buckets)[1], minlength=buckets)
        hit = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(totals[hit])], ["bucket", "n"])

    counts = df.select(quoted(text_col).alias("text")).mapInArrow(run, "bucket long, n long")
    return {r["bucket"]: r["n"] for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS, scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of every bucket, in doubles."""
    source, wanted = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array(
        [
            math.floor(scale * math.log((target.get(b, 0) + 1.0) * source / ((corpus.get(b, 0) + 1.0) * wanted)))
            for b in range(buckets)
        ],
        np.int64,
    )


def gain_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(value of a bit, plane) of the gains in two's complement; the value of the top plane is negative."""
    top = int(np.abs(gain).max(initial=0)).bit_length()
    words = -(-len(gain) // 64)
    planes = []
    for j in range(top + 1):
        bits = np.zeros(words * 64, np.uint8)
        bits[: len(gain)] = gain >> j & 1
        planes.append((-(1 << j) if j == top else 1 << j, np.packbits(bits, bitorder="little").view(np.uint64)))
    return planes


def sliced_weights(rows: np.ndarray, bucket: np.ndarray, n_rows: int, planes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Weight of each row from the planes of its bucket counts and of the gains."""
    words = len(planes[0][1])
    keys, counts = np.unique(rows * (words * 64) + bucket, return_counts=True)
    weights = np.zeros(n_rows, np.int64)
    k = 0
    while len(keys):
        hit = keys[counts >> k & 1 == 1]
        if len(hit):
            word = hit >> 6
            first = np.flatnonzero(np.diff(word, prepend=-1))
            owner, place = np.divmod(word[first], words)
            docs, line = np.unique(owner, return_inverse=True)
            plane = np.zeros((len(docs), words), np.uint64)
            plane[line, place] = np.bitwise_or.reduceat(np.uint64(1) << (hit & 63).astype(np.uint64), first)
            for value, bits in planes:
                weights[docs] += np.bitwise_count(plane & bits).sum(axis=1, dtype=np.int64) * (value << k)
        k += 1
        left = counts >> k > 0
        keys, counts = keys[left], counts[left]
    return weights


def noise(doc_id: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """Scaled Gumbel noise from the first 32 bits of the SHA-256 of ``seed:doc_id``; a null id counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighted(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    grams: int = 1,
    buckets: int = BUCKETS,
    scale: int = SCALE,
) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row; texts without words weigh 0."""
    gain = gains(bucket_totals(docs, text_col, grams, buckets), bucket_totals(target, target_col, grams, buckets), buckets, scale)
    shared = docs.sparkSession.sparkContext.broadcast(gain.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = gain_planes(np.array(shared.value, np.int64))
        for batch in batches:
            for at in range(0, len(batch), SLICE_ROWS):
                for part in sliced(batch.slice(at, SLICE_ROWS), limit=SLICE_BYTES):
                    rows, bucket, n_words = features(part.column("text"), grams, buckets)
                    weight = sliced_weights(rows, bucket, len(part), planes)
                    n_features = np.bincount(rows, minlength=len(part))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(n_words), pa.array(n_features), pa.array(weight)],
                        ["doc_id", "n_words", "n_features", "weight"],
                    )

    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    return named.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    grams: int = 1,
    buckets: int = BUCKETS,
    scale: int = SCALE,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row.

    Of the rows with at least ``min_words`` words, ``percent`` of a hundred (rounded down)
    with the highest scores are drawn; rank counts them from 1 and is null for all others.
    Ties go to the smaller id, null ids last.  Null texts are empty; repeated rows are rows
    like others, so a draw may end between them.  Other columns are ignored.  An empty table
    gives no rows; without target texts, all buckets are as likely there.
    """
    rows = weighted(docs, target, id_col, text_col, target_col, grams, buckets, scale)
    scored = cut_lineage(
        rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed, scale)).withColumn(
            "fit", F.when(F.col("n_words") >= min_words, 0).otherwise(1)
        )
    )
    placed = ranked(scored, "fit", [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    drawn = (F.col("fit") == 0) & (F.col("at") < F.floor(F.col("of") * percent / 100))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("at") + 1).alias("rank"))
