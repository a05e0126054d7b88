"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its character n-grams (code points of the lower-cased text, each word
between spaces), hashed into ``BUCKETS``.  The ratio of a bucket is
log((p + a) / |p|) - log((n + a) / |n|) with its counts over toxic and other training
texts.  The ``features`` buckets whose ratio is surest are the inputs of a logistic
regression, each scaled by its ratio.

Ratios and weights are learned from at most ``sample`` labelled rows, chosen by a hash of
the id; with the bound on features, all that is gathered in one place is bounded.  Scoring
is one pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import held, lightened, quoted, released, sliced
from glossa.session import cut_lineage

SAMPLE = 12_000
FEATURES = 20_000
BUCKETS = 1 << 20
LENGTHS = (3, 4, 5)
SMOOTHING = 1.0
PENALTY = 2e-4
STEPS = 150
THRESHOLD = 0.7
TASKS = 16
#: Features of the fitting sample that are expanded at a time.
BLOCK = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HIGH = np.uint64(0xD6E8FEB86659FD93)
_WORD = np.zeros(129, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), 128, ord("'")]] = True


def buckets(text: str | None) -> np.ndarray:
    """Bucket of the n-gram at every position of a text (with repeats); runs of other characters are one space."""
    raw = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "replace"), np.uint32)
    word = _WORD[np.minimum(raw, 128)]
    chars = np.where(word, raw, np.uint32(32))
    chars = chars[word | np.concatenate([[True], word[:-1]])].astype(np.uint64)
    low, high = chars & np.uint64(255), chars >> np.uint64(8)
    wide = bool(high.any())
    out = []
    for n in LENGTHS:
        if len(chars) >= n:
            code = np.full(len(chars) - n + 1, n, np.uint64)
            for i in range(n):
                code = code << np.uint64(8) | low[i : len(chars) - n + 1 + i]
            if wide:
                # What does not fit beside the low bytes of the characters is mixed in; it is 0 for windows of the first 256.
                above = np.zeros(len(code), np.uint64)
                for i in range(n):
                    above = above * _HIGH + high[i : len(chars) - n + 1 + i]
                code ^= above * _HIGH
            out.append((code * _MIX) >> np.uint64(64 - BUCKETS.bit_length() + 1))
    return np.concatenate(out).astype(np.int32) if out else np.array([], np.int32)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(place, text, toxic) of at most ``sample`` labelled rows that are not held out.

    An id with several labels counts as toxic if one of them says so.  Repeated rows are
    one; if ids with several texts exceed ``sample``, a hash of both chooses among them.
    """
    known = (
        labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .withColumn("place", F.xxhash64("doc_id"))
    )
    chosen = F.broadcast(known.orderBy("place", "doc_id").limit(sample))
    texts = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    known_rows = texts.join(chosen, "doc_id").withColumn("tag", F.xxhash64("doc_id", "text"))
    # An id may have any number of rows: they are counted by (id, tag) before a text is moved.
    few = F.broadcast(known_rows.select("doc_id", "tag").distinct().orderBy("tag", "doc_id").limit(sample))
    rows = known_rows.join(few, ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"])
    return rows.select("place", "text", "toxic")


def log_ratios(rows: DataFrame, features: int, smoothing: float) -> DataFrame:
    """(bucket, ratio) of the surest buckets, at most ``features``.

    ``rows`` has (toxic, seen), seen being the packed distinct buckets of a text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for toxic, seen in zip(batch.column("toxic").to_pylist(), batch.column("seen").to_pylist(), strict=True):
                sums[int(toxic > 0)][np.frombuffer(seen, np.int32)] += 1
        at = np.flatnonzero(sums.any(axis=0)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(sums[1][at]), pa.array(sums[0][at])], ["bucket", "toxic", "other"]
        )

    counts = rows.mapInArrow(count, "bucket int, toxic long, other long").groupBy("bucket").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")
    )
    counts = cut_lineage(counts)
    all_toxic, all_other = (n or 0 for n in counts.agg(F.sum("toxic"), F.sum("other")).first())
    ratio = F.log((F.col("toxic") + smoothing) / (all_toxic + smoothing)) - F.log(
        (F.col("other") + smoothing) / (all_other + smoothing)
    )
    spread = F.sqrt(1 / (F.col("toxic") + smoothing) + 1 / (F.col("other") + smoothing))
    return (
        counts.select("bucket", ratio.alias("ratio"), F.abs(ratio / spread).alias("sure"))
        .orderBy(F.desc("sure"), "bucket")
        .limit(features)
        .select("bucket", "ratio")
    )


def _blocks(columns: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``BLOCK`` features: rows, feature columns, and which row of the run each belongs to."""
    at = 0
    while at < len(columns):
        upto, size = at + 1, len(columns[at])
        while upto < len(columns) and size + len(columns[upto]) <= BLOCK:
            size += len(columns[upto])
            upto += 1
        run = columns[at:upto]
        owner = np.repeat(np.arange(len(run), dtype=np.int32), [len(c) for c in run])
        yield slice(at, upto), np.concatenate(run), owner
        at = upto


def _logistic(columns: list[np.ndarray], scale: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features times ``scale``, by full-batch Adam steps.

    Margins and slopes are added up block by block, so beside the features themselves only
    one block is expanded at a time.
    """
    n = len(y)
    weight, bias = np.zeros(len(scale)), 0.0
    first, second = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    blocks = list(_blocks(columns))
    columns.clear()
    for step in range(1, STEPS + 1):
        scaled, slope, constant = weight * scale, np.zeros(len(scale)), 0.0
        for rows, column, owner in blocks:
            margin = np.bincount(owner, scaled[column], minlength=rows.stop - rows.start) + bias
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]
            slope += np.bincount(column, error[owner], minlength=len(scale))
            constant += error.sum()
        slope = np.append(slope * scale / n + PENALTY * weight, constant / n)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weight -= move[:-1]
        bias -= move[-1]
    return weight, bias


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    features: int = FEATURES,
    smoothing: float = SMOOTHING,
) -> DataFrame:
    """(bucket, weight) of the fitted model, bucket -1 being the constant; at most ``features`` + 1 rows.

    Without training rows the model is the constant of an even score below the threshold.
    """
    spark = docs.sparkSession

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lightened()
        for batch in (part for b in batches for part in sliced(b)):
            seen = [np.unique(buckets(t)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), batch.column("toxic"), pa.array(seen, pa.binary())], ["place", "toxic", "seen"]
            )

    rows = training_rows(docs, labels, id_col, text_col, sample).repartition(TASKS, "place")
    rows = cut_lineage(rows.mapInArrow(gather, "place long, toxic int, seen binary"))
    chosen = log_ratios(rows, features, smoothing).collect()  # at most `features` rows
    table = np.full(BUCKETS, -1, np.int32)
    table[[r["bucket"] for r in chosen]] = np.arange(len(chosen))
    ratios = np.array([r["ratio"] for r in chosen])
    lookup = spark.sparkContext.broadcast(table)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for seen in batch.column("seen").to_pylist():
                at = lookup.value[np.frombuffer(seen, np.int32)]
                kept.append(at[at >= 0].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), batch.column("toxic"), pa.array(kept, pa.binary())], ["place", "toxic", "seen"]
            )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labelled = [
            row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("place", "seen", "toxic")), strict=True)
        ]
        labelled.sort()
        y = np.array([float(t > 0) for _, _, t in labelled])
        if len(y):
            columns = [np.frombuffer(seen, np.int32) for _, seen, _ in labelled]
            labelled.clear()
            weight, bias = _logistic(columns, ratios, y)
        else:
            weight, bias = np.zeros(len(ratios)), 0.0
        at = np.array([-1, *[r["bucket"] for r in chosen]], np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.array([bias, *(weight * ratios)], float))], ["bucket", "weight"])

    # One task fits on the bounded sample.
    small = rows.mapInArrow(select, "place long, toxic int, seen binary").repartition(1)
    return small.mapInArrow(fit, "bucket int, weight double")


def score(docs: DataFrame, model: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns with a score from 0 to 1 (8 decimals) in ``name``, replacing a column of that name."""
    weights, bias = np.zeros(BUCKETS), 0.0
    for row in model.collect():
        if row["bucket"] < 0:
            bias = row["weight"]
        else:
            weights[row["bucket"]] = row["weight"]
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))

    @F.pandas_udf("double")
    def scored(texts):
        lightened()
        table, constant = shared.value
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            at = buckets(text if isinstance(text, str) else "")
            hit = np.unique(at[table[at] != 0])
            out[i] = constant + table[hit].astype(float).sum()
        return texts.__class__(np.round(1 / (1 + np.exp(-np.clip(out, -30, 30))), 8))

    return docs.withColumn(name, scored(quoted(text_col)))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null and empty texts get the score of a text without any n-gram.  Rows without an id
    count as held out.  Repeated rows get the same score each; other columns are ignored.
    """
    model = train(docs, labels, id_col, text_col, **options)
    named = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    return score(named, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that are not predicted toxic, as they came."""
    model = train(docs, labels, id_col, text_col, **options)
    rows = held(docs, _text=quoted(text_col))
    return released(score(rows, model, "_text", "_score").filter(F.col("_score") < THRESHOLD))
