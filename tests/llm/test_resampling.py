import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from glossa.llm import resampling
from glossa.llm.common import ranked

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, grams):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in range(1, grams + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, grams=1, buckets=10_000, percent=10, min_words=20):
    """The definition, feature by feature."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in runs(text, grams)[1]) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)}
    rows = []
    for doc_id, text in docs:
        words, found = runs(text, grams)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, len(words) >= min_words])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:4]) + (None if isinstance(r[4], bool) else r[4],) for r in rows), key=str)


def result(df, target, **options):
    return sorted((tuple(r) for r in resampling.resample(df, target, **options).collect()), key=str)


def test_edges(spark, edges):
    docs = [(r.doc_id, r.text) for r in edges.collect()]
    texts = ["Hello, WORLD abc", None, "", "é é ßab"]
    target = spark.createDataFrame([(t,) for t in texts], "text string")
    assert result(edges, target, percent=50) == plain(docs, texts, percent=50)
    assert result(edges, target, grams=3, buckets=64, min_words=2) == plain(docs, texts, 3, 64, min_words=2)


def test_documents(spark, documents, small):
    target = spark.read.parquet(f"{small}/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    want = plain(docs, [r.text for r in target.collect()])
    assert result(documents, target) == want
    assert sum(r[4] is not None for r in want) > 10


def test_planes_are_the_dot_product():
    rng = np.random.default_rng(3)
    for buckets in (1, 63, 64, 65, 1000):
        for gain in (rng.integers(-20_000, 20_000, buckets), np.zeros(buckets, np.int64), np.full(buckets, -1), np.full(buckets, 7)):
            counts = rng.integers(0, 300, (5, buckets)) * (rng.random((5, buckets)) < 0.3)
            rows, bucket = np.nonzero(counts)
            times = counts[rows, bucket]
            got = resampling.sliced_weights(np.repeat(rows, times), np.repeat(bucket, times), 5, resampling.gain_planes(gain))
            assert got.tolist() == (counts @ gain).tolist()


def test_checksums_of_all_sizes():
    rnd = random.Random(5)
    spans = [bytes(rnd.randrange(256) for _ in range(n)) for n in [*range(70), 500] for _ in range(3)]
    data = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(s) for s in spans])
    starts = ends - np.array([len(s) for s in spans])
    assert resampling.checksums(data, starts, ends).tolist() == [zlib.crc32(s) for s in spans]
    assert resampling.checksums(data, starts[:0], ends[:0]).tolist() == []


def test_hot_rows(spark):
    """A third of the rows repeat one id and text: each is drawn once, and the ranges part them."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(7 if i % 3 == 0 else i, text) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    target = spark.createDataFrame([("w1 w2",)], "text string")
    assert result(df, target, percent=60) == plain(docs, ["w1 w2"], percent=60)


def test_ranked_parts_one_hot_group(spark):
    rows = spark.range(5000).selectExpr("if(id < 4000, 'a', concat('b', id % 7)) AS grp", "1 AS same", "id")
    from pyspark.sql import functions as F

    got = ranked(rows, "grp", [F.col("same")]).groupBy("grp").agg(
        F.sort_array(F.collect_list("at")).alias("at"), F.max("of").alias("of"), F.count("*").alias("n")
    )
    for r in got.collect():
        assert r["at"] == list(range(r["n"])) and r["of"] == r["n"]


def test_nothing(spark, nothing, documents):
    assert resampling.resample(nothing, documents).count() == 0
    assert resampling.resample(documents, nothing).count() == documents.count()
