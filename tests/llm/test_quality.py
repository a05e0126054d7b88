import math
import re
from collections import Counter

from pyspark.sql import functions as F

from glossa.llm import quality


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    n = len(words)
    failed = n < 10 or 100 * len(repeated) > 20 * n
    symbols = sum(c in "#*$%&|<>" for c in text)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), failed


def check(df, labels):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = quality.judge(df, labels).collect()
    key = lambda x: str(x)
    assert sorted(((r.doc_id, *(r[c] for c in names)) for r in got), key=key) == sorted(
        ((r.doc_id, *base(r.text)) for r in df.collect()), key=key
    )
    assert all(not r.kept for r in got if r.base_failed)
    return got


def test_edges(spark, edges):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 1, 0), (3, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r.kept != r.base_failed for r in check(edges, labels))  # too few labels to certify anything


def test_documents(spark, documents, small):
    check(documents, spark.read.parquet(f"{small}/labels.parquet"))


def test_repeated_words(spark):
    texts = ["a b c d e a b c d e f", "x " * 12, "a b c d e f g h i j k a b c d e", "a b c d\n" * 4]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en")), spark.createDataFrame([], "doc_id long, quality int"))


def test_tail_is_exact(spark):
    cases = [(0, 10), (3, 50), (20, 1000), (400, 20_000), (0, 0)]
    df = spark.createDataFrame(cases, "k long, n long")
    for p in (0.02, 0.3):
        for r in df.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), p).alias("t")).collect():
            terms = (math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(p) + (r.n - i) * math.log1p(-p)) for i in range(r.k + 1))
            assert math.isclose(r.t, math.fsum(terms), rel_tol=1e-9, abs_tol=1e-300)


def test_cutoffs_hold_the_risk(spark):
    """Good texts with 1 % symbols are safe, those that 10 % of the good ones have are not cut."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)) + (" #####" if i % 10 == 0 else ""), "en") for i in range(4000)]
    bad = [(10_000 + i, " ".join(f"b{i}x{k}#####" for k in range(30)), "en") for i in range(200)]
    docs = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") < 10_000).cast("int").alias("quality"))
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert sum(not got[i].kept for i in range(4000)) <= 0.02 * 4000
    assert not any(got[10_000 + i].kept for i in range(200))
    assert got[10_000].rejected_by == "symbols"


def test_nothing(spark, nothing):
    assert quality.judge(nothing, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_correction_counts_strata_not_tests(spark):
    """300 good documents are enough for two strata and four rules at these levels, not for many more tests."""
    names = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_capitals long"
    rows = [(s, 30, 150, 100 * (i >= 300), 0, 0, 0, i < 300) for s in ("en", "de") for i in range(330)]
    cutoffs = quality.certified_cutoffs(spark.createDataFrame(rows, f"stratum string, {names}, good boolean"))
    assert sorted((r.stratum, r.rule) for r in cutoffs.collect()) == [("de", "symbols"), ("en", "symbols")]
